import math
import re
from collections import Counter

from pyspark.sql import functions as F

from llm import quality
from tests.llm import texts


def _base(text):
    w = texts.WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if texts.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


EXTRA = ["a b c d e a b c d e a b c d e", "l1 x\nl1 x\n\n \nl1 x", "# * $ % & | < > ok", "x\x0by\x1cz   w", " ".join(map(str, range(10))), "a a a a a a a a a a a a"]


def test_base_counts(spark):
    rows = texts.documents() + [(500 + i, t, None, None, 0) for i, t in enumerate(EXTRA)]
    df = spark.createDataFrame(rows, texts.SHAPE).withColumn("_weights", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(df, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in out) == sorted((str(r[0]), *_base(r[1])) for r in rows)
    assert all(not r["kept"] for r in out if r["base_failed"]) and {r["_weights"] for r in out} == {"clash"}


def test_ratio_is_that_of_the_multinomials(spark):
    rows = [(1, "good words here, good", 1), (2, "bad!! bad!!", 0), (3, "other", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.ratio_model(df, df.where("quality = 1").withColumn("fold", F.lit(0)), buckets=64)
    grams = {r["doc_id"]: r["g"] for r in df.select("doc_id", quality.gram_buckets(F.col("text"), 64).alias("g")).collect()}
    assert [len(grams[i]) for i in (1, 2, 3)] == [10, 8, 2]
    raw, good = Counter(b for g in grams.values() for b in g), Counter(grams[1])
    for r in quality.mean_ratio(df, model, buckets=64).collect():
        g = grams[r["doc_id"]]
        want = sum(math.log((good[b] + 1) / (good.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in g) / len(g)
        assert abs(r["llr"] - want) < 1e-9


def test_junk_goes_and_clean_texts_stay(spark):
    common = texts.prose(40).split()  # so that unlabelled texts share words with labelled ones
    pick = lambda seed: " ".join(common[int(x, 36) % 40] for x in texts.prose(60, seed).split())
    good = [(i, pick(i).capitalize() + ".", 1) for i in range(150)]
    junk = [(1000 + i, re.sub(r"(\w+)", r"\1!!", pick(500 + i)).upper(), 0) for i in range(50)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, quality int")
    labels = df.where("doc_id % 2 = 0").select("doc_id", "quality", F.lit(0).alias("toxic"))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df.drop("quality"), labels).collect()}
    assert not any(kept[1000 + i] for i in range(50)) and sum(kept[i] for i in range(150)) >= 147


def test_bitmap_filter_drops_no_key(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    ids = rows.where("k % 10 = 0")
    held = {r["k"] for r in quality.among(rows, ids, "k", 1 << 16).collect()}
    assert set(range(0, 3000, 10)) <= held and len(held) < 500


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame(texts.documents(), texts.SHAPE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_rules(df, labels).collect())
    assert quality.quality_rules(df.limit(0), labels).collect() == []
