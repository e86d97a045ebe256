"""What the cut of the quality rules is fitted on."""

from pyspark.sql import functions as F

from llm import quality


def test_the_cut_is_fitted_on_every_labelled_document(spark, monkeypatch):
    n = 24_000
    word = lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(500)))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word(j) for j in range(12)]).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    fitted = []
    whole = quality.best_cut
    monkeypatch.setattr(quality, "best_cut", lambda scored, cost: fitted.append(scored.count()) or whole(scored, cost))
    quality.quality_rules(docs, labels)
    passing = quality.base_rules(docs).where("not base_failed").count()
    assert fitted == [passing] and passing > 20_000


def test_documents_that_only_seem_labelled_count_among_all(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABEL_BITS", 64)
    texts = ["one two three four five six seven eight nine ten " + "abcdefgh"[i % 8] * (1 + i % 3) for i in range(80)]
    docs = spark.createDataFrame([(None if i == 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 3)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["text"]: r["llr"] for r in quality.quality_rules(docs, labels, buckets=64).collect()}
    trusted = docs.join(labels.where("quality = 1"), "doc_id").select("text", F.lit(0).alias("fold"))
    want = {r["text"]: r["llr"] for r in quality.mean_ratio(docs, quality.ratio_model(docs, trusted, buckets=64), buckets=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
