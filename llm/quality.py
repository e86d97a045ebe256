"""Quality rules: counts per text and a hashed n-gram likelihood ratio, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.rows import packed, unpacked
from scenelake.session import settle

BUCKETS = 1 << 14
STEP = 0.005
FILTER_BITS = 1 << 22
LABEL_BITS = 1 << 24
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""

    def covered(keys: Column) -> Column:
        def marked(s: Column) -> Column:
            twin = lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])
            at = F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(twin(x, j), x["i"])), lambda i: i.isNotNull()))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), marked)
        )

    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
    return F.when(F.size(hashes) <= width, F.lit(0).cast("long")).otherwise(let(windows, covered))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(_WORD))
    words = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.concat_ws("", w)).cast("long").alias("chars"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("r"))
    out = docs.withColumns({
        "n_symbols": F.when(t.rlike(f"[{_SYMBOLS}]"), F.length(t) - _without(t, _SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "_counts": let(words, lambda w: let(counted(w), lambda c: F.struct(c["n"].alias("n"), c["chars"].alias("chars"), c["r"].alias("r"), ((c["n"] < 10) | (100 * c["r"] > 20 * c["n"])).alias("failed")))),
    })
    return out.withColumns({"n_words": F.col("_counts.n"), "word_chars": F.col("_counts.chars"), "n_repeat_words": F.col("_counts.r"), "base_failed": F.col("_counts.failed")}).drop("_counts")


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hashed unigrams and bigrams of the lower-cased words and punctuation runs of the whole text."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    one = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.concat(
        F.transform(h, lambda x: one(x)), F.transform(h, lambda x, i: one(F.xxhash64(F.coalesce(F.get(h, i - 1), F.lit(0).cast("long")), x)))
    ))


def ratio_model(raw: DataFrame, trusted: DataFrame | None = None, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, per bucket the log of trusted over raw add-one multinomials, and ``without``, such arrays without each fold.

    ``trusted`` has a column ``fold`` of 0 or 1; without it, the rows of ``raw`` that have a fold are trusted, and no text is
    cut twice. Three times ``buckets`` doubles, whatever the input.
    """
    rows = raw.select(text, F.col("fold") if trusted is None else F.lit(None).cast("int").alias("fold"), F.lit(True).alias("raw"))
    if trusted is not None:
        rows = rows.unionByName(trusted.select(text, F.col("fold").cast("int").alias("fold"), F.lit(False).alias("raw")))
    grams = rows.select("fold", "raw", F.explode(gram_buckets(F.col(text), buckets)).alias("bucket"))
    seen = grams.groupBy("bucket").agg(F.count_if("raw").alias("r"), F.count("fold").alias("t"), F.count_if(F.col("fold") != 0).alias("t0"), F.count_if(F.col("fold") != 1).alias("t1"))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = settle(every.join(seen, "bucket", "left").fillna(0, ["r", "t", "t0", "t1"]))
    totals = both.agg(*[F.sum(c).alias(c) for c in ("r", "t", "t0", "t1")]).first()
    log_share = lambda c: F.ln((F.col(c) + 1.0) / F.lit(float(totals[c] + buckets)))
    rows = both.agg(F.sort_array(F.collect_list(F.struct("bucket", *[(log_share(c) - log_share("r")).alias(c) for c in ("t", "t0", "t1")]))).alias("a"))
    of = lambda c: F.transform("a", lambda x: x[c])
    return settle(rows.select(of("t").alias("weights"), F.array(of("t0"), of("t1")).alias("without")))


def mean_ratio(docs: DataFrame, model: DataFrame, text: str = "text", buckets: int = BUCKETS, fold: str | None = None) -> DataFrame:
    """``docs`` with ``llr``, the log-likelihood ratio per n-gram of the text; 0 for a text without n-grams.

    With ``fold`` a row is judged by the model that has not seen its fold.
    """
    held = docs.withColumn("_weights", model.select("without" if fold else "weights").scalar())
    weights = F.get("_weights", F.col(fold)) if fold else F.col("_weights")
    ratio = let(F.struct(gram_buckets(F.col(text), buckets).alias("g"), weights.alias("w")), lambda s: F.when(F.size(s["g"]) > 0, F.aggregate(
        s["g"], F.lit(0.0), lambda a, b: a + F.get(s["w"], b)) / F.size(s["g"])).otherwise(F.lit(0.0)))
    return held.withColumn("llr", ratio).drop("_weights")


def best_cut(scored: DataFrame, cost: float = 20.0) -> float:
    """The threshold on ``llr`` with the largest share of ``quality`` 0 rows below it less ``cost`` times the share of 1 rows below it.

    Counts of fixed steps of the score, at most a few thousand rows, reach the driver. The cut lies in the
    middle of the empty stretch below the first step that stays; of equally good ones the lowest is taken.
    Without labels of both kinds nothing is cut.
    """
    steps = scored.groupBy(F.floor(F.col("llr") / STEP).alias("at")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).orderBy("at").collect()
    good, bad = sum(r["good"] for r in steps), sum(r["bad"] for r in steps)
    best, cut, below, top = 0.0, float("-inf"), [0, 0], None
    for r in steps:
        worth = below[1] / bad - cost * below[0] / good if good and bad else 0.0
        if worth > best:
            best, cut = worth, (top + r["at"]) / 2 * STEP
        below, top = [below[0] + r["good"], below[1] + r["bad"]], r["at"] + 1
    return cut


def maybe_among(rows: DataFrame, ids: DataFrame, key: str, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``name``: whether the key may be in ``ids``, by a bitmap of ``bits`` hashed keys, of that size whatever the input.

    It spares a join the texts of rows it would drop; as the keys outgrow the bitmap it merely spares less.
    """
    words = bits // 64
    hashed = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    set_bits = ids.select(hashed().alias("h")).groupBy(F.floor(F.col("h") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))).alias("b"))
    every = rows.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(set_bits, "w", "left").fillna(0, ["b"])
    bitmap = settle(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bitmap")))
    held = rows.withColumn("_bitmap", bitmap.select("bitmap").scalar())
    word = F.get("_bitmap", F.floor(hashed() / 64).cast("int"))
    return held.withColumn(name, F.call_function("getbit", word, F.pmod(hashed(), F.lit(64)).cast("int")) == 1).drop("_bitmap")


def among(rows: DataFrame, ids: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be in ``ids``."""
    return maybe_among(rows, ids, key, "_among", bits).where("_among").drop("_among")


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cost: float = 20.0, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base counts, ``llr``, ``cut`` and ``kept``.

    Trusted texts are those whose every label has quality 1; the raw multinomial is over all documents.
    ``kept`` is false for a failed base rule, else whether the mean ratio reaches the cut. That is fitted on all
    labelled documents that pass the base rules, each judged by a model that has not seen it, as unlabelled ones are. Null texts are empty and fail; repeated rows are judged alike; without labels
    the ratio is 0 for all and nothing is cut; the added columns replace columns
    of their name.
    """
    marks = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.min("quality").alias("quality"))
    rows = maybe_among(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), marks, "_id", "_maybe", LABEL_BITS)
    # The few rows that only seem labelled stay among these, so that every row is in one of the two parts.
    fold = F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int")
    maybe = settle(rows.where("_maybe").join(marks.hint("merge"), "_id", "left").select("_text", "quality", fold.alias("fold")))
    parts = maybe.select("_text", F.when(F.col("quality") == 1, F.col("fold")).alias("fold")).unionByName(rows.where("not _maybe").select("_text", F.lit(None).cast("int").alias("fold")))
    model = ratio_model(parts, text="_text", buckets=buckets)
    judged = base_rules(maybe.where("quality is not null"), "_text").where("not base_failed")
    cut = best_cut(mean_ratio(judged, model, "_text", buckets, "fold"), cost)
    out = mean_ratio(base_rules(packed(docs, _text=F.col(text)), "_text"), model, "_text", buckets)
    base = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")}
    return unpacked(out, docs.columns, **base, cut=F.lit(cut), kept=~F.col("base_failed") & (F.col("llr") >= F.lit(cut)))
