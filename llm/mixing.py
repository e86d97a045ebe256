"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.rows import packed, unpacked
from scenelake.session import settle


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) fixed by the parts: the first 52 bits of their md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temper: float, epochs: float, source: str, text: str) -> DataFrame:
    """Per source: its characters, target weight, mean repetition ``rate`` and the Poisson ``cdf`` up to where doubles reach 1.

    Rows of the source key count are few but not bounded, so the table is written, and Spark broadcasts
    it only if the file is under its own threshold; a sort-merge join takes over beyond that.
    """
    mass = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        raw = F.when(F.col("mass") > 0, F.pow(F.col("mass"), F.lit(temper))).otherwise(F.lit(0.0))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(raw)
        raw = F.when(F.col("mass") > 0, raw).otherwise(F.lit(0.0))
    weighed = mass.withColumn("raw", raw)
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("raw").alias("all_raw"))
    rated = weighed.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").select(
        "_source", "mass", F.coalesce(F.try_divide("raw", "all_raw"), F.lit(0.0)).alias("weight"), "all_mass"
    )
    rate = F.coalesce(F.try_divide(F.col("weight") * F.lit(float(epochs)) * F.col("all_mass"), F.col("mass")), F.lit(0.0))
    steps = settle(rated.withColumn("rate", rate)).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))))
    by = Window.partitionBy("_source").orderBy("k")
    log_fact = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(F.lit(0.0))).over(by)
    pmf = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_fact)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = steps.withColumn("pmf", pmf).withColumn("c", F.sum("pmf").over(by))
    return settle(summed.groupBy("_source", "mass", "weight", "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf")))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, temper: float = 0.5, epochs: float = 1.0, seed: int = 17, source: str = "source", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document as often as a Poisson number of its source's mean, all rows shuffled globally.

    The mean of source s is ``weight_s * epochs * all characters / characters of s``, so in expectation
    the mixture has ``epochs`` times the input's characters, split by ``weights`` (normalised over
    sources with text; unnamed ones get 0). Without weights they are the source sizes to the power
    ``temper``. The count inverts the Poisson distribution at a number hashed from the seed and the
    document, so a rerun or a lost executor gives the same rows. Columns: those of ``docs`` plus
    ``copy`` (0-based) and ``_mix_key``, by which rows are sorted over all partitions; these two replace
    columns of their name.

    Null source: a source of its own. Null id: hashed as ``null``. Repeated rows are each replicated
    (alike). Sources without text have mean 0. An empty table gives no rows.
    """
    rates = source_rates(docs, weights, temper, epochs, source, text).select("_source", "cdf")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = packed(docs, source=F.col(source), key=key, u=uniform(F.lit(seed), F.col(doc_id)))
    counted = rows.join(rates, F.col("source").eqNullSafe(F.col("_source"))).withColumn("times", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    copies = counted.where("times > 0").select("row", "key", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    ordered = copies.withColumn("order", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "key", "copy"))).orderBy("order")
    return unpacked(ordered, docs.columns, copy=F.col("copy"), _mix_key=F.col("order"))


#: DuckDB's word for ``mix_sources(documents)`` at its defaults.
MIX_SQL = """
with mass as (select source, sum(coalesce(length(text), 0))::double as mass from documents group by source),
w as (select source, mass, case when mass > 0 then pow(mass, 0.5) else 0 end as raw from mass),
t as (select sum(mass) as all_mass, sum(raw) as all_raw from w),
r as (select source, case when mass > 0 then raw / all_raw * 1.0 * all_mass / mass else 0 end as rate from w, t),
s as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from r),
p as (select *, sum(case when k > 0 then ln(k) else 0 end) over (partition by source order by k) as lf from s),
q as (select *, case when rate > 0 then exp(k * ln(rate) - rate - lf) when k = 0 then 1.0 else 0.0 end as pmf from p),
c as (select source, k, sum(pmf) over (partition by source order by k) as c from q),
cdf as (select source, list(c order by k) as cdf from c group by source),
u as (select d.*, ('0x' || substr(md5(concat('17:', coalesce(doc_id::varchar, 'null'))), 1, 13))::bigint / 4503599627370496.0 as u, cdf from documents d join cdf on d.source is not distinct from cdf.source),
n as (select doc_id, text, lang, source, n_chars, len(list_filter(cdf, lambda x: x <= u)) as times from u)
select doc_id, text, lang, source, n_chars, copy::int as copy from (select *, unnest(range(0, times)) as copy from n)
"""
