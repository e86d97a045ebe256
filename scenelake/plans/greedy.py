"""Greedy spacing along a key: keep a row, skip what comes within its gap, keep the next.

Which rows are kept depends on the row kept before, so it is not a window function. It is made
parallel in three steps:

1. a row at least ``gap`` after its predecessor is kept whatever came before it, which cuts every
   key into bursts;
2. a burst inside one time slice is walked in one small array;
3. a burst that runs over several slices is described slice by slice as a map from the row a
   slice is entered at to the row it is left for, and the entries really used are found by
   doubling those maps, so the number of rounds is the logarithm of the slices in the burst.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.plans.segments import SLICE, SLICE_US, carry, local
from scenelake.session import settle


def _walk(times, gap):
    """Kept times of one sorted array, the first one being kept."""
    start = F.struct(F.array(times[0]).alias("kept"), times[0].alias("at"))

    def step(acc, t):
        keep = t - acc["at"] >= gap
        return F.struct(
            F.when(keep, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"),
            F.when(keep, t).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(times, start, step, lambda acc: acc["kept"])


def _entries(keys: list[str], width: int, schema: str):
    """Per slice of a long burst: where each possible entry leads."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        t, gap = pdf["_t"].to_numpy(np.int64), int(pdf["_gap"].iloc[0])
        home = int(pdf[SLICE].iloc[0])
        end = (home + 1) * width
        inside = int(np.searchsorted(t, end, side="left"))
        if inside == 0:
            return pdf.iloc[:0][[*keys, SLICE]].assign(_in=[], _out_slice=[], _out=[]).astype({"_in": "int64"})
        succ = np.searchsorted(t, t[:inside] + gap, side="left")
        leaves = np.empty(inside, np.int64)
        for i in range(inside - 1, -1, -1):
            leaves[i] = succ[i] if succ[i] >= inside else leaves[succ[i]]
        # Only rows that a walk from an earlier slice can reach matter, and the burst's first row.
        reach = int(np.searchsorted(t[:inside], t[0] + gap, side="left")) + 1
        n = min(reach, inside)
        to = leaves[:n]
        known = to < len(t)
        out = np.where(known, t[np.minimum(to, len(t) - 1)], -1)
        frame = {k: [pdf[k].iloc[0]] * n for k in keys}
        frame |= {SLICE: [home] * n, "_in": t[:n], "_out_slice": np.where(known, out // width, -1), "_out": out}
        return pd.DataFrame(frame)

    return run


def greedy_spacing(df: DataFrame, keys: Sequence[str], order: str, gap: str, tie: Sequence[str] = (), *, width: int = SLICE_US) -> DataFrame:
    """Adds ``kept``. ``gap`` is a column constant per key (0 keeps every row); equal times keep the first by ``tie``."""
    keys = list(keys)
    w = local(keys, order, *tie)
    base = settle(df.withColumn(SLICE, F.floor(F.col(order) / F.lit(width)).cast("long")))
    among = base.groupBy(*keys).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi")).where("_lo < _hi").select(*keys)
    among = None if among.isEmpty() else settle(among)
    base = carry(base, keys, [order, *tie], befores={"_prev": F.col(order)}, width=width, among=among)
    head = F.col("_prev").isNull() | (F.col(order) - F.col("_prev") >= F.col(gap))
    first = F.col("_prev").isNull() | (F.col(order) > F.col("_prev"))
    base = base.withColumns({"_head": head, "_first": first})
    base = base if among is None else settle(base)
    base = carry(base, keys, [order, *tie], lasts={"_burst": F.when(F.col("_head"), F.col(order))}, width=width, among=among)
    base = settle(base)

    times = base.where(F.col("_first") & (F.col(gap) > 0)).select(*keys, "_burst", SLICE, F.col(order).alias("_t"), F.col(gap).alias("_gap"))
    one = [*keys, "_burst"]
    # A burst shorter than its gap keeps its head only; the others are walked.
    short = times.groupBy(*one, SLICE).agg(F.array_sort(F.collect_list("_t")).alias("_ts"), F.first("_gap").alias("_gap"))
    long = None
    if among is not None:  # only these can have a burst in several slices
        span = times.join(among, keys, "left_semi").groupBy(*one).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        long = settle(span.where(F.floor(F.col("_lo") / width) < F.floor(F.col("_hi") / width)).select(*one))
        long = None if long.isEmpty() else long
    walked = short if long is None else short.join(long, one, "left_anti")
    walked = walked.withColumn("_kept", _walk(F.col("_ts"), F.col("_gap"))).select(*one, F.explode("_kept").alias("_t"))
    if long is not None:
        walked = walked.unionByName(_long_bursts(times.join(long, one, "left_semi"), one, width))
    out = base.join(walked.withColumnRenamed("_t", order).withColumn("_k", F.lit(True)), [*one, order], "left")
    kept = F.when(F.col(gap) <= 0, True).otherwise(F.col("_first") & F.coalesce("_k", F.lit(False)))
    return out.withColumn("kept", kept).drop("_prev", "_head", "_first", "_burst", "_k", SLICE)


def _long_bursts(times: DataFrame, one: list[str], width: int) -> DataFrame:
    times = settle(times.join(times.groupBy(*one).agg(F.min("_t").alias("_lo")), one))
    # The row a slice is left for lies within two gaps of its end.
    reach = F.floor((F.col("_t") - 2 * F.col("_gap")) / F.lit(width)).cast("long")
    seen = times.withColumn(SLICE, F.explode(F.sequence(F.greatest(reach, F.floor(F.col("_lo") / width).cast("long")), F.col(SLICE))))
    fields = {f.name: f.dataType.simpleString() for f in times.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in one) + f", {SLICE} long, _in long, _out_slice long, _out long"
    hops = settle(seen.groupBy(*one, SLICE).applyInPandas(_entries(one, width, schema), schema))
    first = times.groupBy(*one).agg(F.min("_t").alias("_in"))
    reached = settle(first.withColumn(SLICE, F.floor(F.col("_in") / width).cast("long")))
    jump = hops.where(F.col("_out") >= 0)
    total = reached.count()
    while True:
        landed = reached.join(jump, [*one, SLICE, "_in"]).select(*one, F.col("_out_slice").alias(SLICE), F.col("_out").alias("_in"))
        reached = settle(reached.select(*one, SLICE, "_in").unionByName(landed).distinct())
        now = reached.count()
        if now == total:
            break
        total = now
        onward = jump.select(*one, F.col(SLICE).alias("_out_slice"), F.col("_in").alias("_out"), F.col("_out_slice").alias("_s2"), F.col("_out").alias("_o2"))
        jump = settle(
            jump.join(onward, [*one, "_out_slice", "_out"]).select(*one, SLICE, "_in", F.col("_s2").alias("_out_slice"), F.col("_o2").alias("_out"))
        )
    per = times.groupBy(*one, SLICE).agg(F.array_sort(F.collect_list("_t")).alias("_ts"), F.first("_gap").alias("_gap"))
    from_entry = F.filter("_ts", lambda t: t >= F.col("_in"))
    entered = per.join(reached, [*one, SLICE])
    return entered.withColumn("_kept", _walk(from_entry, F.col("_gap"))).select(*one, F.explode("_kept").alias("_t"))
