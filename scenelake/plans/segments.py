"""Windows over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is
cut into time slices, so one camera or one track that holds a third of all rows still
spreads over the cluster:

* ``with_halo`` copies the few rows near a slice edge into the neighbouring slice, so
  any window with a bounded reach is exact inside ``(key, slice)``;
* ``carry`` and ``hold_state`` handle what has unbounded reach (running sums, the last
  marker seen, the state held since some moment): each slice is summarised in one row,
  those summaries are windowed per key, and the value entering each slice is joined back.

All results equal those of the plain window; only the task layout differs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
SLICE_US = 3_600 * SECOND
"""Footage time per slice: at 30 frames a second one track has 108 000 rows in it."""

HALO_US = 6 * SECOND
"""Longer than any trailing window (2.5 s) plus the longest step (2 s)."""

SLICE = "_slice"
_HOME = "_home"


def slice_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def with_halo(df: DataFrame, order: str, width: int = SLICE_US, back: int = HALO_US, ahead: int = 0) -> DataFrame:
    """Add ``_slice``; rows within reach of an edge also appear in the next (or previous) slice."""
    if width < max(back, ahead):
        raise ValueError("a slice must be at least as long as its halo")
    home = slice_of(F.col(order), width)
    offset = F.col(order) - home * width
    copies = [home, F.when(offset >= width - back, home + 1)]
    if ahead:
        copies.append(F.when(offset < ahead, home - 1))
    return df.withColumn(_HOME, home).withColumn(SLICE, F.explode(F.array_compact(F.array(*copies))))


def drop_halo(df: DataFrame) -> DataFrame:
    """Keep each row once, in the slice it belongs to."""
    return df.where(F.col(SLICE) == F.col(_HOME)).drop(_HOME)


def local(keys: Sequence[str], *order: str | Column) -> Window:
    """A window inside one slice of one key."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def with_slice(df: DataFrame, order: str, width: int = SLICE_US) -> DataFrame:
    return df if SLICE in df.columns else df.withColumn(SLICE, slice_of(F.col(order), width))


def crossing(df: DataFrame, keys: Sequence[str], order: str, began: str, width: int = SLICE_US) -> DataFrame | None:
    """The keys with rows in a later slice than the one they ``began`` in, and None if there are none: nothing enters a slice of the others."""
    out = df.where(slice_of(F.col(order), width) > slice_of(F.col(began), width)).select(*keys).distinct()
    return None if out.isEmpty() else out


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None,
    tops: Mapping[str, Column] | None = None,
    width: int = SLICE_US,
    among: DataFrame | None | str = "all",
) -> DataFrame:
    """Running sums, last non-null values (this row included), last non-null values before this row,
    and maxima (``tops``) over the rows before this one.

    ``order[0]`` is the column the slices are cut on; further columns break ties. Only slices of the keys ``among``
    (see :func:`crossing`; some of the key columns will do) are summarised and carried on from.
    """
    sums, lasts, befores, tops = dict(sums or {}), dict(lasts or {}), dict(befores or {}), dict(tops or {})
    tails = {**lasts, **befores}
    base = with_slice(df, order[0], width)
    for name, column in {**sums, **tails, **tops}.items():
        base = base.withColumn(f"_v_{name}", column)
    rank = F.struct(*[F.col(c) for c in order])
    summary = _of(base, keys, among).groupBy(*keys, SLICE).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_s_{n}") for n in tails],
        *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in tops],
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select(
        *keys,
        SLICE,
        *[F.sum(f"_s_{n}").over(before).alias(f"_in_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in tails],
        *[F.max(f"_s_{n}").over(before).alias(f"_in_{n}") for n in tops],
    )
    earlier = local(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    here = local(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = _entered(base, entering, keys, among)
    done = {n: F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) + F.coalesce(F.col(f"_in_{n}"), F.lit(0)) for n in sums}
    done |= {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_in_{n}")) for n in lasts}
    done |= {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(earlier), F.col(f"_in_{n}")) for n in befores}
    done |= {n: F.greatest(F.max(f"_v_{n}").over(earlier), F.col(f"_in_{n}")) for n in tops}
    out = out.withColumns(done)
    return out.drop(*[f"_v_{n}" for n in done], *[f"_in_{n}" for n in done])


def _of(base: DataFrame, keys: Sequence[str], among: DataFrame | None | str) -> DataFrame:
    return base.join(among, [k for k in keys if k in among.columns], "left_semi") if isinstance(among, DataFrame) else base


def _entered(base: DataFrame, entering: DataFrame, keys: Sequence[str], among: DataFrame | None | str) -> DataFrame:
    """``base`` with what enters each slice, which is nothing for keys that are not ``among``."""
    if among is None:
        return base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in entering.schema if f.name not in (*keys, SLICE)})
    return base.join(entering, [*keys, SLICE], "inner" if isinstance(among, str) else "left")


def hold_state(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    marker: Column,
    *,
    state: str,
    since: str,
    previous: str | None = None,
    lasts: Mapping[str, Column] | None = None,
    width: int = SLICE_US,
    among: DataFrame | None | str = "all",
) -> DataFrame:
    """The last non-null ``marker`` so far, and the ``order`` value at which it took over.

    A marker equal to the state already held changes nothing, so ``since`` is the start
    of the whole stretch, over as many slices as it lasts. ``previous`` names the state held
    just before this row; ``lasts`` are carried along and ``among`` taken as in :func:`carry`.
    """
    lasts = dict(lasts or {})
    base = with_slice(df, order, width).withColumn("_m", marker)
    earlier = local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_pm", F.last("_m", ignorenulls=True).over(earlier))
    marked = F.col("_m").isNotNull()
    base = base.withColumn("_switch", F.when(marked & (F.col("_m") != F.col("_pm")), F.col(order)))
    base = base.withColumns({f"_v_{n}": c for n, c in lasts.items()})
    base = base.withColumn("_first", F.when(marked & F.col("_pm").isNull(), F.struct("_m", F.col(order).alias("_t"))))
    summary = _of(base, keys, among).groupBy(*keys, SLICE).agg(
        F.min_by("_m", F.when(marked, F.col(order))).alias("_fm"),
        F.min(F.when(marked, F.col(order))).alias("_ft"),
        F.max_by("_m", F.when(marked, F.col(order))).alias("_lm"),
        F.max("_switch").alias("_ls"),
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_s_{n}") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.withColumn("_in", F.last("_lm", ignorenulls=True).over(before)).withColumn(
        "_took",
        F.coalesce(
            F.col("_ls"),
            F.when(F.col("_fm").isNotNull() & ~F.col("_fm").eqNullSafe(F.col("_in")), F.col("_ft")),
        ),
    )
    entering = entering.select(
        *keys,
        SLICE,
        "_in",
        F.last("_took", ignorenulls=True).over(before).alias("_in_since"),
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in lasts],
    )
    first = F.last("_first", ignorenulls=True).over(so_far)
    out = _entered(base, entering, keys, among).withColumns(
        {
            state: F.coalesce(F.last("_m", ignorenulls=True).over(so_far), F.col("_in")),
            "_sw": F.last("_switch", ignorenulls=True).over(so_far),
            "_f": first,
            **{n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(so_far), F.col(f"_in_{n}")) for n in lasts},
        }
    )
    if previous:
        out = out.withColumn(previous, F.coalesce("_pm", "_in"))
    taken = F.when(F.col("_f").isNotNull() & ~F.col("_f._m").eqNullSafe(F.col("_in")), F.col("_f._t"))
    out = out.withColumn(since, F.coalesce(F.col("_sw"), taken, F.col("_in_since")))
    return out.drop("_m", "_pm", "_switch", "_first", "_in", "_in_since", "_sw", "_f", *[f"_{p}_{n}" for n in lasts for p in ("v", "in")])
