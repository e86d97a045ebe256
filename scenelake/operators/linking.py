"""Linking detections into tracks with joins.

A live tracker pairs every track with every box of the next frame, one frame after the other. Here
all frames are paired at once: each box with its best partner in the frame before, chains of such
links become tracklets, tracklets are stitched over gaps, and what lived long enough is published.
Taking a frame's best overlaps first stands in for the optimal pairing and the last few steps for a motion filter,
so identities can differ where boxes tie; ``clear_mot`` and ``idf1`` measure by how much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from scenelake.functions.boxes import box, box_center_x, box_center_y, iou
from scenelake.functions.clock import us
from scenelake.operators.presence import step_ordinal
from scenelake.plans.segments import SLICE, SLICE_US, drop_halo, local, with_halo
from scenelake.session import forget, settle, settled

NODE = ("source_id", "step", "det_id")


@dataclass(frozen=True)
class LinkSettings:
    """Confidence bands, overlaps, and how long a track must and may live."""

    high: float = 0.3
    low: float = 0.1
    init: float = 0.5
    iou_high: float = 0.2
    iou_low: float = 0.4
    min_hits: int = 3
    max_lost_s: float = 1.5
    tail_steps: int = 5
    frame_width: float = 640.0
    frame_height: float = 480.0

    def __post_init__(self) -> None:
        if not 0.0 < self.low < self.high <= self.init:
            raise ValueError("confidence bands must rise: 0 < low < high <= init")
        if not (0.0 <= self.iou_high <= 1.0 and 0.0 <= self.iou_low <= 1.0):
            raise ValueError("overlaps must be in [0, 1]")
        if self.min_hits < 1 or self.max_lost_s < 0:
            raise ValueError("min_hits must be at least 1 and max_lost_s >= 0")


def association_candidates(dets: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Same-class pairs of boxes on consecutive steps that overlap enough for the later box's band.

    A frame holds at most what the detector lets through, so an equi-join on the frame is enough.
    """
    s = settings
    usable = dets.where(F.col("confidence") >= s.low)
    before = usable.select("source_id", (F.col("step") + 1).alias("step"), "label", F.col("det_id").alias("prev_id"), F.col("box").alias("_pb"))
    pairs = usable.join(before, ["source_id", "step", "label"]).withColumn("iou", iou(F.col("box"), F.col("_pb")))
    strong = F.col("confidence") >= s.high
    pairs = pairs.where(F.col("iou") >= F.when(strong, s.iou_high).otherwise(s.iou_low))
    return pairs.select(*NODE, "prev_id", "iou", F.when(strong, "high").otherwise("low").alias("band"))


BEATS_PER_SLICE = 64
_END = ("prev_step", "prev_det_id")


def _decide(table: pa.Table) -> pa.Table:
    """A slice's pairs from the best down: taken if both ends are free, left out if one is not, open if that depends on another slice."""
    table = table.sort_by([("gap", "ascending"), ("iou", "descending"), ("prev_det_id", "ascending"), ("det_id", "ascending"), ("prev_step", "ascending"), ("step", "ascending")])
    taken, waiting, kept, sure = set(), set(), [], []
    for i, (*ends, reaches_out) in enumerate(zip(*[table[c].to_pylist() for c in (*_END, "step", "det_id", "_out")])):
        tail, head = (False, *ends[:2]), (True, *ends[2:])
        if tail in taken or head in taken:
            continue
        free = not (reaches_out or tail in waiting or head in waiting)
        (taken if free else waiting).update((tail, head))
        kept.append(i)
        sure.append(free)
    return table.drop_columns(["_slice", "_out"]).take(pa.array(kept, pa.int64())).append_column("_taken", pa.array(sure, pa.bool_()))


def best_pairs(met: DataFrame, lost_us: int) -> DataFrame:
    """Links (source_id, step, det_id, prev_step, prev_det_id) taken from the shortest gap and best overlap down, each if both its ends are still free, until no pair is open.

    ``met`` has these columns, ``first_t``, ``gap`` and ``iou``; gaps are at most ``lost_us``. Slices of time are decided at once; what hangs on a tail
    that reaches over a slice's end waits for the next round, whose slices begin half a slice further on.
    """
    width = BEATS_PER_SLICE * max(lost_us, 1)
    out, link = [], ["source_id", "step", "det_id", *_END]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema) + ", _taken boolean"
    while True:
        at = lambda t: F.floor((t + F.lit(len(out) % 2 * (width // 2))) / F.lit(width))
        last = F.col("first_t") - F.col("gap")
        sliced = met.withColumns({"_slice": at(F.col("first_t")), "_out": at(last + 1) != at(last + lost_us)})
        decided = settle(sliced.groupBy("source_id", "_slice").applyInArrow(_decide, shape))
        out.append(decided.where("_taken").select(*link))
        met = decided.where("not _taken").drop("_taken")
        if met.isEmpty():
            return reduce(DataFrame.unionByName, out)


def pair_frames(pairs: DataFrame) -> DataFrame:
    """Each box's predecessor (source_id, step, det_id, prev_id): strong boxes choose first, what is left over goes to weak ones.

    A frame's edges are taken from the best overlap down, each if both its ends are still free. All frames are
    folded at once; a frame holds at most what the detector lets through.
    """
    edge = F.struct((F.col("band") != "high").alias("weak"), (-F.col("iou")).alias("cost"), "prev_id", "det_id")
    ids = pairs.schema["det_id"].dataType.simpleString()
    frames = pairs.groupBy("source_id", "step").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    none = F.array().cast(f"array<struct<prev_id:{ids},det_id:{ids}>>")

    def take(taken: Column, e: Column) -> Column:
        busy = F.exists(taken, lambda t: (t["prev_id"] == e["prev_id"]) | (t["det_id"] == e["det_id"]))
        return F.when(busy, taken).otherwise(F.concat(taken, F.array(F.struct(e["prev_id"].alias("prev_id"), e["det_id"].alias("det_id")))))

    chosen = frames.select("source_id", "step", F.inline(F.aggregate("edges", none, take)))
    return chosen.select(*NODE, "prev_id")


SLICE_STEPS = 256


def _heads_inside(key: list[str], parent: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Heads of chains as far as their own slice reaches, by jumping from parent to parent in arrays, for all slices of a group at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf[[*key, "_slice"]].assign(_at=np.arange(len(pdf)))
        linked = np.flatnonzero(pdf["_linked"].to_numpy(bool))
        above = pdf.iloc[linked][[*parent, "_slice"]].set_axis([*key, "_slice"], axis=1).merge(places, on=[*key, "_slice"], how="left")["_at"]
        up = np.arange(len(pdf))
        up[linked] = above.fillna(pd.Series(linked)).to_numpy().astype(np.int64)
        while (up[up] != up).any():
            up = up[up]
        head = pdf.iloc[up]
        return pd.DataFrame(
            {"source_id": pdf["source_id"], **{k: pdf[k] for k in key}, **{f"_top_{k}": head[k].to_numpy() for k in key}, **{f"_over_{k}": head[p].to_numpy() for k, p in zip(key, parent)}, "_linked": head["_linked"].to_numpy()}
        )

    return run


def chain_heads(nodes: DataFrame, key: list[str], parent: list[str], *, steps: int = SLICE_STEPS) -> DataFrame:
    """``head_*`` of every node.

    ``key`` are the identifying columns beside ``source_id``, a step first, ``parent`` the same of the predecessor (null at a
    head, else of an earlier step). Chains are followed inside slices of ``steps`` steps; what is left is a chain of
    slice heads, which doubling shortens until none has a parent. The rounds are the logarithm of the slices a
    chain runs through, over one row per slice and chain, and a chain is never in one task.
    """
    heads, tops, overs = ([f"{prefix}_{k}" for k in key] for prefix in ("head", "_top", "_over"))
    types = {k: nodes.schema[k].dataType.simpleString() for k in ("source_id", *key)}
    shape = ", ".join([f"{c} {types[c]}" for c in ("source_id", *key)] + [f"{c} {types[k]}" for names in (tops, overs) for c, k in zip(names, key)] + ["_linked boolean"])
    # A missing parent is a flag and no null, which pandas would hold as a fraction; narrow slices go to a task several at a time.
    linked, group = F.col(parent[0]).isNotNull(), steps * max(1, SLICE_STEPS // steps)
    rows = nodes.select(
        "source_id", *key, *[F.coalesce(F.col(p).cast(types[k]), k).alias(p) for k, p in zip(key, parent)],
        linked.alias("_linked"), F.floor(F.col(key[0]) / steps).alias("_slice"), F.floor(F.col(key[0]) / group).alias("_group"),
    )
    inside = rows.groupBy("source_id", "_group").applyInPandas(_heads_inside(key, parent), shape)
    inside = settle(inside.select("source_id", *key, *tops, *[F.when(F.col("_linked"), F.col(o)).alias(o) for o in overs]))
    # One row per slice head: where it goes on, in terms of the head of that row's own slice.
    above = inside.select("source_id", *[F.col(k).alias(o) for k, o in zip(key, overs)], *[F.col(t).alias(f"_next{t}") for t in tops])
    edges = inside.select("source_id", *tops, *overs).where(F.col(overs[0]).isNotNull()).distinct().join(above, ["source_id", *overs])
    open_ = settle(edges.select("source_id", *tops, *[F.col(f"_next{t}").alias(h) for t, h in zip(tops, heads)]))
    while not open_.isEmpty():
        onward = open_.select("source_id", *[F.col(t).alias(h) for t, h in zip(tops, heads)], *[F.col(h).alias(f"_{h}") for h in heads])
        jumped = settle(open_.join(onward, ["source_id", *heads], "left").withColumn("_moved", F.col(f"_{heads[0]}").isNotNull()))
        moved = jumped.where("_moved").isEmpty()
        open_ = jumped.select("source_id", *tops, *[F.coalesce(f"_{h}", h).alias(h) for h in heads])
        if moved:
            break
    out = inside.select("source_id", *key, *tops).join(open_, ["source_id", *tops], "left")
    return out.select("source_id", *key, *[F.coalesce(h, t).alias(h) for h, t in zip(heads, tops)])


PAIRS_AT_ONCE = 1 << 20


def _corners(boxes: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """x1, y1, x2, y2, and where all of them are given."""
    parts = [pc.struct_field(boxes, c) for c in ("x1", "y1", "x2", "y2")]
    given = np.logical_and.reduce([pc.is_valid(p).to_numpy(zero_copy_only=False) for p in parts])
    return [p.to_numpy() for p in parts], given


def _overlap(a: list[np.ndarray], b: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """``boxes.iou`` over arrays, NaN above all numbers as in Spark."""
    w, h = (np.fmin(a[i + 2], b[i + 2]) - np.maximum(a[i], b[i]) for i in (0, 1))
    shared = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    with np.errstate(all="ignore"):
        return np.where(given & ~(shared <= 0) & ~(union <= 0), shared / union, 0.0)


def _ranges(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, partner) for every partner of every row, ``count`` of them from ``first`` on, so many rows at a time that memory stays bounded."""
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
        row = np.repeat(np.arange(at, to), count[at:to])
        if len(row):
            yield row, first[row] + np.arange(total[at], total[to]) - total[row]
        at = to


def _predecessors(step: np.ndarray, label: np.ndarray, strong: np.ndarray, corners: list[np.ndarray], given: np.ndarray, s: LinkSettings) -> np.ndarray:
    """Each row's predecessor, or -1, as ``pair_frames`` of ``association_candidates`` finds it; rows are in order of step and det_id."""
    steps, begin, size = np.unique(step, return_index=True, return_counts=True)
    follows = np.concatenate([[False], np.diff(steps) == 1])
    frame = np.repeat(np.arange(len(steps)), size)
    count = np.where(follows[frame], size[frame - 1], 0)
    found = []
    for row, prev in _ranges(begin[frame - 1], count):
        same = (label[row] == label[prev]) & (label[row] >= 0)
        row, prev = row[same], prev[same]
        overlap = _overlap([c[row] for c in corners], [c[prev] for c in corners], given[row] & given[prev])
        near = ~(overlap < np.where(strong[row], s.iou_high, s.iou_low))
        found.append((row[near], prev[near], overlap[near]))
    before = np.full(len(step), -1)
    if not found:
        return before
    row, prev, overlap = (np.concatenate(f) for f in zip(*found))
    order = np.lexsort((row, prev, -overlap, ~strong[row], frame[row]))
    used = bytearray(len(step))
    for r, p in zip(row[order].tolist(), prev[order].tolist()):
        if before[r] < 0 and not used[p]:
            before[r], used[p] = p, 1
    return before


def _link_slice(s: LinkSettings, steps: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of one slice with the head of their chain inside it; a chain that touches no end of the slice is summed up on its head's row as ``_tracklets`` would."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("step", "ascending"), ("det_id", "ascending")])
        n, step, begin = table.num_rows, table["step"].to_numpy().astype(np.int64), table["_slice"][0].as_py() * steps
        label = pc.fill_null(pc.dictionary_encode(table["label"]).combine_chunks().indices, -1).to_numpy()
        confidence, t = table["confidence"].to_numpy(), pc.fill_null(table["t_us"], 0).to_numpy()
        strong = ~(confidence < s.high)
        corners, given = _corners(table["box"])
        before = _predecessors(step, label, strong, corners, given, s)
        inside = (before >= 0) & (step[before] >= begin)
        top = np.where(inside, before, np.arange(n))
        while (top[top] != top).any():
            top = top[top]
        touches = ((before >= 0) & ~inside) | (step == begin + steps - 1) | pc.is_null(table["t_us"]).to_numpy(zero_copy_only=False)
        edge, hope = np.zeros(n, bool), np.zeros(n, bool)
        edge[top[touches]], hope[top[strong]] = True, True
        edge, hope = edge[top], hope[top]
        # The rows of a chain side by side, in order of time.
        order = np.lexsort((step, t, top))
        head, first, hits = np.unique(top[order], return_index=True, return_counts=True)
        last = order[first + hits - 1]
        tail = order[np.maximum(first, first + hits - s.tail_steps)]
        sure = np.flatnonzero(strong[order])
        opening = np.full(n, -1)
        opening[top[order[sure]][::-1]] = order[sure][::-1]
        opening = opening[head]
        span = (t[last] - t[tail]) / 1e6
        pace = []
        for c in (0, 1):
            middle = (corners[c] + corners[c + 2]) / 2
            with np.errstate(all="ignore"):
                pace.append(np.where(span > 0, (middle[last] - middle[tail]) / span, 0.0))
        own = ~edge[head] & (opening >= 0) & (step[head] >= begin)
        spot = np.full(n, -1)
        spot[head[own]] = np.flatnonzero(own)
        kept = np.flatnonzero((step >= begin) & (edge | hope))
        top, spot, over = top[kept], spot[kept], np.where(inside, -1, before)[kept]
        at = lambda rows, known: pa.array(rows, pa.int64(), mask=~known)
        here = spot >= 0
        out = table.select(list(_ROW)).take(pa.array(kept))
        columns = {
            "head_step": table["step"].take(pa.array(top)), "head_det_id": table["det_id"].take(pa.array(top)), "_edge": pa.array(edge[kept]),
            "over_step": table["step"].take(at(over, over >= 0)), "over_det_id": table["det_id"].take(at(over, over >= 0)),
            "hits": at(hits[spot], here), "best": pa.array(np.maximum.reduceat(confidence[order], first)[spot], table["confidence"].type, mask=~here, from_pandas=False),
            "first_t": table["t_us"].take(at(opening[spot], here)), "last_t": table["t_us"].take(at(last[spot], here)),
            "first_box": table["box"].take(at(opening[spot], here)), "last_box": table["box"].take(at(last[spot], here)),
            **{v: pa.array(p[spot], mask=~here, from_pandas=False) for v, p in zip(("vx", "vy"), pace)},
        }
        for name, column in columns.items():
            out = out.append_column(name, column)
        return out

    return run


_ROW = (*NODE, "t_us", "box", "label", "confidence")
_CHAIN = ("source_id", "head_step", "head_det_id")
_TRACKLET = (*_CHAIN, "label", "hits", "best", "first_t", "last_t", "first_box", "last_box", "vx", "vy")


def _linked(dets: DataFrame, s: LinkSettings) -> DataFrame:
    """``_ROW`` of every box with its chain inside its slice, from one shuffle; a slice also sees the last step before it. Chains that end there without a strong box are left out."""
    kinds = {c: dets.schema[c].dataType.simpleString() for c in _ROW}
    here = F.floor(F.col("step") / SLICE_STEPS)
    sliced = dets.select(*_ROW, F.explode(F.when(F.col("step") - here * SLICE_STEPS == SLICE_STEPS - 1, F.array(here, here + 1)).otherwise(F.array(here))).alias("_slice"))
    more = {"head_step": "step", "head_det_id": "det_id", "_edge": "boolean", "over_step": "step", "over_det_id": "det_id", "hits": "long", "best": "confidence"}
    more |= {"first_t": "t_us", "last_t": "t_us", "first_box": "box", "last_box": "box", "vx": "double", "vy": "double"}
    shape = ", ".join(f"{name} {kinds.get(kind, kind)}" for name, kind in ({c: c for c in _ROW} | more).items())
    return sliced.groupBy("source_id", "_slice").applyInArrow(_link_slice(s, SLICE_STEPS), shape)


def _over_slices(edge: DataFrame) -> DataFrame:
    """``_ROW`` of the chains that touch an end of a slice, with their heads over all slices."""
    tops = edge.where((F.col("step") == F.col("head_step")) & (F.col("det_id") == F.col("head_det_id"))).select(*NODE, "over_step", "over_det_id")
    above = edge.select("source_id", F.col("step").alias("over_step"), F.col("det_id").alias("over_det_id"), F.col("head_step").alias("prev_step"), F.col("head_det_id").alias("prev_det_id"))
    nodes = tops.join(above, ["source_id", "over_step", "over_det_id"], "left").select(*NODE, *_END)
    heads = chain_heads(nodes, ["step", "det_id"], list(_END), steps=SLICE_STEPS**2)
    heads = heads.select("source_id", F.col("step").alias("_s"), F.col("det_id").alias("_d"), *_CHAIN[1:])
    rows = edge.select(*_ROW, F.col("head_step").alias("_s"), F.col("head_det_id").alias("_d"))
    return rows.join(heads, ["source_id", "_s", "_d"]).drop("_s", "_d")


def _shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def _tracklets(rows: DataFrame, s: LinkSettings) -> DataFrame:
    """First box, last box and closing velocity of every chain, velocity from its last few steps only.

    A weak box can only carry a track on, so a chain counts from its first strong one.
    """
    chain = ["source_id", "head_step", "head_det_id"]
    since = F.when(F.col("confidence") >= s.high, F.col("t_us"))
    summary = rows.groupBy(*chain, "label").agg(
        F.count(F.lit(1)).alias("hits"), F.max("confidence").alias("best"), F.min(since).alias("first_t"), F.max("t_us").alias("last_t"),
        F.min_by("box", since).alias("first_box"), F.max_by("box", "t_us").alias("last_box"),
    )
    summary = summary.where(F.col("first_t").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*chain).orderBy(F.desc("t_us")))
    tail = rows.withColumn("_k", rank).where(F.col("_k") <= s.tail_steps)
    cx, cy = box_center_x(F.col("box")), box_center_y(F.col("box"))
    span = (F.max("t_us") - F.min("t_us")) / 1e6
    pace = tail.groupBy(*chain).agg(
        F.when(span > 0, (F.max_by(cx, "t_us") - F.min_by(cx, "t_us")) / span).otherwise(0.0).alias("vx"),
        F.when(span > 0, (F.max_by(cy, "t_us") - F.min_by(cy, "t_us")) / span).otherwise(0.0).alias("vy"),
    )
    return summary.join(pace, chain)


def _meet(s: LinkSettings, lost: int, shape: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Heads of a slice with the tails that reach them in time, moved on at their closing pace with their size held, where they overlap enough."""

    def run(heads: pa.Table, tails: pa.Table) -> pa.Table:
        if not heads.num_rows or not tails.num_rows:
            return shape.empty_table()
        heads, tails = heads.sort_by("first_t"), tails.sort_by("last_t")
        first_t, last_t, vx, vy = heads["first_t"].to_numpy(), tails["last_t"].to_numpy(), tails["vx"].to_numpy(), tails["vy"].to_numpy()
        (to, given), (at, whole) = _corners(heads["first_box"]), _corners(tails["last_box"])
        found = []
        for name in pc.unique(tails["_label"]).to_pylist():
            h, t = (np.flatnonzero(pc.equal(side, name).to_numpy()) for side in (heads["label"], tails["_label"]))
            begin, end = (np.searchsorted(first_t[h], last_t[t] + reach, "right") for reach in (0, lost))
            for row, partner in _ranges(begin, np.maximum(end - begin, 0)):
                i, j = h[partner], t[row]
                gap = first_t[i] - last_t[j]
                dx, dy = vx[j] * gap / 1e6, vy[j] * gap / 1e6
                there = [at[0][j] + dx, at[1][j] + dy, at[2][j] + dx, at[3][j] + dy]
                x, y = (there[0] + there[2]) / 2, (there[1] + there[3]) / 2
                overlap = _overlap(there, [c[i] for c in to], given[i] & whole[j])
                near = (x >= 0) & (x <= s.frame_width) & (y >= 0) & (y <= s.frame_height) & ~(overlap < s.iou_high)
                found.append((i[near], j[near], overlap[near]))
        i, j, overlap = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        head, tail = heads.take(pa.array(i)), tails.take(pa.array(j))
        columns = [head["source_id"], head["head_step"], head["head_det_id"], tail["_head_step"], tail["_head_det_id"], head["first_t"], pa.array(first_t[i] - last_t[j]), pa.array(overlap, from_pandas=False)]
        return pa.table(columns, names=shape.names)

    return run


def _stitches(tracklets: DataFrame, s: LinkSettings) -> DataFrame:
    """Which tracklet continues which."""
    lost = us(s.max_lost_s)
    width = BEATS_PER_SLICE * max(lost, 1)
    at = lambda t: F.floor(t / F.lit(width))
    named = tracklets.where("label is not null and first_t is not null")
    alive = named.where((F.col("hits") >= s.min_hits) & (F.col("best") >= s.init))
    # New names: a column that both sides of a cogroup have in common reaches only one of them.
    ids = [F.col(c).alias(f"_{c}") for c in (*_CHAIN, "label")]
    tails = alive.select(*ids, "last_t", "last_box", "vx", "vy", F.explode(F.sequence(at(F.col("last_t")), at(F.col("last_t") + lost))).alias("_slice"))
    heads = named.select(*_CHAIN, "label", "first_t", "first_box", at(F.col("first_t")).alias("_slice"))
    names = zip((*NODE, *_END, "first_t"), (*_CHAIN, *_CHAIN[1:], "first_t"))
    shape = StructType([StructField(name, tracklets.schema[kind].dataType) for name, kind in names]).add("gap", "long").add("iou", "double")
    met = heads.groupBy("source_id", "_slice").cogroup(tails.withColumnRenamed("_slice", "_at").groupBy("_source_id", "_at"))
    return best_pairs(met.applyInArrow(_meet(s, lost, to_arrow_schema(shape)), shape), lost)


def link_tracks(dets: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Published track rows: source_id, step, t_us, det_id, track_id, entity_id, label, box, confidence, hits.

    Detections need ``step``, ``t_us`` and a ``det_id`` unique within their frame. Boxes are shuffled twice, once by slice and once by chain, the second
    time without chains that have no strong box; only those that can be published are numbered. What a step no longer reads is deleted.
    """
    s = settings
    usable = dets.where(F.col("confidence") >= s.low).dropna(subset=list(NODE))
    with settled(_linked(usable, s)) as linked, settled(_over_slices(linked.where("_edge"))) as crossing, settled(_tracklets(crossing, s)) as long_ones:
        tracklets = linked.where("not _edge and first_t is not null").select(*_TRACKLET).unionByName(long_ones.select(*_TRACKLET))
        with settled(_stitches(tracklets, s)) as links:
            first = links.select("source_id", F.col("prev_step").alias("step"), F.col("prev_det_id").alias("det_id")).join(links, list(NODE), "left_anti")
            chained = links.unionByName(first, allowMissingColumns=True)
            roots = chain_heads(chained, ["step", "det_id"], list(_END))
            roots = roots.select("source_id", F.col("step").alias("_s"), F.col("det_id").alias("_d"), F.col("head_step").alias("root_step"), F.col("head_det_id").alias("root_det_id"))
            # A chain too short or too weak counts only where it goes on with another.
            alive = (F.col("hits") >= s.min_hits) & (F.col("best") >= s.init)
            named = tracklets.select(*_CHAIN, "first_t", alive.alias("_alive")).withColumns({"_s": F.col("head_step"), "_d": F.col("head_det_id")})
            wanted = named.join(roots, ["source_id", "_s", "_d"], "left").where(F.col("_alive") | F.col("root_step").isNotNull())
            wanted = wanted.select(*_CHAIN, "first_t", F.coalesce("root_step", "head_step").alias("root_step"), F.coalesce("root_det_id", "head_det_id").alias("root_det_id"))
            boxes = linked.where("not _edge").select(*_ROW, *_CHAIN[1:]).unionByName(crossing)
            with settled(wanted) as wanted:
                rows = settle(boxes.join(wanted, list(_CHAIN)).where(F.col("t_us") >= F.col("first_t")).drop("first_t", *_CHAIN[1:]))
    published = confirm_and_label(rows, s)
    forget(dets.sparkSession, rows)
    return published


def confirm_and_label(rows: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Tracks from the first confident box on, published from their ``min_hits``-th box, numbered per source."""
    s = settings
    root = ["source_id", "root_step", "root_det_id"]
    starts = rows.where(F.col("confidence") >= s.init).groupBy(*root).agg(F.min("step").alias("_from"))
    live = rows.join(starts, root).where(F.col("step") >= F.col("_from"))
    hits = step_ordinal(live, root, ["step"], "hits").withColumn("hits", F.col("hits") + 1)
    named = settle(hits.drop("_from"))
    kept = named.where(F.col("hits") == s.min_hits).select(*root)
    numbered = step_ordinal(kept, ["source_id"], ["root_step", "root_det_id"], "track_id").withColumn("track_id", F.col("track_id") + 1)
    out = named.join(numbered, root).where(F.col("hits") >= s.min_hits)
    entity = F.concat(F.col("label"), F.lit("_"), F.col("track_id"))
    return out.select(*NODE, "t_us", "track_id", entity.alias("entity_id"), "label", "box", "confidence", "hits")


def coast(tracks: DataFrame, frames: DataFrame, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Adds the frames on which a track was not seen but still carried, up to ``max_lost_s``, its box moved on."""
    s = settings
    lost = us(s.max_lost_s)
    key = ["source_id", "track_id"]
    cx, cy = box_center_x(F.col("box")), box_center_y(F.col("box"))
    # The boxes behind a pace are at most so many losses apart, which is the halo a slice needs.
    reach = s.tail_steps * max(lost, 1)
    sliced = with_halo(tracks, "t_us", max(SLICE_US, reach), reach)
    tail = local(key, "t_us").rowsBetween(-(s.tail_steps - 1), 0)
    span = (F.col("t_us") - F.first("t_us").over(tail)) / 1e6
    pace = lambda c: F.when(span > 0, (c - F.first(c).over(tail)) / span).otherwise(0.0)
    paced = drop_halo(sliced.withColumns({"_vx": pace(cx), "_vy": pace(cy), "time_since_update": F.lit(0).cast("long")}))
    seen = settle(paced.drop(SLICE))
    beat = F.floor(F.col("t_us") / F.lit(max(lost, 1))).cast("long")
    carried = seen.withColumn("_beat", F.explode(F.array(beat, beat + 1))).withColumnRenamed("t_us", "_seen_t").withColumnRenamed("step", "_seen_step")
    clock = frames.select("source_id", "step", "t_us").withColumn("_beat", beat)
    met = clock.join(carried, ["source_id", "_beat"]).where((F.col("t_us") > F.col("_seen_t")) & (F.col("t_us") - F.col("_seen_t") <= lost))
    met = met.withColumn("time_since_update", F.col("step") - F.col("_seen_step"))
    # Of all boxes still carried on a frame only the track's latest counts, and only if it was not seen again.
    rest = [c for c in seen.columns if c not in (*key, "step", "t_us")]
    latest = met.groupBy(*key, "step", "t_us").agg(F.max_by(F.struct(*rest, "_seen_t"), "_seen_t").alias("_r")).select(*key, "step", "t_us", "_r.*")
    gap = (F.col("t_us") - F.col("_seen_t")) / 1e6
    moved = latest.withColumn("box", _shifted(F.col("box"), F.col("_vx") * gap, F.col("_vy") * gap)).join(seen.select(*key, "step"), [*key, "step"], "left_anti")
    inside = box_center_x(F.col("box")).between(0, s.frame_width) & box_center_y(F.col("box")).between(0, s.frame_height)
    return seen.unionByName(moved.where(inside).drop("_seen_t")).drop("_vx", "_vy")
