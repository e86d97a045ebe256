"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.rows import packed, unpacked

BINS = 1 << 14


def _nodes(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """The ring bins of all virtual nodes, ascending, and the shard of each."""
    at = [(int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % BINS, s, v) for s in range(shards) for v in range(virtual)]
    at.sort()
    return np.array([a[0] for a in at]), np.array([a[1] for a in at])


def plan_ring(load: np.ndarray, shards: int, virtual: int, slack: float) -> list[tuple[int, int, int, int]]:
    """Cuts (bin, first, end, shard): rows ``first .. end - 1`` of the bin go to the shard.

    A bin belongs to the next virtual node clockwise. First every node's own keys fill its shard, in
    ring order; then what found its shard full continues clockwise to the first shard with room. With
    slack 0 the capacities are the two sizes that differ by one, so they are all met exactly.
    """
    total = int(load.sum())
    size = np.diff([(s * total) // shards for s in range(shards + 1)])
    room = size if slack == 0 else np.full(shards, int(np.ceil((1 + slack) * total / shards)))
    room = room.astype(np.int64).copy()
    at, shard = _nodes(shards, virtual)
    cuts, over = [], []
    for b, node in enumerate(np.searchsorted(at, np.arange(len(load)), side="left") % len(at)):
        n, s = int(load[b]), int(shard[node])
        take = min(n, int(room[s]))
        room[s] -= take
        if take:
            cuts.append((b, 0, take, s))
        if take < n:
            over.append((b, take, n, int(node)))
    for b, first, end, node in over:
        step = 1
        while first < end:
            s = int(shard[(node + step) % len(at)])
            take = min(end - first, int(room[s]))
            room[s] -= take
            if take:
                cuts.append((b, first, first + take, s))
            first += take
            step += 1
    return sorted(cuts)


def shard_rows(rows: DataFrame, key: list[str], shards: int = 16, *, virtual: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    A row lies on the ring at the hash of all its ``key`` columns. The ring is counted in a fixed
    number of bins, and only these counts (``BINS`` longs at most) reach the driver, which walks the
    nodes and returns the cuts: a broadcast of at most bins + nodes * shards rows, whatever the input.
    With slack 0 row counts differ by one at most; with slack e no shard is over (1 + e) times the mean
    and fewer rows leave the shard of their own arc.

    Rows equal in all key columns are interchangeable, nulls hash as nulls, an empty table gives none;
    ``shard`` and ``slot`` replace columns of their name.
    """
    if shards < 1 or virtual < 1 or slack < 0:
        raise ValueError("shards and virtual must be at least 1, slack at least 0")
    spark = rows.sparkSession
    names = [f"key{i}" for i in range(len(key))]
    placed = packed(rows, at=F.xxhash64(*key), **{n: F.col(k) for n, k in zip(names, key, strict=True)})
    placed = placed.withColumn("bin", F.shiftrightunsigned("at", 64 - (BINS.bit_length() - 1)).cast("int"))
    load = np.zeros(BINS, np.int64)
    for r in placed.groupBy("bin").count().collect():
        load[r["bin"]] = r["count"]
    cuts, filled, out = plan_ring(load, shards, virtual, slack), [0] * shards, []
    for b, first, end, s in cuts:
        out.append((b, first, end, s, filled[s] - first))
        filled[s] += end - first
    table = spark.createDataFrame(out or [(-1, 0, 0, 0, 0)], "cut_bin int, first long, end long, shard int, shift long")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy("at", *names)).cast("long") - 1)
    joined = ranked.join(F.broadcast(table), (F.col("bin") == F.col("cut_bin")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return unpacked(joined, rows.columns, shard=F.col("shard"), slot=F.col("rank") + F.col("shift"))
