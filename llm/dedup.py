"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

1. Winnowing: of the ``GRAM``-byte grams of a ``length``-byte window the one of least hash is its anchor.
   Equal windows have equal anchors at equal offsets, so a window whose anchor gram occurs once in the
   corpus is not repeated; its suffix is never sorted. The windows of one anchor form one extent.
2. Extents equal in all bytes repeat every window they hold. What is left are anchors met with different
   extents: one copy of each distinct extent goes to the anchor's suffix bucket.
3. Buckets are packed into blocks of bounded size; each block ranks its cover positions and sorts its
   suffixes bucket by bucket to the window's depth (``llm.suffixes``). A bucket of more than
   ``BUCKET`` distinct extents is dealt out window by window instead and counted by Spark, so no task
   holds it; both give the same windows.
4. Repeated windows come back to their documents, where their bytes are joined into runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bytehash import Hashes, mix
from llm.graph import apart
from llm.quality import among
from llm.streams import groups
from llm.suffixes import V, CoverRanks
from scenelake.session import settle

LENGTH = 200
GRAM = 48
BUCKET = 2000
FILTER_BITS = 1 << 24
PART = 1 << 23


def _anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Gram hash, extent hash, anchor place, first and last window start of every anchor of a text of at least ``length`` bytes."""
    h = Hashes(text)
    grams = h.windows(GRAM)
    width, windows = length - GRAM + 1, len(text) - length + 1
    low = (grams & ~np.uint64(PART - 1)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    place = (low[:windows] & np.uint64(PART - 1)).astype(np.int64)
    first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
    last = np.append(first[1:] - 1, windows - 1)
    at = place[first]
    extent = h.ranges(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[at], mix(extent), at, first, last


def _parts(text: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a very long text that together hold each of its windows once."""
    for start in range(0, max(0, len(text) - length + 1), PART - length):
        yield start, text[start : start + PART - 1]


def _bytes(cell: pa.Scalar) -> np.ndarray:
    raw = cell.as_buffer()
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, cell in enumerate(batch.column("text")):
                for start, part in _parts(_bytes(cell), length):
                    gram, extent, at, first, last = _anchors(part, length)
                    row.append(np.full(len(at), i))
                    found.append((gram.view(np.int64), extent.view(np.int64), at + start, first + start, last + start))
            if row:
                take = pa.array(np.concatenate(row))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("print").take(take), *columns], ["doc_id", "print", "gram", "extent", "at", "first", "last"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {id_type}, print long, gram long, extent long, at long, first long, last long")


def _contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(gram, extent, hot, left, bytes): the bytes of one copy of each wanted extent; its anchor stands at ``left``."""
    per_doc = wanted.groupBy("doc_id", "print").agg(F.collect_list(F.struct("gram", "extent", "hot", "at", "first", "last")).alias("wanted"))
    rows = docs.join(per_doc.select(F.col("doc_id").alias("_i"), F.col("print").alias("_p"), "wanted"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("print") == F.col("_p"))).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                text = _bytes(cell)
                out += [(w["gram"], w["extent"], w["hot"], w["at"] - w["first"], text[w["first"] : w["last"] + length].tobytes()) for w in wanted]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["gram", "extent", "hot", "left", "bytes"])

    return rows.mapInArrow(cut, "gram long, extent long, hot boolean, left long, bytes binary").dropDuplicates(["gram", "extent"])


def sort_block(lefts: list[int], texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each extent of a block, which of its windows some other window of the block equals.

    Extents are laid out with their anchors at multiples of the cover's modulus, so windows that can be
    equal start at one residue.
    """
    start, end = [], 0
    for left, text in zip(lefts, texts, strict=True):
        start.append(end + (-(end + left)) % V)
        end = start[-1] + len(text)
    block = np.zeros(end, np.uint8)
    for s, text in zip(start, texts, strict=True):
        block[s : s + len(text)] = np.frombuffer(text, np.uint8)
    count = [len(t) - length + 1 for t in texts]
    names = CoverRanks(block).names(np.concatenate([s + np.arange(n) for s, n in zip(start, count, strict=True)]), length)
    twice = np.bincount(names)[names] > 1
    return np.split(twice, np.cumsum(count)[:-1])


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([[False], flags, [False]])
    turn = np.flatnonzero(padded[1:] != padded[:-1])
    return turn[0::2], turn[1::2]


def _sorted_flags(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, extent, starts, ends): repeated windows as half-open ranges counted from the extent's first."""
    shape = "gram long, extent long, starts array<long>, ends array<long>"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gram"):
            flags = sort_block(table.column("left").to_pylist(), table.column("bytes").to_pylist(), length)
            ranges = [_edges(f) for f in flags]
            columns = [pa.array([r[k] for r in ranges], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("gram", "extent")] + columns, ["gram", "extent", "starts", "ends"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, extent, left, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "extent", "left", "bytes")), strict=True):
                h = Hashes(np.frombuffer(text, np.uint8))
                n = len(text) - length + 1
                step = np.arange(n)
                half = length // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, gram)), pa.array(np.full(n, extent)), pa.array(step), pa.array(h.ranges(step, step + half).view(np.int64)), pa.array(h.ranges(step + half, step + length).view(np.int64)), pa.array(left - step)],
                    ["gram", "extent", "step", "h1", "h2", "offset"],
                )

    usual = contexts.where("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, shape)
    dealt = contexts.where("hot").mapInArrow(windows, "gram long, extent long, step long, h1 long, h2 long, offset long")
    keys = ["gram", "offset", "h1", "h2"]
    twice = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    steps = dealt.join(twice, keys).groupBy("gram", "extent").agg(F.sort_array(F.collect_list("step")).alias("starts"))
    return usual.unionByName(steps.select("gram", "extent", "starts", F.transform("starts", lambda s: s + 1).alias("ends")))


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, print and ``runs``: (start, end) bytes covered by strings of ``length`` bytes that also start elsewhere."""
    # The texts are read twice: an anchor's place costs more to shuffle than to find again, and nearly all anchors are unique.
    again = settle(_occurrences(docs, length).groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"))
    found = among(_occurrences(docs, length), again, "gram", FILTER_BITS)
    met = settle(found.join(apart(again, "gram"), "gram"))
    extents = met.groupBy("gram", "extent").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "print", "at", "first", "last")).alias("one"))
    kinds = extents.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    extents = settle(extents.join(kinds, "gram", "left"))
    wanted = extents.where("kinds > 1").select("gram", "extent", (F.col("kinds") > BUCKET).alias("hot"), "one.*")
    flags = settle(_sorted_flags(_contexts(wanted, docs, length), length))
    ranges = extents.where("n > 1").select("gram", "extent", F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends")).unionByName(
        flags.join(extents.where("n = 1").select("gram", "extent"), ["gram", "extent"], "left_semi").where("size(starts) > 0")
    )
    hit = met.join(ranges, ["gram", "extent"])
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))
    part = F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct((F.col("first") + r["starts"]).alias("start"), (F.col("first") + r["ends"] - 1 + length).alias("end")))
    return hit.select("doc_id", "print", F.when(F.col("starts").isNull(), whole).otherwise(part).alias("r")).groupBy("doc_id", "print").agg(F.flatten(F.collect_list("r")).alias("runs"))


def join_runs(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, ascending."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in runs or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, ``kept`` (the remaining bytes), ``removed`` (start, end of the maximal removed runs), n_bytes and kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts at another place, in this document or
    another; places are judged on the input. Matches never cross documents. Null texts are empty, shorter
    ones are kept whole, repeated rows of ``length`` bytes remove each other, other columns are
    ignored, an empty table gives no rows. ``length`` must be over ``4 v`` and at most ``8 v - 24``.
    """
    if not 4 * V < length <= 8 * V - 24:
        raise ValueError(f"length must be over {4 * V} and at most {8 * V - 24}")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("print", F.xxhash64("text"))
    runs = repeated_runs(source, length).select(F.col("doc_id").alias("_i"), F.col("print").alias("_p"), "runs")
    rows = source.join(runs, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("print") == F.col("_p")), "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, size = [], [], []
            for cell, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                raw = cell.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                spans, at, parts = join_runs(runs), 0, []
                for start, end in spans:
                    parts.append(raw[at:start])
                    at = end
                kept.append(b"".join([*parts, raw[at:]]))
                removed.append([{"start": a, "end": b} for a, b in spans])
                size.append(len(raw))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(removed, span), pa.array(size, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "kept", "removed", "n_bytes", "kept_sha256"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {id_type}, kept binary, removed array<struct<start:long,end:long>>, n_bytes long, kept_sha256 string")
