"""Byte-level BPE as a monoid: halves are encoded on their own and joined where they meet.

A token sequence is the encoding of its bytes exactly when every two neighbours are the encoding of
theirs: up to the first merge over a boundary, the merges beside it are those that the two tokens
alone would make. So the encodings of two halves are joined by encoding a window of the last tokens of
one and the first of the other. When the window's outermost tokens come out as they went in, every
pair outside it is as before and nothing further can change; until then the side that failed grows.

Texts are trees of the same kind over the matches of a split pattern: a text is halved anywhere, and
matches are found anew from the last two of the left half until they end where one of the right half
does. What a match holds depends on nothing before it, so from there on the right half's stand.
Decoding concatenates bytes up a tree.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF_CHARS = 8192
LEAF_IDS = 4096
MEMO_MATCHES = 300_000
MEMO_JOINS = 100_000
MEMO_CHARS = 64
SHORT_BYTES = 9
HEAP_BYTES = 256
NONE = 1 << 31
BATCH_BYTES = 4_000_000
CUTS = [[c for c in (n // 2, n // 2 + 1, n // 2 - 1, n // 2 + 2, n // 2 - 2) if 0 < c < n] for n in range(2 * SHORT_BYTES)]

Part = tuple[list[str], list[bytes]]  # matches of a text, and the ids of each as packed 32-bit integers


class _Memory(dict):
    """Ids of matches; one that is not there is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        return self.encode(text)


class Coder:
    """One rank file and one split pattern. Every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pair = lru_cache(MEMO_JOINS)(lambda x, y: self._merge(self.bytes_of[x] + self.bytes_of[y]))
        self.apart = lru_cache(MEMO_JOINS)(self._apart)
        self.sides: dict[int, tuple[int, int]] = {}
        self.short = lru_cache(MEMO_JOINS)(self._halves)
        self.window = lru_cache(MEMO_JOINS)(self._merge)
        self.memo, self.older = _Memory(self.match), {}

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the lowest rank, leftmost first, until no two neighbours have one."""
        if len(raw) > HEAP_BYTES:
            return self._merge_long(raw)
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        pairs = [rank(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(both + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + both, NONE)
        return tuple(map(self.ranks.__getitem__, parts))

    def _sides(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins; a single byte is its own."""
        raw = self.bytes_of[token]
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        while len(parts) > 2:
            pairs = [rank(x + y, NONE) for x, y in pairwise(parts)]
            i = pairs.index(min(pairs))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.sides[token] = out = self.ranks[parts[0]], self.ranks[parts[-1]]
        return out

    def _apart(self, x: int, y: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes.

        Merges are undone from the highest rank down, on the side whose merge is the later: the two stay apart unless what then
        meets at the boundary has a lower rank than the merge undone last, and so would have been joined before it.
        """
        of, rank, sides, latest = self.bytes_of, self.ranks.get, self.sides, NONE
        while rank(of[x] + of[y], NONE) >= latest:
            for left in (x > y, x <= y):
                here = x if left else y
                part = (sides.get(here) or self._sides(here))[left]
                if part != here:
                    break
            else:
                return True
            if left:
                x, latest = part, here
            else:
                y, latest = part, here + 1  # of equal ranks the left one is joined first
        return False

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and the ends of the parts, for windows that have grown."""
        n, rank = len(raw), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here
        queue = [(r, i) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            r, i = heappop(queue)
            mid = ends[i]
            if mid in (0, n) or rank(raw[i : ends[mid]]) != r:
                continue  # one of the two has been merged since
            end = ends[i] = ends[mid]
            ends[mid] = 0
            if end < n:
                before[end] = i
                if (r := rank(raw[i : ends[end]])) is not None:
                    heappush(queue, (r, i))
            if i and (r := rank(raw[before[i] : end])) is not None:
                heappush(queue, (r, before[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded strings, neither of them empty, put together."""
        i = j = 1
        mid = self.pair(a[-1], b[0])
        while True:
            wide_a = i < len(a) and mid[0] != a[-i]
            wide_b = j < len(b) and mid[-1] != b[j - 1]
            if not wide_a and not wide_b:
                return a[: len(a) - i] + mid + b[j:]
            i = min(len(a), 2 * i) if wide_a else i
            j = min(len(b), 2 * j) if wide_b else j
            raw = b"".join(map(self.bytes_of.__getitem__, a[len(a) - i :] + b[:j]))
            mid = self.window(raw) if len(raw) < SHORT_BYTES else self._merge(raw)

    def _halves(self, raw: bytes) -> tuple[int, ...]:
        n = len(raw)
        if n == 1:
            return (self.ranks[raw],)
        half = n // 2
        tree = self.short if half < SHORT_BYTES else self._halves
        if n < 2 * SHORT_BYTES:  # a cut between two tokens needs no window: one near the middle is looked for
            for cut in CUTS[n]:
                a, b = tree(raw[:cut]), tree(raw[cut:])
                if self.apart(a[-1], b[0]):
                    return a + b
        return self.join(tree(raw[:half]), tree(raw[half:]))

    def match(self, text: str) -> bytes:
        """Ids of one match of the split pattern; one that is a token whole is that token.

        Short matches are remembered in two generations, so frequent ones stay when the memory is full.
        """
        ids = self.memo.get(text) or self.older.get(text)  # get does not encode
        if ids is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            ids = array("i", self._halves(raw) if whole is None else (whole,)).tobytes()
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_MATCHES:
                self.older, self.memo = dict(self.memo), _Memory(self.match)
            self.memo[text] = ids
        return ids

    def _meet(self, a: Part, b: Part) -> Part:
        """Two encoded texts put together."""
        (am, ac), (bm, bc) = a, b
        keep = max(0, len(am) - 2)  # a match looks one character past its end, after a quote up to two: the last two may change
        take = 2
        while True:
            window = am[keep:] + bm[:take]
            new = self.split("".join(window))
            if take >= len(bm):
                stop, tail = len(new), len(bm)
                break
            ours, theirs = _ends(new[:-2]), _ends(window)
            known = {e: k + 1 for k, e in enumerate(theirs) if k + 1 >= len(am) - keep}
            meet = next((k for k, e in enumerate(ours) if e in known), None)
            if meet is not None:
                stop, tail = meet + 1, known[ours[meet]] - (len(am) - keep)
                break
            take *= 2
        whole = am[-1] + bm[0] if am and bm else None
        codes = [
            array("i", self.join(*(tuple(array("i", c)) for c in (ac[-1], bc[0])))).tobytes() if m == whole and len(m) > MEMO_CHARS else self.match(m)
            for m in new[:stop]
        ]
        return am[:keep] + new[:stop] + bm[tail:], ac[:keep] + codes + bc[tail:]

    def _text(self, text: str) -> Part:
        if len(text) <= LEAF_CHARS:
            matches = self.split(text)
            return matches, list(map(self.memo.__getitem__, matches))
        half = len(text) // 2
        return self._meet(self._text(text[:half]), self._text(text[half:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(self._text(text or "")[1]), "<i4")

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of ids; an id without a token is an error."""
        look = self.bytes_of.__getitem__
        level = [b"".join(map(look, ids[i : i + LEAF_IDS])) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def _ends(matches: list[str]) -> list[int]:
    return np.cumsum([len(m) for m in matches]).tolist()


@cache
def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file: a line per token, its base64 bytes and its rank."""
    with open(path, "rb") as f:
        return Coder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose ``column`` holds some ``BATCH_BYTES``, or one row that is larger."""
    for batch in batches:
        kept = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(kept) if pa.types.is_string(kept.type) else pc.multiply(pc.list_value_length(kept), 4), 0)
        at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for first, end in pairwise(cuts):
            yield batch.slice(first, end - first)


def _mapped(docs: DataFrame, source: str, out: str, kind: T.DataType, make) -> DataFrame:
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, source):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), make(rows.column(source))], [*kept, out])

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text, each match of ``pattern`` encoded separately.

    A null or empty text has an empty array; texts and matches of any length are encoded whole. Rows are
    independent: repeated rows and null keys are rows like others, an empty table stays empty. A column
    named ``out`` is replaced. No shuffle.
    """

    def make(texts: pa.Array) -> pa.Array:
        own = coder(ranks, pattern)
        ids = [own.encode(t) for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return _mapped(docs, text, out, T.ArrayType(T.IntegerType()), make)


def decode_ids(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each array of ids; null is empty, an id (or null) without a token fails. A column named ``out`` is replaced."""

    def make(arrays: pa.Array) -> pa.Array:
        own = coder(ranks, pattern)
        return pa.array([own.decode(a.values.to_pylist() if a.is_valid else ()) for a in arrays], pa.binary())

    return _mapped(docs, ids, out, T.BinaryType(), make)
