"""Runs: maximal periodic stretches of the words of a text, found by block convolution.

At scale B (2, 4, 8, ...) the text is dealt into blocks of B words. A run of a period in the scale's
reach has a whole block whose words all come again one period later, so every run shows as a place
where the sum of squared differences between some block and the window after it is zero. Those sums are
exact: number-theoretic transforms modulo a prime give the products, and a sum that is zero is zero
modulo the prime. Each such (block, distance) is a seed that is compared word by word and extended.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRIME, ROOT, ORDER = 2_013_265_921, 31, 27  # 15 * 2**27 + 1 and a generator of its units
SHORTEST = 12
CHUNK_WORDS = 200_000
TRANSFORM_CELLS = 1 << 19
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def scales(words: int) -> Iterator[tuple[int, int, int]]:
    """(block, least, greatest distance) of each scale that a text of so many words can need.

    A run of period q and length L has L - q words that come again q later, at least 6 and at least q; they hold a
    whole block wherever it starts if they number 2 * block - 1.
    """
    block, low = 2, 1
    while 2 * low <= words:
        yield block, low, 4 * block - 2
        block, low = 2 * block, 4 * block - 1


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // PRIME * PRIME


@cache
def _twiddles(size: int) -> list[np.ndarray]:
    """For each halving of a transform of ``size``, the powers of its root."""
    out = []
    while size > 1:
        root, powers = pow(ROOT, (PRIME - 1) // size, PRIME), np.ones(1, np.int64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, _reduced(powers * pow(root, len(powers), PRIME))])
        out.append(powers)
        size //= 2
    return out


def ntt(rows: np.ndarray) -> np.ndarray:
    """Transform of each row modulo the prime; a row's length is a power of two, its places come out bit-reversed."""
    m, size = rows.shape
    if size > 1 << ORDER:
        raise ValueError(f"a period of {size // 4} words or more is out of reach of the transform")
    x = rows
    for powers in _twiddles(size):
        half = len(powers)
        x = x.reshape(m, -1, 2, half)
        low, high = x[:, :, 0], x[:, :, 1]
        up, down = low + high, low - high
        up -= PRIME * (up >= PRIME)
        down += PRIME * (down < 0)
        x = np.stack([up, _reduced(down * powers)], axis=2)
    return x.reshape(m, size)


def inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms, in bit-reversed places, these are."""
    m, size = rows.shape
    x = rows
    for powers in reversed(_twiddles(size)):
        half = len(powers)
        back = np.concatenate([powers[:1], PRIME - powers[:0:-1]])  # powers of the inverse root
        x = x.reshape(m, -1, 2, half)
        low, high = x[:, :, 0], _reduced(x[:, :, 1] * back)
        up, down = low + high, low - high
        up -= PRIME * (up >= PRIME)
        down += PRIME * (down < 0)
        x = np.stack([up, down], axis=2)
    return _reduced(x.reshape(m, size) * pow(size, PRIME - 2, PRIME))


def zero_mismatches(x: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) where the squared differences of a block and what lies that far after it sum to zero.

    Sums are modulo the prime: none is missed, and one that is falsely zero falls to the comparison that follows.
    """
    size = 4 * block
    reach = high - low + block
    step = max(1, TRANSFORM_CELLS // size)
    for at in range(0, len(starts), step):
        own = starts[at : at + step]
        kernel = np.zeros((len(own), size), np.int64)
        kernel[:, :block] = x[own[:, None] + np.arange(block - 1, -1, -1)]  # reversed: the product then correlates
        place = own[:, None] + low + np.arange(reach)
        window = np.zeros((len(own), size), np.int64)
        window[:, :reach] = np.where(place < len(x), x[np.minimum(place, len(x) - 1)], 0)
        cross = inverse_ntt(_reduced(ntt(kernel) * ntt(window)))[:, block - 1 : block + high - low]
        squares = np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(_reduced(window[:, :reach] ** 2), axis=1)], axis=1)
        mine = _reduced(kernel[:, :block] ** 2).sum(axis=1)[:, None]
        sums = mine + squares[:, block:] - squares[:, : high - low + 1] - 2 * cross
        row, shift = np.nonzero(sums - np.floor_divide(sums, PRIME) * PRIME == 0)
        yield own[row], shift + low


def _stretch(x: np.ndarray, at: int, q: int, step: int) -> int:
    """How far from ``at`` on, in direction ``step``, words equal those ``q`` later."""
    done, wide = 0, 64
    while True:
        if step > 0:
            end = min(len(x) - q, at + done + wide)
            same = x[at + done : end] == x[at + done + q : end + q]
        else:
            end = max(0, at - done - wide)
            same = (x[end : at - done] == x[end + q : at - done + q])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += len(same)
        if len(same) < wide:
            return done
        wide *= 2


def find_runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers in 1 .. prime - 1, where no text has more than ``longest``.

    Numbers of different texts differ, so no run crosses from one to the next. A block that has a word which does not
    come again within the scale's reach cannot come again either, and is not transformed.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    again = np.full(n, n)  # distance to the next equal word
    twin = x[order[1:]] == x[order[:-1]]
    again[order[:-1][twin]] = (order[1:] - order[:-1])[twin]
    found: dict[tuple[int, int], int] = {}
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    for block, low, high in scales(longest):
        whole = n // block * block
        starts = np.flatnonzero(again[:whole].reshape(-1, block).max(axis=1) <= high) * block
        seeds = [np.stack(s, axis=1) for s in zero_mismatches(x, starts, block, low, high)]
        seeds = np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)
        seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
        # A seed inside a known run whose period divides its distance belongs to that run.
        inside = (cover_end[seeds[:, 0]] >= seeds.sum(axis=1)) & (seeds[:, 1] % cover_period[seeds[:, 0]] == 0)
        last_q, last_end = 0, 0
        for t, q in seeds[~inside].tolist():
            if q == last_q and t + block <= last_end:
                continue  # in the stretch just extended
            if cover_end[t] >= t + q and q % cover_period[t] == 0:
                continue
            ahead = _stretch(x, t, q, 1)
            if ahead < block:
                continue
            first = t - _stretch(x, t, q, -1)
            last_q, last_end = q, t + ahead
            end = t + ahead + q
            if end - first < max(SHORTEST, 2 * q) or (first, end) in found:
                continue
            found[first, end] = q
            part = cover_end[first:end] < end
            cover_end[first:end][part], cover_period[first:end][part] = end, q
    return sorted((first, end - first, q) for (first, end), q in found.items())


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    """Words and runs of the texts, some ``CHUNK_WORDS`` words (or one longer text) at a time."""
    words: list[list[bytes]] = []
    total = 0
    for k, text in enumerate(texts):
        words.append((text or "").encode().split())
        total += len(words[-1])
        if total >= CHUNK_WORDS or k == len(texts) - 1:
            yield words, _runs_of(words)
            words, total = [], 0


def _runs_of(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    fresh, out, numbered = count(1), [[] for _ in words], []
    for w in words:
        number: dict[bytes, int] = defaultdict(fresh.__next__)
        numbered.append(np.array([number[v] for v in w], np.int64))
    ends = np.cumsum([len(w) for w in words])
    runs = find_runs(np.concatenate(numbered), max(map(len, words)))
    for (start, length, period), k in zip(runs, np.searchsorted(ends, [r[0] for r in runs], "right").tolist(), strict=True):
        out[k].append((start - int(ends[k]) + len(words[k]), length, period))
    return out


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if not runs:
        return b" ".join(words).decode()
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()]).decode()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are what blanks (space, tab to carriage return) divide, numbered from 0. A run is a stretch of at least 12 words and two
    periods with no smaller period, which no neighbour extends. ``collapsed`` is the words joined by single blanks, without those that some
    run holds after its first period. Null, empty and blank texts have no runs and collapse to an empty text. Rows are independent: repeated
    rows and null keys are rows like others; an empty table stays empty; columns named ``runs`` and ``collapsed`` are replaced. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    source = docs if text in kept else docs.withColumnRenamed(text, f"_{text}")
    read = text if text in kept else f"_{text}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, runs in _chunks(batch.column(read).to_pylist()):
                part = batch.slice(at, len(words))
                at += len(words)
                cells = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
                structs = pa.StructArray.from_arrays([pa.array(cells[:, c]) for c in range(3)], ["start", "length", "period"])
                collapsed = pa.array([_without(w, r) for w, r in zip(words, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(ends, structs), collapsed], [*kept, "runs", "collapsed"])

    return source.mapInArrow(run, schema)
