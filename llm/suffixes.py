"""Blockwise suffix sorting of a text by a difference cover, to a fixed depth.

A difference cover D modulo v has, for any two residues, a shift that brings both into D. Ranks are
precomputed for the cover positions alone (doubling in steps of v stays inside the cover). The suffixes
of a bucket, those that begin with the same v bytes, are then ordered by the ranks of the cover positions
they meet within v bytes: long ties cost a lookup, and only |D| / v of the positions hold a rank.
"""

from __future__ import annotations

import numpy as np

V = 32


def difference_cover(v: int = V) -> np.ndarray:
    """A small set whose differences take every value modulo ``v``, found greedily."""
    cover, seen = [0], {0}
    while len(seen) < v:
        def gain(c: int) -> int:
            return len({(c - d) % v for d in cover} | {(d - c) % v for d in cover} | seen)

        best = max((c for c in range(v) if c not in cover), key=lambda c: (gain(c), -c))
        seen |= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b)."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


class CoverRanks:
    """Ranks of all v-byte prefixes and of the 4v-byte prefixes at cover positions of ``text``."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.zeros(n + 5 * V, np.uint8)
        padded[:n] = text
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 4 * V].copy().view(">u8").ravel()
        one = np.unique(eight, return_inverse=True)[1]
        for step in (8, 16):
            one = _pairs(one, np.append(one[step:], np.zeros(step, one.dtype)))
        self.prefix = one
        at = np.arange(n + 4 * V)
        inside = np.isin(at % V, COVER)
        self.cover = at[inside]
        place = np.cumsum(inside) - 1
        self.before, self.after = place, place + ~inside
        rank = one[self.cover]
        for step in (V, 2 * V):
            shifted = self.cover + step
            ok = shifted < len(at)
            rank = _pairs(rank, np.where(ok, rank[place[np.minimum(shifted, len(at) - 1)]], 0))
        self.rank = rank

    def names(self, start: np.ndarray, depth: int) -> np.ndarray:
        """Equal numbers for suffixes that agree on ``depth`` bytes and start at one residue modulo v, else different ones.

        One residue means one shift into the cover, so a bucket is ordered without comparing pair by pair.

        The v-byte prefix, the first cover position from the start, the last one whose ranked range ends
        inside, and the v-byte prefix that ends at ``depth`` leave no byte out for 4v < depth <= 8v - 24.
        """
        first = self.rank[self.after[start]]
        last = self.rank[self.before[start + depth - 4 * V]]
        outer = _pairs(_pairs(self.prefix[start], first), _pairs(last, self.prefix[start + depth - V]))
        return _pairs(outer, start % V)
