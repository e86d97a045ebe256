"""Position-free 64-bit hashes of any byte range of a text, by prefix sums in numpy.

With ``S[i]`` the sum of ``T[byte_j] * B**j`` over ``j < i`` (mod 2**64), the range ``a..b`` has the
hash ``mix((S[b] - S[a]) * B**-a)``: one pass over the bytes serves windows of every length.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, int(len(_powers[0]) * 1.5))
        for k, base in enumerate((BASE, _INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Hashes:
    """Prefix sums of one text of bytes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        up, self._down = _powers_to(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[text] * up[:n], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of ``text[i:i+width]`` for every i with a whole window."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and 9 to 13."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = _SPACE[text]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[0::2], turn[1::2]


def lower(text: np.ndarray) -> np.ndarray:
    return _LOWER[text]


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles, A-Z lower-cased.

    A text of fewer words has one, of its whole word sequence; a text without words has none.
    """
    raw = lower(np.frombuffer(text, np.uint8))
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, _U)
    words = Hashes(raw).ranges(start, end)
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, _U)
    for k in range(min(width, len(words))):
        out = out * _U(BASE) + words[k : k + n]
    return np.unique(mix(out))
