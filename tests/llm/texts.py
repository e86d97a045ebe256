"""Small documents with every awkward case, and brute-force twins of the operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int = 0) -> str:
    """``n`` made-up words, the same for the same seed."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfglmnprst"[(x >> k) % 12] + "aeiou"[(x >> (k + 3)) % 5] for k in range(4, 4 + 3 * (1 + x % 3), 3)))
    return " ".join(out)


def documents() -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, a shared passage, a long text, repeated rows and a null id."""
    long, shared = prose(9000, 3), prose(60, 9)
    near = prose(200, 5).split()
    rows = [
        (0, prose(120, 1)), (1, prose(120, 1)), (2, None), (3, ""), (4, " \t\n "), (5, "one two"), (6, "One TWO"), (7, long), (8, long + " tail"),
        (9, " ".join(near)), (10, " ".join([*near[:100], "changed", *near[101:]])), (11, " ".join([*near[:50], "other", *near[51:]])), (12, prose(80, 20) + " " + shared), (13, shared + " " + prose(80, 21)),
        (14, "ab " * 400), (15, "ümläut Ünï " + prose(50, 30)), (16, prose(70, 31)), (16, prose(70, 31)), (None, prose(70, 32)), (None, None), (17, prose(3, 40) + "\n" + "x" * 1500),
    ]
    return [(i, t, "en", "src0" if (i or 0) % 3 else None, None if t is None else len(t)) for i, t in rows]


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows: list[tuple]) -> list[int]:
    """For each row the smallest index it is linked to, by comparing all pairs."""
    sets, parent = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def removed(texts: list[str | None], length: int) -> list[list[bool]]:
    """Which bytes lie in a string of ``length`` bytes that starts at two places."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def turns_by_conversation(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        out[conv].append((role or "", text or ""))
    return out
