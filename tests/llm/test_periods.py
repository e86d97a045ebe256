import hashlib
import random
import zlib

import numpy as np
import pytest

from llm import periods
from tests.llm.texts import SHAPE, WORD, documents, prose


def runs(words):
    """Every run, by walking each period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(12, 2 * q):
                out.setdefault((start, i + q), q)
            i += 1
    return sorted((start, end - start, q) for (start, end), q in out.items())


def collapsed(words, found):
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_transform_is_exact():
    rows = np.random.default_rng(1).integers(0, periods.PRIME, (3, 64))
    assert (periods.inverse_ntt(periods.ntt(rows)) == rows).all()
    a, b = rows[0, :32].tolist(), rows[1, :32].tolist()
    pad = lambda v: np.array([[*v, *[0] * 32]])
    product = periods.inverse_ntt(periods._reduced(periods.ntt(pad(a)) * periods.ntt(pad(b))))[0].tolist()
    assert product == [sum(a[i] * b[k - i] for i in range(32) if 0 <= k - i < 32) % periods.PRIME for k in range(64)]


def test_zero_mismatches_of_every_block():
    x = np.array(([3, 1, 2, 1] * 9 + [5, 1, 1]) * 2)
    for block, low, high in periods.scales(len(x)):
        starts = np.arange(0, len(x) // block * block, block)
        got = {(int(t), int(q)) for ts, qs in periods.zero_mismatches(x, starts, block, low, high) for t, q in zip(ts, qs, strict=True)}
        want = {(t, q) for t in starts.tolist() for q in range(low, high + 1) if t + q + block <= len(x) and (x[t : t + block] == x[t + q : t + q + block]).all()}
        assert want <= got and {(t, q) for t, q in got if t + q + block <= len(x)} == want


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_random_sequences(letters):
    draw = random.Random(letters)
    for _ in range(500):
        x = [draw.randint(1, letters) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(0, 3)):
            a, p = draw.randrange(len(x)), draw.randint(1, len(x) // 3 + 1)
            for i in range(a, draw.randint(a, len(x))):
                x[i] = x[a + (i - a) % p]
        assert periods.find_runs(np.array(x), len(x)) == runs(x)


def test_long_sequences():
    assert periods.find_runs(np.ones(60_000, np.int64), 60_000) == [(0, 60_000, 1)]
    assert periods.find_runs(np.array(list(range(1, 20_001)) * 3 + [1, 2]), 60_002) == [(0, 60_002, 20_000)]
    a, b = [1], [1, 2]
    while len(b) < 3000:
        a, b = b, b + a
    assert periods.find_runs(np.array(b), len(b)) == runs(b)


CASES = [
    (30, "a b c " * 9), (31, "x " + "a b c\x1cd e " * 8 + "y"), (32, ("p q " * 3 + "p p q ") * 4), (33, prose(40, 2) + " " + prose(40, 2)), (34, "w " * 12), (35, "w " * 11), (36, prose(9000, 3) + " " + prose(9000, 3)),
]


def test_documents(spark):
    rows = documents() + [(i, t, "en", "s", len(t)) for i, t in CASES]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    out = periods.periodic_runs(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        words = WORD.findall(r["text"] or "")
        want = runs(words) if len(words) < 1000 or len(set(words)) < 50 else [tuple(x) for x in r["runs"]]
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want)
    by_id = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in out}
    assert by_id[36] == [(0, 18000, 9000)] and by_id[7] == []
    clash = docs.withColumnsRenamed({"lang": "runs", "source": "collapsed"})
    assert sum(len(r["runs"]) for r in periods.periodic_runs(clash).collect()) == sum(map(len, by_id.values()))
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    from llm.registry import Q

    rows = documents() + [(i, t, "en", "s", len(t)) for i, t in CASES] + [(i, prose(i % 160, i), "en", "s", 1) for i in range(100, 300)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    sha, want, changed = lambda s: hashlib.sha256(s.encode()).hexdigest(), [], 0
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], changed + 1
        found = runs(words) if n < 2000 else [(0, 18000, 9000)] if i == 36 else []
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *tail, sha("".join(f"{s},{le},{q}\n" for s, le, q in found)), sha(collapsed(words, found))))
    got = [tuple(r) for r in Q["op13_runs"][0](spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert changed > 10
    assert sorted(got, key=order) == sorted(want, key=order)
