import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import graph, jaccard
from tests.llm import texts


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 120), st.sampled_from([50, 80, 100]))
def test_tree_loses_no_pair(seed, n, percent):
    r = np.random.default_rng(seed)
    pool = r.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(r.choice(pool[: r.integers(20, 80)], r.integers(1, 40))) for _ in range(n)]
    tree = jaccard.SignatureTree([jaccard.signature(s) for s in sets], np.array([len(s) for s in sets]))
    got = {(int(a), int(b)) for i, j in tree.pairs(percent) for a, b in zip(i, j, strict=True)}
    for b in range(n):
        for a in range(b):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                assert (a, b) in got


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _expected(rows):
    root = texts.linked(rows)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(root[i]) if s else r[0])) for i, r in enumerate(rows) for s in [texts.shingle_set(r[1])])


def test_components_are_those_of_all_pairs(spark):
    rows = texts.documents()
    base = texts.prose(150, 77).split()
    for i in range(40):  # a chain of near copies, and border cases of similarity
        words = list(base)
        for k in range(i // 4):
            words[(11 * k + i) % 150] = f"w{i}x{k}"
        rows.append((200 + i, " ".join(words), "en", "s", 0))
    df = spark.createDataFrame(rows, texts.SHAPE).withColumnRenamed("lang", "class")
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_components(df).collect())
    assert out == _expected(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    root, sets = texts.linked(rows), [texts.shingle_set(r[1]) for r in rows]
    assert kept.count() == len({g for g, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets)


def test_empty_table(spark):
    empty = spark.createDataFrame([], texts.SHAPE)
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.one_of_each(empty).collect() == []


def _template(n, changed, seed=4):
    """Pages of one 200-word template, ``changed`` words of each replaced by words of their own."""
    base, r = texts.prose(200, seed).split(), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(base)
        for k in r.choice(200, changed[i % len(changed)], replace=False).tolist():
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


def _brute(rows):
    """The smallest linked id of each row, from all pairs, with sets as bits of whole numbers."""
    number: dict = {}
    bits = [sum(1 << number.setdefault(x, len(number)) for x in texts.shingle_set(r[1])) for r in rows]
    size, parent = [b.bit_count() for b in bits], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for j in range(len(rows)):
        for i in range(j):
            both = (bits[i] & bits[j]).bit_count()
            if 100 * both >= 80 * (size[i] + size[j] - both) and root(i) != root(j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {r[0]: rows[root(i)][0] for i, r in enumerate(rows)}


def test_two_thousand_pages_of_one_template(spark):
    rows = _template(2000, (3, 3, 4, 5))
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, texts.SHAPE)).collect()}
    want = _brute(rows)
    assert out == want and 1 < len(set(want.values())) < 2000


def test_walks_hand_on_a_forest_whatever_the_blocks(spark, monkeypatch):
    rows = _template(300, (1, 3, 4)) + [(1000 + r[0], *r[1:]) for r in _template(40, (2,), 8)]
    want = _brute(rows)
    handed = []
    walked = jaccard._walked
    monkeypatch.setattr(jaccard, "_walked", lambda *a: handed.append(walked(*a)) or handed[-1])
    for block in (7, 512):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        handed.clear()
        assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, texts.SHAPE)).collect()} == want
        links = sum(h.count() for h in handed)
        assert len(handed) == 2 and len(rows) - len(set(want.values())) <= links < 2 * len(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 60), st.booleans())
def test_possible_keeps_every_linked_leaf_and_forest_spans(seed, n, two):
    r = np.random.default_rng(seed)
    pool = r.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(r.choice(pool[: r.integers(20, 120)], r.integers(1, 90))) for _ in range(n)]
    component, side = r.integers(0, n, n), r.integers(0, 2, n) if two else np.zeros(n, np.int64)
    two = two and side.min() != side.max()
    linked = [(a, b) for b in range(n) for a in range(b) if component[a] != component[b] and not (two and side[a] == side[b]) and jaccard._reach(sets[a], sets[b], 50)]
    stays = jaccard.possible([jaccard.signature(s) for s in sets], np.array(list(map(len, sets))), component, side, 50)
    assert all(stays[a] and stays[b] for a, b in linked)
    found = jaccard.forest(sets, component, side, 50)
    assert set((min(p), max(p)) for p in found) <= set(linked)

    def parts(pairs):
        parent = {int(c): int(c) for c in component}

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a, b in pairs:
            parent[root(int(component[a]))] = root(int(component[b]))
        return [{c for c in parent if root(c) == root(k)} for k in sorted(parent)]

    assert parts(found) == parts(linked)
