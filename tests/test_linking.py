import random

from scenelake.operators.linking import association_candidates, chain_heads, pair_frames
from scenelake.plans.components import component_of


def test_pairing_goes_on_until_no_pair_is_open(spark):
    """Each box waits for the one before it to be paired, four rounds deep, in either band."""
    before, after = (200, 184, 152, 104), (202, 194, 170, 130)
    for confidence in (0.9, 0.2):
        rows = [("s", 0, i, "person", (float(x), 0.0, x + 100.0, 100.0), 0.9) for i, x in enumerate(before)]
        rows += [("s", 1, i, "person", (float(x), 0.0, x + 100.0, 100.0), confidence) for i, x in enumerate(after)]
        dets = spark.createDataFrame(rows, "source_id string, step long, det_id long, label string, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double")
        assert sorted((r["det_id"], r["prev_id"]) for r in pair_frames(association_candidates(dets)).collect()) == [(i, i) for i in range(4)]


def test_no_pair_at_all(spark):
    dets = spark.createDataFrame([("s", 0, 0, "person", (0.0, 0.0, 1.0, 1.0), 0.9)], "source_id string, step long, det_id long, label string, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double")
    assert pair_frames(association_candidates(dets)).collect() == []


def test_heads_of_chains_of_any_length_and_slice(spark):
    draw, parent = random.Random(5), {}
    for source in ("a", "b"):
        last = [(0, i) for i in range(6)]
        for step in range(1, 60):
            for i in range(6):
                up = last[i] if draw.random() < 0.93 else None
                parent[source, step, i] = up
                last[i] = (step, i) if draw.random() < 0.9 else last[i]
                if last[i] != (step, i):
                    del parent[source, step, i]
        parent |= {(source, 0, i): None for i in range(6)}

    def head(node):
        while parent[node] is not None:
            node = (node[0], *parent[node])
        return node

    rows = [(*k, *(p or (None, None))) for k, p in parent.items()]
    nodes = spark.createDataFrame(rows, "source_id string, step long, det_id long, prev_step long, prev_id long").repartition(5)
    for steps in (1, 4, 256):
        got = {(r["source_id"], r["step"], r["det_id"]): (r["source_id"], r["head_step"], r["head_det_id"]) for r in chain_heads(nodes, ["step", "det_id"], ["prev_step", "prev_id"], steps=steps).collect()}
        assert got == {k: head(k) for k in parent}
    assert chain_heads(nodes.limit(0), ["step", "det_id"], ["prev_step", "prev_id"]).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in component_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(20)}
