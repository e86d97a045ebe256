"""Operators without SQL, and sliced plans, against plain walks over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import views
from scenelake.operators import assignment, detections, gallery, linking, scoring, stats
from scenelake.operators.presence import presence_islands, step_ordinal
from scenelake.plans.segments import SLICE, carry, hold_state
from tests.test_scenes import SECOND

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def boxes(rng, n, size=60.0, room=200.0):
    out = []
    for _ in range(n):
        x, y, w, h = rng.uniform(0, room), rng.uniform(0, room), rng.uniform(size / 4, size), rng.uniform(size / 4, size)
        out.append((x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("walk_limit", [5_000, 10], ids=["walked", "rounds"])
def test_nms(spark, walk_limit):
    rng = random.Random(3)
    rows, want = [], set()
    for frame, (n, t) in enumerate([(16, 0.3), (30, 0.3), (5, 0.3)]):
        for label in ("person", "laptop"):
            got = boxes(rng, n)
            got += got[: n // 3]  # exact copies
            items = [(i, b, rng.choice([0.5, 0.6, rng.random()])) for i, b in enumerate(got)]
            rows += [("c", frame, i, dict(zip(("x1", "y1", "x2", "y2"), b)), label, s) for i, b, s in items]
            kept = []
            for i, b, s in sorted(items, key=lambda e: (-e[2], e[0])):
                if all(overlap(b, k) <= t for _, k in kept):
                    kept.append((i, b))
            want |= {(frame, label, i) for i, _ in kept}
    df = spark.createDataFrame(rows, f"source_id string, frame_index long, det_id long, box {BOX}, label string, confidence double")
    got = detections.nms(df, 0.3, max_detections=10_000, walk_limit=walk_limit).collect()
    assert {(r.frame_index, r.label, r.det_id) for r in got} == want


def plain_mot(frames, threshold=0.5):
    """Frame by frame with memory of the last pairing."""
    previous, out = {}, set()
    for f, (truth, pred) in enumerate(frames):
        weights = {(o, t): overlap(a, b) for o, a in truth.items() for t, b in pred.items() if overlap(a, b) > 0}
        pairs, used = [], set()
        for o in sorted(truth):
            t = previous.get(o)
            if t in pred and t not in used and weights.get((o, t), 0) >= threshold:
                pairs.append((o, t))
                used.add(t)
        done = {o for o, _ in pairs}
        free = [(o, t, w) for (o, t), w in weights.items() if o not in done and t not in used]
        pairs += [(o, t) for o, t in assignment.best_matching(free).items() if weights[o, t] >= threshold]
        for o, t in pairs:
            previous[o] = t
            out.add((f, o, t))
    return out


def test_match_truth(spark):
    rng = random.Random(11)
    frames = []
    for f in range(300):
        truth = {o: (10.0 * o + rng.uniform(-6, 6), 0.0, 10.0 * o + 30, 60.0) for o in range(6) if rng.random() < 0.8 and (f // 25) % 3 != o % 3}
        if f % 40 < 6:  # far apart, so nothing is contested
            truth = {o: (200.0 * o, 0.0, 200.0 * o + 30, 60.0) for o in truth}
        pred = {100 + (o + f // 60) % 6: (b[0] + rng.uniform(-5, 5), b[1], b[2] + rng.uniform(-5, 5), b[3]) for o, b in truth.items() if rng.random() < 0.9}
        frames.append((truth, pred))
    flat = lambda side: [("c", f, k, dict(zip(("x1", "y1", "x2", "y2"), b))) for f, pair in enumerate(frames) for k, b in pair[side].items()]
    truth = spark.createDataFrame(flat(0), f"source_id string, frame_index long, object_id long, box {BOX}")
    pred = spark.createDataFrame(flat(1), f"source_id string, frame_index long, track_id long, box {BOX}")
    found = scoring.match_truth(truth, pred).persist()
    want = plain_mot(frames)
    assert {(r.frame_index, r.object_id, r.track_id) for r in found.collect()} == want
    m = scoring.clear_mot(truth, pred, matches=found).first()
    last, switches = {}, 0
    for f, o, t in sorted(want):
        switches += o in last and last[o] != t
        last[o] = t
    assert (m.true_positives, m.id_switches, m.ground_truth) == (len(want), switches, truth.count())
    ids = scoring.idf1(truth, pred, found).first()
    assert ids.idtp + ids.idfn == truth.count() and ids.idtp + ids.idfp == pred.count()


def test_assignment_is_the_best_of_all():
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = {(i, j): rng.choice([0.2, 0.5, rng.random()]) for i in range(n) for j in range(m) if rng.random() < 0.7}
        best = max(sum(w.get((i, c), 0) for i, c in enumerate(p)) for p in permutations([*range(m), *[None] * n], n))
        pairs = assignment.best_matching([(i, j, x) for (i, j), x in w.items()])
        assert sum(w[p] for p in pairs.items()) == pytest.approx(best) and len(set(pairs.values())) == len(pairs)


def test_linking_survives_an_occlusion_and_publishes_after_three(spark):
    rows = []
    for s in range(90):
        if not 30 <= s < 60:
            rows.append(("c", s, (s + 1) * 33_333, 1, {"x1": 10.0 + 3 * s, "y1": 100.0, "x2": 70.0 + 3 * s, "y2": 260.0}, "person", 0.9 if s % 4 else 0.2))
        rows.append(("c", s, (s + 1) * 33_333, 2, {"x1": 500.0, "y1": 10.0, "x2": 540.0, "y2": 60.0}, "laptop", 0.4))
    df = spark.createDataFrame(rows, f"source_id string, step long, t_us long, det_id long, box {BOX}, label string, confidence double")
    tracks = linking.link_tracks(df).persist()
    assert {r.entity_id for r in tracks.select("entity_id").distinct().collect()} == {"person_1"}
    assert tracks.agg(F.min("step")).first()[0] == 3 and tracks.count() == 56
    frames = df.select("source_id", "step", "t_us").distinct()
    carried = linking.coast(tracks, frames).where("time_since_update > 0")
    steps = {r.step for r in carried.collect()}
    assert set(range(30, 60)) <= steps


@pytest.mark.parametrize("width", [1_000, 13])
def test_carry_and_hold_state_equal_a_walk(spark, width):
    rng = random.Random(2)
    rows = [(k, t, rng.choice([None, 1, 2, 2]), rng.randint(0, 9)) for k in "ab" for t in sorted(rng.sample(range(400), 150))]
    df = spark.createDataFrame(rows, "k string, t long, m int, x long").orderBy(F.xxhash64("k", "t"))
    got = carry(df, ["k"], ["t"], sums={"s": F.col("x")}, lasts={"l": F.col("m")}, befores={"b": F.col("m")}, tops={"mx": F.col("x")}, width=width).drop(SLICE)
    held = hold_state(df, ["k"], "t", F.col("m"), state="st", since="si", previous="pr", width=width)
    by = {(r.k, r.t): r for r in got.collect()}
    hold = {(r.k, r.t): r for r in held.collect()}
    for key in "ab":
        total, last, top, state, since = 0, None, None, None, None
        for k, t, m, x in (r for r in rows if r[0] == key):
            r, h = by[k, t], hold[k, t]
            assert r.b == last and r.mx == top and h.pr == state
            total += x
            last = m if m is not None else last
            top = x if top is None else max(top, x)
            if m is not None and m != state:
                state, since = m, t
            assert (r.s, r.l, h.st, h.si) == (total, last, state, since)


def test_one_track_with_most_rows_spreads_over_slices(spark):
    long = spark.range(60_000).select(
        F.lit("c").alias("source_id"), F.lit(1).cast("long").alias("track_id"), F.col("id").alias("step"), F.lit(33_333).cast("long").alias("elapsed_us"), ((F.col("id") + 1) * 33_333).alias("t_us"),
    ).where("step % 9000 < 8990")
    out = presence_islands(long, width=60 * SECOND)
    got = {(r.island, r.n) for r in out.groupBy("island").agg(F.count("*").alias("n")).collect()}
    assert got == {(9000 * i, 8990 if i < 6 else 6000) for i in range(7)}


def test_order_of_rows_does_not_matter(spark):
    t = views.tracks(spark, "/root/testdata/sf0.001").select("source_id", "track_id", "step", "elapsed_us", "t_us")
    a = presence_islands(t.orderBy("step")).select("source_id", "track_id", "step", "island")
    b = presence_islands(t.orderBy(F.desc("step"))).select("source_id", "track_id", "step", "island")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_empty_input_keeps_its_columns(spark):
    t = views.tracks(spark, "/root/testdata/sf0.001").where("false")
    out = presence_islands(t)
    assert out.count() == 0 and {"island", "prev_t", "next_t"} <= set(out.columns)


def test_matching_routes_agree_and_an_empty_gallery_knows_nobody(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    names = spark.createDataFrame([(f"n{i:02d}", vec()) for i in range(30)], "name string, template array<double>")
    probes = spark.createDataFrame([(i, vec()) for i in range(200)], "vec_id long, embedding array<double>")
    cols = ["vec_id", "name", "runner_up"]
    a = gallery.match_gallery(probes, names).select(*cols).collect()
    b = gallery.match_gallery(probes, names, block=4).select(*cols).collect()
    assert sorted(a) == sorted(b)
    none = gallery.match_gallery(probes, names.where("false")).select("name", "similarity").distinct().collect()
    assert [tuple(r) for r in none] == [("unknown", 0.0)]


def test_ordinals_and_nearest_rank(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(500)], "source_id string, frame_index long, x long")
    o = step_ordinal(df, ["source_id"], ["frame_index"], width=64)
    assert o.where("step != frame_index").count() == 0
    t = spark.createDataFrame([("s", i, float(i)) for i in range(300)], "stage string, seq long, ms double")
    r = stats.latency_summary(t).first()
    assert (r.samples, r.last_ms, r.p50_ms, r.p95_ms, r.max_ms) == (300, 299.0, 179.0, 287.0, 299.0)
