"""Groups that are matched together stay small, and finding them takes few rounds."""

from scenelake.operators import scoring as sc
from scenelake.plans import components

BOX = "x1 double, y1 double, x2 double, y2 double"


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    written = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda df: written.append(1) or settle(df))
    ids = [(i * 7919) % 400 for i in range(400)]
    out = components.component_of(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")).collect()
    assert len(out) == 400 and {r["component"] for r in out} == {0}
    assert len(written) < 60


def test_objects_contested_apart_are_not_walked_together(spark, monkeypatch):
    truth, pred = [], []
    for frame in range(3):
        for o, x in (("a", 0.0), ("c", 200.0)):
            truth.append(("s", frame, o, (x, 0.0, x + 10, 10.0)))
            pred.append(("s", frame, f"{o}1", (x + 1, 0.0, x + 11, 10.0)))
            if o == "c" or frame != 1:  # a is without a doubt in frame 1, c in none
                pred.append(("s", frame, f"{o}2", (x + 3, 0.0, x + 13, 10.0)))
    truth = spark.createDataFrame(truth, f"source_id string, frame_index long, object_id string, box struct<{BOX.replace(' ', ':').replace(',:', ',')}>")
    pred = spark.createDataFrame(pred, f"source_id string, frame_index long, track_id string, box struct<{BOX.replace(' ', ':').replace(',:', ',')}>")
    linked = []
    found = sc.component_of
    monkeypatch.setattr(sc, "component_of", lambda links: linked.append(found(links)) or linked[-1])
    out = sc.match_truth(truth, pred).select("frame_index", "object_id", "track_id").collect()
    assert sorted(map(tuple, out)) == [(f, o, f"{o}1") for f in range(3) for o in ("a", "c")]
    # Only c's three frames hang together; a's two are walked alone.
    assert [g["count"] for g in linked[0].groupBy("component").count().collect()] == [3]


def test_identities_that_counts_decide_need_no_walk(spark, monkeypatch):
    def never(links):
        raise AssertionError("walked")

    monkeypatch.setattr(sc, "component_of", never)
    # A chain o0-t0-o1-t1-..., each object mostly on its own track: frames are (object, track) pairs.
    seen = [("s", o, t, f) for o in range(30) for t, n in ((o, 5), (o + 1, 2)) for f in range(n)]
    matches = spark.createDataFrame(seen, "source_id string, object_id long, track_id long, frame_index long")
    sides = matches.select("source_id")
    row = sc.idf1(sides, sides, matches).first()
    assert (row["idtp"], row["idfp"], row["idfn"]) == (150, 60, 60)


def test_identities_that_counts_leave_open_are_the_best(spark):
    seen = [("s", o, t, f) for o, t, n in ((0, 0, 3), (0, 1, 2), (1, 0, 2), (1, 1, 0), (2, 2, 9)) for f in range(n)]
    matches = spark.createDataFrame(seen, "source_id string, object_id long, track_id long, frame_index long")
    assert sc.idf1(matches, matches, matches).first()["idtp"] == 13


def test_narrow_slices_share_a_task_and_ids_stay_whole(spark, monkeypatch):
    from scenelake.operators import linking as ln

    run = ln._heads_inside
    counted = spark.sparkContext.accumulator(0)

    def counting(key, parent):
        inner = run(key, parent)

        def each(pdf):
            counted.add(1)
            return inner(pdf)

        return each

    monkeypatch.setattr(ln, "_heads_inside", counting)
    big = 2**60  # ids that a fraction cannot hold
    rows = [("s", i, big + i, i - 1 if i % 50 else None, big + i - 1 if i % 50 else None) for i in range(200)]
    nodes = spark.createDataFrame(rows, "source_id string, step long, det_id long, prev_step long, prev_id long")
    out = ln.chain_heads(nodes, ["step", "det_id"], ["prev_step", "prev_id"], steps=3).collect()
    assert {(r["step"], r["head_step"], r["head_det_id"]) for r in out} == {(i, i - i % 50, big + i - i % 50) for i in range(200)}
    assert counted.value == 1


def test_zone_rules_compute_no_activities(spark, monkeypatch):
    from catalog import scene

    def never(*args, **more):
        raise AssertionError("activities made")

    monkeypatch.setattr(scene.a, "activities", never)
    rules = [r for r in scene.RULES if r.type == "zone_exit"]
    assert set(scene._inputs(spark, "/root/testdata/sf0.001", rules)) == {"visits"}
