"""Scripted scenes with known answers, positives and negatives, through the real operators."""

import pytest
from pyspark.sql import functions as F

from scenelake.functions.keypoints import arm_confidence, with_posture
from scenelake.operators.activity import activities, rising_edges
from scenelake.operators.motion import motion_state
from scenelake.operators.presence import presence_islands
from scenelake.operators.relations import relations
from scenelake.operators.zones import Zone, crossings, zone_visits
from tests import scenes

SECOND = 1_000_000


@pytest.fixture(scope="module", params=[3600, 7], ids=["one-slice", "many-slices"])
def doing(spark, request):
    width = request.param * SECOND
    rows = scenes.table(spark, scenes.activity_rows())
    arm = F.when(F.col("keypoints").isNotNull(), arm_confidence(F.col("keypoints")))
    rows = with_posture(rows).withColumns(
        {
            "arm_confidence": F.coalesce(arm, F.lit(0.0)),
            "arm_raised": F.coalesce(arm, F.lit(0.0)) > 0,
        }
    )
    state = motion_state(presence_islands(rows, width=width), width=width)
    return activities(state, width=width).persist(), width


def test_expected_activities_hold(doing):
    got = {(r.source_id, r.step, r.activity) for r in doing[0].collect()}
    for name, (wanted, grace) in scenes.EXPECTED.items():
        beats = scenes.ACTIVITY_SCENES[name]
        start = sum(round(b[0] * scenes.FPS) for b in beats[:-1])
        scored = range(start + round(grace * scenes.FPS), start + round(beats[-1][0] * scenes.FPS))
        hits = sum((name, step, wanted) in got for step in scored)
        assert hits == len(scored), (name, hits, len(scored))


def test_forbidden_never_fires(doing):
    seen = {(r.source_id, r.activity) for r in doing[0].select("source_id", "activity").distinct().collect()}
    for name, banned in scenes.FORBIDDEN.items():
        assert not [a for a in banned if (name, a) in seen], name


def test_each_moment_happens_once(doing):
    edges = rising_edges(doing[0], width=doing[1]).where(F.col("activity").isin("falling", "sitting_down", "standing_up"))
    got = sorted((r.source_id, r.activity) for r in edges.collect() if r.source_id in scenes.MOMENTS)
    assert got == sorted(scenes.MOMENTS.items())


def test_fall_is_reported_for_its_hold_and_soon(doing):
    fall = doing[0].where("source_id = 'fall' and activity = 'falling'")
    row = fall.agg(F.count("*").alias("n"), F.min("step").alias("first")).first()
    assert row.n == 46
    assert (row.first - 3 * scenes.FPS) / scenes.FPS <= 0.44


@pytest.fixture(scope="module", params=[3600, 7], ids=["one-slice", "many-slices"])
def scene(spark, request):
    width = request.param * SECOND
    rows = scenes.table(spark, scenes.spatial_rows())
    return motion_state(presence_islands(rows, width=width), width=width), width


def test_relations_of_the_scenes(scene):
    tracks, width = scene
    found = relations(tracks, width=width).groupBy("source_id", "relation").agg(F.max("confidence").alias("c"), F.count("*").alias("n")).collect()
    seen = {(r.source_id, r.relation): r.c for r in found}
    assert scenes.SPATIAL_EXPECTED <= set(seen)
    assert not scenes.SPATIAL_FORBIDDEN & set(seen)
    assert seen["reach_for_object", "interacting_with"] == 0.85
    assert seen["linger_by_object", "interacting_with"] == 0.4


def test_zone_events_of_the_scenes(scene):
    tracks, width = scene
    got = set()
    for name, zones in scenes.SCENE_ZONES.items():
        visits = zone_visits(tracks.where(F.col("source_id") == name), [Zone(n, p, k) for n, p, k in zones], width=width)
        got |= {(r.source_id, r.zone, r.event) for r in crossings(visits).select("source_id", "zone", "event").distinct().collect()}
    assert got == scenes.ZONE_EVENTS
