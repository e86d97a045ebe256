"""Cooldowns against a plain walk, and the reduction of scripted scenes to single events."""

import random

import pytest
from pyspark.sql import functions as F

from scenelake.operators.activity import activities
from scenelake.operators.motion import motion_state
from scenelake.operators.presence import presence_islands
from scenelake.operators.rules import RuleSpec, evaluate_rules, rule_stats
from scenelake.plans.greedy import greedy_spacing
from tests import scenes
from tests.test_scenes import SECOND, doing  # noqa: F401


def walk(rows):
    """Reference: one key at a time, in order."""
    kept, last = set(), {}
    for key, t, gap, tie in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if gap <= 0 or key not in last or t - last[key] >= gap:
            kept.add((key, t, tie))
            last[key] = t
    return kept


@pytest.mark.parametrize("width", [10_000, 40, 11])
def test_greedy_spacing_equals_a_walk(spark, width):
    rng = random.Random(7)
    gaps = {"a": 10, "b": 3, "c": 0, "d": 7}
    rows = []
    for key, gap in gaps.items():
        t = 0
        for i in range(400):
            t += rng.choice([0, 1, 1, 2, 3, 9 if i % 37 == 0 else 1])
            rows.append((key, t, gap, i))
    df = spark.createDataFrame(rows, "k string, t long, gap long, tie long").orderBy(F.xxhash64("tie", "k"))
    got = greedy_spacing(df, ["k"], "t", "gap", ["tie"], width=width).where("kept").collect()
    assert {(r.k, r.t, r.tie) for r in got} == walk(rows)


def test_scenes_reduce_to_single_events(doing):
    found, width = doing
    stats = rule_stats(evaluate_rules(activities=found, width=width), by=["source_id", "rule"]).collect()
    got = {(r.source_id, r.rule): (r.raised, r.suppressed) for r in stats}
    assert got["fall", "fall"] == (1, 45)
    assert got["run", "running"][0] == 1 and abs(got["run", "running"][1] - 72) <= 1
    assert got["loiter", "loitering"][0] == 1 and abs(got["loiter", "loitering"][1] - 283) <= 1
    assert not [k for k in got if k[0] in ("walk", "lie_down_slowly")]


def test_bad_rules_are_refused():
    for bad in ({"type": "nope"}, {"type": "activity", "activity": "flying"}, {"type": "relation"}, {"type": "zone_dwell", "cooldown_s": -1}):
        with pytest.raises(ValueError):
            RuleSpec(**bad)
    assert RuleSpec("zone_entry", zones=("a", "b")).label == "zone_entry:a+b"


def test_rules_of_one_label_must_agree_on_the_cooldown(spark):
    rows = spark.createDataFrame([], "source_id string")
    with pytest.raises(ValueError, match="cooldown"):
        evaluate_rules([RuleSpec(type="activity", activity="running", cooldown_s=10.0), RuleSpec(type="activity", activity="running", cooldown_s=2.0)], activities=rows)
