from pathlib import Path

from catalog.matching import truth_and_pred
from scenelake.operators.scoring import overlaps
from scenelake.plans.components import component_of
from scenelake.session import _settled_folder

SF = "/root/testdata/sf0.001"


def test_components_leave_one_table(spark):
    tables = lambda: set(Path(_settled_folder(spark)).glob("*"))
    before = tables()
    links = spark.range(40).selectExpr("id * 7 % 41 AS a", "(id + 1) * 7 % 41 AS b")
    out = component_of(links)
    assert {r["component"] for r in out.collect()} == {0}
    assert len(tables() - before) == 1


def test_boxes_of_both_sides_are_shuffled_once(spark):
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        plan = overlaps(*truth_and_pred(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(broadcast, before)
    assert plan.count("Exchange hashpartitioning") == 2
