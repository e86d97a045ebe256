"""Rows that are written carry keypoints only where poses are read."""

from catalog import scene

SMALL = "/root/testdata/sf0.001"


def test_pairs_and_present_rows_leave_the_keypoints_out(spark):
    pairs = scene._pairs(spark, SMALL)
    assert "keypoints" not in pairs.schema["first"].dataType.fieldNames() and "keypoints" not in scene._present(spark, SMALL).columns
    assert "keypoints" in scene._present(spark, SMALL, poses=True).columns
