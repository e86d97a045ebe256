"""What moves the clock of contacts on."""

from pyspark.sql import functions as F

from catalog import scene, streams
from scenelake.operators import relations as rel
from scenelake.streaming import stateful as st

SF = "/root/testdata/sf0.001"


def test_pairs_of_two_persons_move_the_clock_of_contacts_on(spark):
    """The row that ends the replay is the first one, here a pair that can be no contact."""
    state = scene._state(spark, SF)
    pairs = rel.pair_join(state.drop("keypoints"))
    alike = (F.lower("first.label") == F.lower("second.label")).cast("int")
    pairs = pairs.coalesce(1).sortWithinPartitions(alike.desc())
    poses = state.where("label = 'person'").select("source_id", "track_id", "step", "t_us", "keypoints")
    touch = rel.RelationSettings(interact_s=0.0, interact_distance=1.4)
    got = streams.drained(st.stream_interaction(streams.replay(streams.timed(pairs), low=-1), streams.replay(streams.timed(poses), 2, track_id=-1).drop("t_us"), touch, lateness="1 hour"))
    rows = lambda df: sorted(map(tuple, df.select("source_id", "step", "subject_track", "object_track", "confidence").collect()))
    want = rows(rel.interaction(rel.pair_history(state), touch))
    assert rows(got) == want and want
