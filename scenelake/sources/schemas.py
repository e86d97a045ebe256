"""Stored tables and their fixed schemas."""

OBSERVATIONS = (
    "id long, timestamp timestamp, camera_id string, entity_id string, identity string, entity_type string, motion string, "
    "speed double, posture string, zones array<string>, activities array<string>, frame_index long, elapsed_s double"
)
EVENTS = (
    "id long, timestamp timestamp, camera_id string, rule string, severity string, summary string, entity_id string, identity string, "
    "related_id string, zone string, frame_index long, elapsed_s double, evidence map<string,string>"
)
HEARTBEAT = "camera_id string, timestamp timestamp"
TABLES = {"observations": OBSERVATIONS, "events": EVENTS, "heartbeat": HEARTBEAT}
PARTITIONS = ("camera_id", "dt")
"""Every stored table also carries ``dt``, the date of its timestamp."""
