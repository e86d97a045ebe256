"""Scripted scenes as plain rows: what entities do, frame by frame, at 30 frames a second."""

from __future__ import annotations

from pyspark.sql import functions as F

FPS = 30
STEP_US = 1_000_000 // FPS
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
KPS = "array<struct<x:double,y:double,confidence:double>>"
TRACK_ROW = (
    f"source_id string, track_id long, step long, elapsed_us long, t_us long, entity_id string, label string, box {BOX}, "
    f"vx double, vy double, keypoints {KPS}"
)

# Fixed values: (seconds, heights per second, posture, arm raised) per beat.
ACTIVITY_SCENES = {
    "walk": [(1.0, 0.0, "standing", 0), (5.0, 0.7, "standing", 0)],
    "run": [(1.0, 0.0, "standing", 0), (4.0, 2.0, "standing", 0)],
    "loiter": [(3.0, 0.8, "standing", 0), (30.0, 0.0, "standing", 0)],
    "sit_down": [(2.5, 0.0, "standing", 0), (3.0, 0.0, "sitting", 0)],
    "stand_up": [(2.5, 0.0, "sitting", 0), (3.0, 0.0, "standing", 0)],
    "fall": [(3.0, 0.0, "standing", 0), (3.0, 0.0, "lying", 0)],
    "fall_after_standing_a_while": [(12.0, 0.0, "standing", 0), (3.0, 0.0, "lying", 0)],
    "lie_down_slowly": [(3.0, 0.0, "standing", 0), (2.5, 0.0, "crouching", 0), (2.5, 0.0, "sitting", 0), (3.0, 0.0, "lying", 0)],
    "arm_raised": [(2.0, 0.0, "standing", 0), (3.0, 0.0, "standing", 1)],
    "no_pose": [(1.0, 0.0, None, 0), (4.0, 0.7, None, 0)],
    "jitter": [(25.0, 0.03, "standing", 0)],
}
# Activity that each scene's last beat must show after a grace, its moment, and what must never appear.
EXPECTED = {"walk": ("walking", 1.0), "run": ("running", 1.0), "loiter": ("loitering", 22.0), "arm_raised": ("arm_raised", 1.0), "no_pose": ("walking", 1.0), "jitter": ("loitering", 22.0)}
MOMENTS = {"sit_down": "sitting_down", "stand_up": "standing_up", "fall": "falling", "fall_after_standing_a_while": "falling"}
FORBIDDEN = {
    "walk": {"running", "falling", "loitering"},
    "run": {"falling", "loitering"},
    "loiter": {"running", "falling"},
    "sit_down": {"falling", "running", "standing_up"},
    "stand_up": {"falling", "sitting_down"},
    "fall": {"sitting_down", "running"},
    "fall_after_standing_a_while": {"sitting_down"},
    "lie_down_slowly": {"falling"},
    "arm_raised": {"falling", "running"},
    "no_pose": {"falling", "sitting_down", "standing_up", "arm_raised"},
    "jitter": {"walking", "running", "falling", "sitting_down"},
}

# Leg drops in torso lengths (knee, ankle) per posture.
LEGS = {"standing": (0.95, 1.9), "sitting": (0.10, 0.95), "crouching": (0.15, 0.35)}
HEIGHT = 160.0


def skeleton(posture: str, x: float, arm: bool) -> list[dict]:
    torso = HEIGHT * 0.4
    shoulder = 40.0
    side = 0.0
    if posture == "lying":
        hip, side = shoulder + torso * 0.08, torso
        knee, ankle = hip + torso * 0.05, hip + torso * 0.10
    else:
        hip = shoulder + torso
        knee, ankle = (hip + torso * k for k in LEGS[posture])
    at = {i: (0.0, 0.0, 0.0) for i in range(17)}
    for sign, ids in ((-1, (5, 11, 13, 15)), (1, (6, 12, 14, 16))):
        at[ids[0]] = (x + sign * 18.0, shoulder, 0.9)
        at[ids[1]] = (x + sign * 14.0 + side, hip, 0.9)
        at[ids[2]] = (x + sign * 14.0 + side * 1.6, knee, 0.9)
        at[ids[3]] = (x + sign * 14.0 + side * 2.2, ankle, 0.9)
    at[9] = (x - 26.0, shoulder - torso * 0.5 if arm else hip, 0.9)
    at[10] = (x + 26.0, hip, 0.9)
    return [dict(zip(("x", "y", "confidence"), at[i])) for i in range(17)]


def activity_rows(names=None):
    rows = []
    for name in names or ACTIVITY_SCENES:
        x, step = 200.0, 0
        for seconds, speed, posture, arm in ACTIVITY_SCENES[name]:
            for _ in range(round(seconds * FPS)):
                box = {"x1": x - 30.0, "y1": 40.0, "x2": x + 30.0, "y2": 200.0}
                kps = skeleton(posture, x, bool(arm)) if posture else None
                rows.append((name, 1, step, STEP_US, (step + 1) * STEP_US, "person_1", "person", box, speed * HEIGHT, 0.0, kps))
                x += speed * HEIGHT / FPS
                step += 1
    return rows


# Per scene its length, actors (label, path, height, wrist), zones.
SPATIAL_SCENES = {
    "zone_crossing": (6.0, [("person", [(60, 400), (580, 400)], 160, None)]),
    "zone_overlap": (6.0, [("person", [(230, 400)], 160, None)]),
    "two_people_meet": (6.0, [("person", [(80, 400), (280, 400), (280, 400)], 160, None), ("person", [(560, 400), (360, 400), (360, 400)], 160, None)]),
    "two_people_part": (6.0, [("person", [(300, 400), (60, 400)], 160, None), ("person", [(340, 400), (580, 400)], 160, None)]),
    "far_apart": (6.0, [("person", [(60, 400)], 160, None), ("person", [(600, 400)], 160, None)]),
    "walk_past_object": (4.0, [("person", [(60, 400), (600, 400)], 160, None), ("laptop", [(330, 400)], 40, None)]),
    "amble_past_object": (12.0, [("person", [(60, 400), (600, 400)], 160, None), ("laptop", [(330, 400)], 40, None)]),
    "reach_while_walking": (5.0, [("person", [(300, 400), (360, 400)], 160, (330.0, 380.0)), ("laptop", [(330, 400)], 40, None)]),
    "linger_by_object": (6.0, [("person", [(300, 400)], 160, None), ("laptop", [(330, 400)], 40, None)]),
    "reach_for_object": (6.0, [("person", [(300, 400)], 160, (330.0, 380.0)), ("laptop", [(330, 400)], 40, None)]),
}
SPATIAL_EXPECTED = {
    ("two_people_meet", "approaching"), ("two_people_meet", "near"), ("two_people_part", "receding"),
    ("reach_while_walking", "interacting_with"), ("linger_by_object", "interacting_with"), ("reach_for_object", "interacting_with"),
}
SPATIAL_FORBIDDEN = {
    ("two_people_meet", "interacting_with"), ("two_people_part", "approaching"), ("far_apart", "near"), ("far_apart", "approaching"),
    ("far_apart", "interacting_with"), ("walk_past_object", "interacting_with"), ("amble_past_object", "interacting_with"),
}
LEFT_HALF = ("left_half", ((0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)), "area")
DOORWAY = ("doorway", ((0.35, 0.5), (0.65, 0.5), (0.65, 1.0), (0.35, 1.0)), "entrance")
SCENE_ZONES = {"zone_crossing": [DOORWAY], "zone_overlap": [LEFT_HALF, DOORWAY]}
ZONE_EVENTS = {("zone_crossing", "doorway", "entered"), ("zone_crossing", "doorway", "exited"), ("zone_overlap", "left_half", "entered"), ("zone_overlap", "doorway", "entered")}


def _along(path, share):
    if len(path) == 1:
        return float(path[0][0]), float(path[0][1])
    at = share * (len(path) - 1)
    i = min(int(at), len(path) - 2)
    (ax, ay), (bx, by) = path[i], path[i + 1]
    return ax + (bx - ax) * (at - i), ay + (by - ay) * (at - i)


def spatial_rows():
    rows = []
    for name, (seconds, actors) in SPATIAL_SCENES.items():
        total = round(seconds * FPS)
        for step in range(total):
            now, before = step / (total - 1), max(0, step - 1) / (total - 1)
            for track, (label, path, height, wrist) in enumerate(actors, start=1):
                (x, y), (px, py) = _along(path, now), _along(path, before)
                box = {"x1": x - 30.0, "y1": y - height, "x2": x + 30.0, "y2": y}
                kps = None
                if wrist:
                    kps = [{"x": 0.0, "y": 0.0, "confidence": 0.0} for _ in range(17)]
                    kps[9] = {"x": wrist[0], "y": wrist[1], "confidence": 0.9}
                rows.append((name, track, step, STEP_US, (step + 1) * STEP_US, f"{label}_{track}", label, box, (x - px) * FPS, (y - py) * FPS, kps))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, TRACK_ROW).orderBy(F.xxhash64("source_id", "track_id", "step"))
