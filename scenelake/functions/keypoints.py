"""Keypoint expressions. A skeleton is an array of struct(x, y, confidence), 17 long, or 12 without the face."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.boxes import box_height, margin, tilt_from_vertical

# Positions in the 17-point layout, the face points coming first.
FACE_POINTS = 5
LEFT_SHOULDER, RIGHT_SHOULDER = 5, 6
LEFT_WRIST, RIGHT_WRIST = 9, 10
LEFT_HIP, RIGHT_HIP = 11, 12
LEFT_KNEE, RIGHT_KNEE = 13, 14
LEFT_ANKLE, RIGHT_ANKLE = 15, 16
POSTURES = ("standing", "sitting", "crouching", "lying", "unknown")

LYING_ANGLE = 55.0
EXTENDED = 0.55
MIN_TORSO = 0.12


def joint(kps: Column, index: int) -> Column:
    """One landmark by its 17-point index, from either layout; null where absent."""
    shift = F.when(F.size(kps) == 17 - FACE_POINTS, index - FACE_POINTS + 1).otherwise(index + 1)
    return F.when(shift >= 1, F.try_element_at(kps, shift))


def seen(kps: Column, index: int, min_conf: float) -> Column:
    j = joint(kps, index)
    return F.when(j["confidence"] >= min_conf, j)


def keypoint_mid(left: Column, right: Column) -> Column:
    """Midpoint of a pair with the weaker confidence, or the one side that was seen."""
    both = F.struct(
        ((left["x"] + right["x"]) / 2).alias("x"),
        ((left["y"] + right["y"]) / 2).alias("y"),
        F.least(left["confidence"], right["confidence"]).alias("confidence"),
    )
    return F.when(left.isNotNull() & right.isNotNull(), both).otherwise(F.coalesce(left, right))


def visible_count(kps: Column, min_conf: float) -> Column:
    return F.size(F.filter(kps, lambda k: k["confidence"] >= min_conf))


def pose_confidence(kps: Column) -> Column:
    """Mean landmark confidence, 0 for an empty skeleton."""
    total = F.aggregate(kps, F.lit(0.0), lambda s, k: s + k["confidence"])
    return F.when(F.size(kps) > 0, total / F.size(kps)).otherwise(0.0)


def drop_face_keypoints(kps: Column) -> Column:
    return F.when(F.size(kps) == 17, F.slice(kps, FACE_POINTS + 1, 17 - FACE_POINTS)).otherwise(kps)


def arm_confidence(kps: Column, min_conf: float = 0.3) -> Column:
    """Weaker joint of the better raised arm; 0 when no wrist is above its shoulder."""

    def side(wrist: int, shoulder: int) -> Column:
        w, s = seen(kps, wrist, min_conf), seen(kps, shoulder, min_conf)
        return F.when(w["y"] < s["y"], F.least(w["confidence"], s["confidence"]))

    best = F.greatest(side(LEFT_WRIST, LEFT_SHOULDER), side(RIGHT_WRIST, RIGHT_SHOULDER))
    return F.coalesce(best, F.lit(0.0))


def wrist_inside(kps: Column, b: Column, min_conf: float = 0.35) -> Column:
    """Either wrist landmark within the box, edges included."""

    def hit(index: int) -> Column:
        w = seen(kps, index, min_conf)
        return F.coalesce(w["x"].between(b["x1"], b["x2"]) & w["y"].between(b["y1"], b["y2"]), F.lit(False))

    return hit(LEFT_WRIST) | hit(RIGHT_WRIST)


def with_posture(df: DataFrame, keypoints: str = "keypoints", box: str = "box", min_conf: float = 0.3) -> DataFrame:
    """Adds posture, posture_confidence and posture_reason from torso tilt and how far the legs drop.

    Reasons are codes: torso_missing, foreshortened, tilted, no_knees, legs_extended, no_ankles,
    shank_extended, folded. Computed in stages, so each measurement is worked out once per row.
    """
    kps = F.col(keypoints)

    def mid(left: int, right: int) -> Column:
        return keypoint_mid(seen(kps, left, min_conf), seen(kps, right, min_conf))

    shoulder, hip, knee, ankle = (F.col(f"_{n}") for n in ("shoulder", "hip", "knee", "ankle"))
    out = df.withColumns(
        {
            "_shoulder": mid(LEFT_SHOULDER, RIGHT_SHOULDER),
            "_hip": mid(LEFT_HIP, RIGHT_HIP),
            "_knee": mid(LEFT_KNEE, RIGHT_KNEE),
            "_ankle": mid(LEFT_ANKLE, RIGHT_ANKLE),
        }
    )
    dx, dy = hip["x"] - shoulder["x"], hip["y"] - shoulder["y"]
    out = out.withColumns({"_torso": F.hypot(dx, dy), "_tilt": tilt_from_vertical(dx, dy), "_sure": F.least(shoulder["confidence"], hip["confidence"])})
    torso = F.when(F.col("_torso") > 0, F.col("_torso"))
    out = out.withColumns({"_thigh": (knee["y"] - hip["y"]) / torso, "_shank": (ankle["y"] - knee["y"]) / torso})
    tilt, sure, thigh, shank = (F.col(f"_{n}") for n in ("tilt", "sure", "thigh", "shank"))
    reason = (
        F.when(shoulder.isNull() | hip.isNull(), "torso_missing")
        .when(F.col("_torso") < MIN_TORSO * F.greatest(box_height(F.col(box)), F.lit(1.0)), "foreshortened")
        .when(tilt >= LYING_ANGLE, "tilted")
        .when(knee.isNull(), "no_knees")
        .when(thigh >= EXTENDED, "legs_extended")
        .when(ankle.isNull(), "no_ankles")
        .when(shank >= EXTENDED, "shank_extended")
        .otherwise("folded")
    )
    out = out.withColumn("posture_reason", reason)
    why = F.col("posture_reason")
    with_knee = F.least(sure, knee["confidence"])
    with_ankle = F.least(with_knee, ankle["confidence"])
    posture = F.when(why == "tilted", "lying").when(why == "legs_extended", "standing").when(why == "shank_extended", "sitting").when(why == "folded", "crouching")
    confidence = (
        F.when(why == "tilted", sure * margin(tilt, LYING_ANGLE, 25.0))
        .when(why == "legs_extended", with_knee * margin(thigh, EXTENDED, 0.35))
        .when(why.isin("shank_extended", "folded"), with_ankle * margin(shank, EXTENDED, 0.35))
    )
    out = out.withColumns({"posture": F.coalesce(posture, F.lit("unknown")), "posture_confidence": F.coalesce(confidence, F.lit(0.0))})
    return out.drop("_shoulder", "_hip", "_knee", "_ankle", "_torso", "_tilt", "_sure", "_thigh", "_shank")
