"""Motion, relations, activities and cooldowns on streams.

A key's rows wait in its state until the watermark has passed them, so order within the allowed lateness
does not matter. What is then complete is processed as whole arrays, in the batch operators' terms: runs
that lasted long enough, dead bands held from the last marker, trailing windows by binary search. State
holds the waiting rows, the rows a trailing window can still reach, and a few scalars of the presence.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scenelake.functions.clock import us
from scenelake.functions.keypoints import wrist_inside
from scenelake.operators.activity import MAJORITY, POSTURE_MAJORITY, STABLE_POSTURES, WINDOW_COVERAGE, ActivitySettings
from scenelake.operators.motion import MotionSettings
from scenelake.operators.relations import RelationSettings, person_object_pairs
from scenelake.operators.zones import HOLD_S, Zone, zone_hits

LATENESS = "10 seconds"
RUN_ROWS, BLOCK_ROWS = 65_536, 4_096
"""Rows a key may hold loose before they are packed away, and in a packed block."""

Complete = Callable[[dict, pd.DataFrame], pd.DataFrame]


def _rows_of(cols: dict) -> int:
    return len(cols["_ms"])


def _taken(cols: dict, which) -> dict:
    return {c: x[which] for c, x in cols.items()}


def _joined(parts: Sequence[dict]) -> dict:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _sorted(cols: dict, order: Sequence[str]) -> dict:
    return _taken(cols, np.lexsort([cols[c] for c in reversed(order)]) if all(cols[c].dtype != object for c in order) else pd.DataFrame({c: cols[c] for c in order}).sort_values(list(order), kind="stable").index.to_numpy())


def _packed(cols: dict, order: Sequence[str]) -> list[tuple]:
    """A sorted run as compressed blocks: (earliest ms, first place in order, size, bytes)."""
    cols, out = _sorted(cols, order), []
    for at in range(0, _rows_of(cols), BLOCK_ROWS):
        block = _taken(cols, slice(at, at + BLOCK_ROWS))
        raw = pickle.dumps(block, 5)
        out.append((int(block["_ms"].min()), block[order[0]][0], len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
    return out


def _unpacked(block: tuple) -> dict:
    return pickle.loads(pa.decompress(block[3], decompressed_size=block[2], codec="zstd", asbytes=True))


class _Waiting:
    """A key's rows before the watermark: some loose ones as arrays, the rest as sorted runs of compressed blocks.

    Ripe rows come out in order by a merge that holds one block of each run, so a key's rows are never all unpacked at once.
    """

    def __init__(self, loose: list[dict], runs: list[list[tuple]]):
        self.loose, self.runs = loose, runs

    def add(self, cols: dict, order: Sequence[str]) -> None:
        self.loose.append(cols)
        if sum(map(_rows_of, self.loose)) >= RUN_ROWS:
            self.runs.append(_packed(_joined(self.loose), order))
            self.loose = []

    def earliest(self) -> int | None:
        times = [int(c["_ms"].min()) for c in self.loose if _rows_of(c)] + [b[0] for run in self.runs for b in run]
        return min(times, default=None)

    def ripe(self, mark: int, order: Sequence[str]) -> Iterator[dict]:
        """The rows up to ``mark``, in order and in pieces; they leave. Equal places keep the order of arrival and share a piece."""
        due = [[b for b in run if b[0] <= mark] for run in self.runs]
        self.runs = [kept for run in self.runs if (kept := [b for b in run if b[0] > mark])]
        loose, self.loose = self.loose, []
        open_: list[list[dict]] = [[] for _ in due]
        last = [self._split(_joined(loose), mark, order)] if loose else []
        while True:
            for blocks, held in zip(due, open_, strict=True):
                if blocks and not held:
                    held.append(self._split(_unpacked(blocks.pop(0)), mark, order))
            bound = min((blocks[0][1] for blocks in due if blocks), default=None)
            parts = [c for held in (*open_, last) for c in held]
            if bound is None:
                if parts and _rows_of(rows := _joined(parts)):
                    yield _sorted(rows, order)
                return
            for held in (*open_, last):
                held[:] = [c for x in held if _rows_of(c := _taken(x, x[order[0]] >= bound))]
            if parts and _rows_of(rows := _joined([_taken(c, c[order[0]] < bound) for c in parts])):
                yield _sorted(rows, order)
            for blocks, held in zip(due, open_, strict=True):  # what begins at the bound comes in next
                if blocks and blocks[0][1] == bound:
                    held.append(self._split(_unpacked(blocks.pop(0)), mark, order))

    def _split(self, cols: dict, mark: int, order: Sequence[str]) -> dict:
        on = cols["_ms"] <= mark
        if on.all():
            return cols
        self.add(_taken(cols, ~on), order)
        return _taken(cols, on)


def in_order(stream: DataFrame, keys: Sequence[str], out: str, complete: Complete, *, order: Sequence[str] = ("t_us",), lateness: str | None = LATENESS, forget_s: float = 60.0, arrays: bool = False) -> DataFrame:
    """Runs ``complete(memory, rows)`` on each key's rows once the watermark is past them, in order and in one or more pieces.

    ``memory`` is kept until ``forget_s`` (or, if larger, its own ``forget_us``) after the key's last row. With
    ``lateness`` None the stream has its watermark already. ``rows`` come without the stream's ``timestamp``; with ``arrays`` they come
    and go as arrays by column, which spares keys of few rows most of their cost.
    """
    names = [c.split()[0] for c in out.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, loose, runs, last, fixed = pickle.loads(state.get[0]) if state.exists else ({}, [], [], 0, None)
        waiting = _Waiting(loose, runs)
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for frame in frames:
                if not len(frame):
                    continue
                cols = {c: frame[c].to_numpy() for c in frame.columns if c != "timestamp"}
                fixed = fixed or {c: cols[c][:1].copy() for c in keys}
                last = max(last, int(cols["_ms"].max()))
                waiting.add({c: x for c, x in cols.items() if c not in keys}, order)
        for piece in waiting.ripe(mark, order):
            n = _rows_of(piece)
            rows = {**{c: np.repeat(x, n) for c, x in fixed.items()}, **piece}
            if arrays:
                done = complete(memory, rows)
                yield pd.DataFrame({c: done[c] for c in names}, copy=False)
                continue
            result = complete(memory, pd.DataFrame(rows, copy=False))
            if len(result):
                yield result[names]
        end = last + max(int(forget_s * 1000), memory.get("forget_us", 0) // 1000 + 1)
        earliest = waiting.earliest()
        if earliest is None and mark >= end:
            state.remove()
        else:
            state.update((pickle.dumps((memory, waiting.loose, waiting.runs, last, fixed), 5),))
            state.setTimeoutTimestamp(max(mark + 1, earliest if earliest is not None else end))

    timed = stream.withColumn("_ms", F.unix_millis("timestamp"))
    timed = timed.withWatermark("timestamp", lateness) if lateness else timed
    return timed.groupBy(*keys).applyInPandasWithState(run, out, "memory binary", "append", GroupStateTimeout.EventTimeTimeout)


def _presences(memory: dict, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Stretches of consecutive steps, and whether the first goes on from what memory holds."""
    step = rows["step"].to_numpy()
    before = np.append(memory.get("step", step[0] - 2), step[:-1])
    cut = np.flatnonzero(step != before + 1)
    edges = sorted({0, *cut.tolist(), len(rows)})
    for a, b in zip(edges, edges[1:], strict=False):
        yield rows.iloc[a:b], a not in cut
    memory["step"] = int(step[-1])


def _stretches(memory: dict, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the place where its stretch of consecutive steps begins, and whether that goes on from what memory holds."""
    cut = step != np.append(memory.get("step", step[0] - 2), step[:-1]) + 1
    first = np.maximum.accumulate(np.where(cut, np.arange(len(step)), 0))
    memory["step"] = int(step[-1])
    return first, (first == 0) & ~cut[0]


def _last_in(values: np.ndarray, known: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """:func:`_held` for all stretches at once: nothing is held over from before a row's ``first``."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(at >= first, values[np.maximum(at, 0)], start)


def _shifted(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the row before, and ``start`` where a stretch begins."""
    return np.where(first == np.arange(len(values)), start, np.append(values[:1], values[:-1]))


def _held(values: np.ndarray, known: np.ndarray, start) -> np.ndarray:
    """Each value where known, else the last known one, else ``start``."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(at >= 0, values[np.maximum(at, 0)], start)


def _boxed(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({c: F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")}).drop("box")


def _motion(s: MotionSettings) -> Callable[[dict, dict], dict]:
    kinds = np.array(["unknown", "moving", "stationary"], object)

    def complete(m: dict, r: dict) -> dict:
        first, on = _stretches(m, r["step"])
        c = m["track"] if on[0] else {"age": 0, "kind": -1, "state": 0, "since": -1, "distance": 0.0, "centre": None}
        kept = lambda name, new: np.where(on, c[name], new)
        t, height = r["t_us"], np.maximum(r["y2"] - r["y1"], 1.0)
        passed, elapsed = np.cumsum(r["elapsed_us"]), r["elapsed_us"]
        age = passed - (passed - elapsed)[first] + kept("age", 0)
        speed = np.hypot(r["vx"], r["vy"]) / height
        kind = np.select([age < us(s.min_age_s), speed >= s.moving_above, speed <= s.stationary_below], [0, 1, 2], 0)
        run = _last_in(t, kind != _shifted(kind, first, kept("kind", -1)), first, c.get("run", 0))
        lasting = (kind > 0) & (t - run >= us(s.min_state_s))
        state = _last_in(kind, lasting, first, kept("state", 0))
        since = _last_in(t, state != _shifted(state, first, kept("state", 0)), first, kept("since", -1))
        cx, cy = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2
        px, py = c["centre"] or (cx[0], cy[0])
        moved = np.hypot(cx - _shifted(cx, first, np.where(on, px, cx)), cy - _shifted(cy, first, np.where(on, py, cy))) / height
        distance = np.where(state == 1, moved, 0.0)
        begins = np.unique(first).tolist()
        for a, b in zip(begins, [*begins[1:], len(t)], strict=True):
            distance[a:b] = (c["distance"] if on[a] else 0.0) + np.cumsum(distance[a:b])
        m["track"] = {"age": int(age[-1]), "kind": int(kind[-1]), "run": int(run[-1]), "state": int(state[-1]), "since": int(since[-1]), "distance": float(distance[-1]), "centre": (cx[-1], cy[-1])}
        return {**r, "motion": kinds[state], "speed": speed, "dwell_s": np.where(since >= 0, t - since, age) / 1e6, "age_s": age / 1e6, "distance": distance}

    return complete


def stream_motion_state(tracks: DataFrame, settings: MotionSettings = MotionSettings(), **options) -> DataFrame:
    """Motion, dwell, age and distance per track row."""
    out = "source_id string, track_id long, step long, t_us long, motion string, speed double, dwell_s double, age_s double, distance double"
    rows = _boxed(tracks.select("source_id", "track_id", "step", "t_us", "elapsed_us", "vx", "vy", "box", "timestamp"))
    return in_order(rows, ["source_id", "track_id"], out, _motion(settings), arrays=True, **options)


def _with_tail(m: dict, rows: pd.DataFrame, goes_on: bool, reach: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows after those of the same presence that a window of ``reach`` still covers, and which are new."""
    tail = m.get("tail") if goes_on else None
    both = rows if tail is None else pd.concat([tail, rows], ignore_index=True)
    new = np.arange(len(both)) >= len(both) - len(rows)
    m["tail"] = both[both["t_us"] >= both["t_us"].iloc[-1] - reach]
    return both.reset_index(drop=True), new


def _relations(s: RelationSettings) -> Complete:
    window = us(s.approach_window_s)

    def complete(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r, goes_on in _presences(m, rows):
            near_since = m.get("near") if goes_on else None
            d, t = r["separation"].to_numpy(), r["t_us"].to_numpy()
            close, away = d <= s.near_distance, d > s.near_distance + s.near_hysteresis
            near = _held(close.astype(int), close | away, int(near_since is not None)) == 1
            begins = near & ~np.append(near_since is not None, near[:-1])
            since = _held(t, begins, near_since or 0)
            m["near"] = int(since[-1]) if near[-1] else None
            confidence = np.maximum(0.15, 1.0 - np.minimum(1.0, d / max(s.near_distance, 1e-6)))
            parts.append(r.assign(relation="near", distance=d, confidence=confidence, duration_s=(t - since) / 1e6)[near])
            both, new = _with_tail(m, r, goes_on, window)
            t, d = both["t_us"].to_numpy(), both["separation"].to_numpy()
            first = np.searchsorted(t, t - window, side="left")
            span = t - t[first]
            rate = (d[first] - d) / np.maximum(span, 1) * 1e6
            shown = new & (span > 0) & (span >= window * 0.5) & (np.abs(rate) >= s.approach_rate)
            side = np.where(rate > 0, "approaching", "receding").astype(object)
            parts.append(both.assign(relation=side, distance=d, confidence=np.minimum(1.0, np.abs(rate) / (s.approach_rate * 3)), duration_s=s.approach_window_s)[shown])
        return pd.concat(parts)

    return complete


def stream_relations(pairs: DataFrame, settings: RelationSettings = RelationSettings(), **options) -> DataFrame:
    """Relations that need no pose, per pair of :func:`scenelake.streaming.windows.stream_pairs`."""
    out = "source_id string, low long, high long, step long, t_us long, relation string, distance double, confidence double, duration_s double"
    rows = pairs.select("source_id", "low", "high", "step", "t_us", "separation", "timestamp")
    return in_order(rows, ["source_id", "low", "high"], out, _relations(settings), **options)


def _visits(zones: Sequence[Zone], hold: int) -> Complete:
    def complete(m: dict, r: pd.DataFrame) -> pd.DataFrame:
        first, on = _stretches(m, r["step"].to_numpy())
        open_ = m.get("open", {}) if on[0] else {}
        t = r["t_us"].to_numpy()
        before = _shifted(t, first, np.where(on, m.get("last_t", 0), t))
        m.update(open={}, last_t=int(t[-1]))
        hits = [set(h) for h in r["hits"]]
        at, cols = [], {"zone": [], "zone_kind": [], "zone_order": [], "dwell_s": [], "event": []}
        for order, zone in enumerate(zones):
            inside = np.array([order in h for h in hits])
            entered, last = (np.where(on, x, -1) for x in open_.get(order, (-1, -1)))
            if not inside.any() and last[0] < 0:
                continue
            latest = _last_in(t, inside, first, last)
            prior = _shifted(latest, first, last)
            starts = inside & ((prior < 0) | ((before > prior) & (before - prior > hold)))
            since = _last_in(t, starts, first, entered)
            gone = ~inside & (latest >= 0) & (t - latest <= hold)
            if t[-1] - latest[-1] <= hold and latest[-1] >= 0:
                m["open"][order] = (int(since[-1]), int(latest[-1]))
            event = np.where(gone, "exited", np.where(t - since <= hold, "entered", None)).astype(object)
            shown = np.flatnonzero(inside | gone)
            at.append(shown)
            for c, x in zip(cols, (zone.name, zone.kind, order, ((latest - since) / 1e6)[shown], event[shown]), strict=True):
                cols[c].append(x if isinstance(x, np.ndarray) else np.full(len(shown), x, object if isinstance(x, str) else None))
        if not at:
            return r.iloc[:0]
        return r.iloc[np.concatenate(at)].assign(**{c: np.concatenate(x) for c, x in cols.items()})

    return complete


def stream_zone_rows(tracks: DataFrame, zones: Sequence[Zone], *, hold_s: float = HOLD_S, frame_width: float = 640.0, frame_height: float = 480.0, **options) -> DataFrame:
    """Occupancy rows while they happen, as ``zone_visits`` has them: dwell, ``entered``, and ``exited`` up to ``hold_s`` after the last row inside.

    A row comes out once the watermark has passed it, on a timer if its track sends nothing more. A track holds one (entered, last inside)
    per zone it is in.
    """
    out = "source_id string, track_id long, step long, t_us long, entity_id string, label string, zone string, zone_kind string, zone_order int, dwell_s double, event string"
    hits = F.transform(zone_hits(zones, frame_width, frame_height), lambda z: z["zone_order"])
    rows = tracks.select("source_id", "track_id", "step", "t_us", "entity_id", "label", hits.alias("hits"), "timestamp")
    return in_order(rows, ["source_id", "track_id"], out, _visits(list(zones), us(hold_s)), **options)


def _contacts(s: RelationSettings) -> Complete:
    def complete(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r, goes_on in _presences(m, rows):
            since, reached, claimed = m.get("contact", (None, -1, None)) if goes_on else (None, -1, None)
            t, close, reach = r["t_us"].to_numpy(), r["close"].to_numpy(bool), r["reach"].to_numpy(bool)
            begins = close & ~np.append(since is not None, close[:-1])
            begun = _held(t, begins, -1 if since is None else since)
            latest = _held(t, reach, reached)
            ripe = close & (t - begun >= us(s.interact_s))
            first = ripe & ~np.append(claimed is not None, ripe[:-1])
            held = _held(t, first, -1 if claimed is None else claimed)
            m["contact"] = (int(begun[-1]), int(latest[-1]), int(held[-1]) if ripe[-1] else None) if close[-1] else (None, -1, None)
            parts.append(r.assign(relation="interacting_with", distance=r["separation"], confidence=np.where(latest >= begun, 0.85, 0.4), duration_s=(t - held) / 1e6)[ripe])
        return pd.concat(parts)

    return complete


def stream_interaction(pairs: DataFrame, poses: DataFrame, settings: RelationSettings = RelationSettings(), *, lateness: str = LATENESS, slack: str = "1 second", **options) -> DataFrame:
    """``interaction`` on streams: pairs of a frame meet the person's keypoints, then a contact state per pair.

    ``pairs`` are rows of ``pair_join`` (``first`` and ``second`` with label, box and motion) with ``timestamp``; ``poses`` are
    (source_id, track_id, step, keypoints, timestamp), whose clock may be off by ``slack``. Each stream has its own watermark, which
    all pairs move on, of whatever labels; a pair without a pose waits until one can no longer come and then counts as without a reach.
    """
    s = settings
    mixed = person_object_pairs(pairs.withWatermark("timestamp", lateness), "timestamp")
    seen = poses.select(F.col("source_id").alias("_source"), F.col("track_id").alias("_track"), F.col("step").alias("_step"), "keypoints", F.col("timestamp").alias("_seen")).withWatermark("_seen", lateness)
    window = F.expr(f"_seen >= timestamp - interval {slack} and _seen <= timestamp + interval {slack}")
    met = mixed.join(seen, (F.col("source_id") == F.col("_source")) & (F.col("step") == F.col("_step")) & (F.col("person.track_id") == F.col("_track")) & window, "left_outer")
    reach = F.coalesce(wrist_inside(F.col("keypoints"), F.col("thing.box"), s.reach_confidence), F.lit(False))
    stopped = F.coalesce(F.col("person.motion") == "stationary", F.lit(False)) & (F.col("separation") <= s.interact_distance)
    rows = met.select(
        "source_id", "low", "high", "step", "t_us", "separation", reach.alias("reach"), (reach | stopped).alias("close"), "timestamp",
        F.col("person.track_id").alias("subject_track"), F.col("thing.track_id").alias("object_track"), F.col("person.entity_id").alias("subject_id"), F.col("thing.entity_id").alias("object_id"),
    )
    out = "source_id string, low long, high long, step long, t_us long, relation string, subject_track long, object_track long, subject_id string, object_id string, distance double, confidence double, duration_s double"
    return in_order(rows, ["source_id", "low", "high"], out, _contacts(s), lateness=None, **options)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i] : i + 1]``."""
    total = np.append(0.0, np.cumsum(values))
    return total[1:] - total[first]


def _moments(m: dict, both: pd.DataFrame, new: np.ndarray, s: ActivitySettings) -> list[tuple[str, int, float]]:
    """Posture changes on the new rows: (name, time, confidence)."""
    t, posture, sure = both["t_us"].to_numpy(), both["posture"].to_numpy(), both["posture_confidence"].to_numpy()
    first = np.searchsorted(t, t - us(s.posture_window_s), side="left")
    usable = np.isin(posture, STABLE_POSTURES) & (sure >= s.min_posture_confidence)
    n = _sums(usable.astype(float), first)
    code = np.full(len(t), -1)
    for k in range(len(STABLE_POSTURES) - 1, -1, -1):
        share = _sums((usable & (posture == STABLE_POSTURES[k])).astype(float), first)
        code = np.where((n > 0) & (share >= n * POSTURE_MAJORITY - 1e-9), k, code)
    code, clear = np.where(new, code, -1), new & (code >= 0)
    stable = _held(code, clear, m.get("stable", -1))
    was = np.append(m.get("stable", -1), stable[:-1])
    m["stable"] = int(stable[-1])
    mean = np.divide(_sums(np.where(usable, sure, 0.0), first), np.maximum(n, 1))
    found = []
    for i in np.flatnonzero(new & (stable != was) & (was >= 0)):
        shown = np.flatnonzero(posture[: i + 1] == STABLE_POSTURES[was[i]])
        gap = t[i] - t[shown[-1]] if len(shown) else None
        change = (STABLE_POSTURES[was[i]], STABLE_POSTURES[stable[i]])
        name = {("standing", "sitting"): "sitting_down", ("sitting", "standing"): "standing_up"}.get(change)
        if change[1] == "lying" and change[0] in ("standing", "crouching"):
            name = "falling" if gap is not None and gap <= us(s.fall_window_s) else None
        if name and gap is not None and gap <= us(s.transition_window_s):
            found.append((name, int(t[i]), float(min(1.0, mean[i]))))
    return found


def _activities(s: ActivitySettings) -> Complete:
    reach = us(max(s.sustain_s, s.transition_window_s, s.posture_window_s))

    def complete(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r, goes_on in _presences(m, rows):
            if not goes_on:
                m.update(begun=int(r["t_us"].iloc[0]), stable=-1, moments=[])
            both, new = _with_tail(m, r, goes_on, reach)
            t, speed, dwell = (both[c].to_numpy() for c in ("t_us", "speed", "dwell_s"))
            first = np.searchsorted(t, t - us(s.sustain_s), side="left")
            n = np.arange(len(t)) - first + 1
            enough = (n >= 2) & (t - t[first] >= us(s.sustain_s * WINDOW_COVERAGE))
            share = lambda level: _sums((speed >= level).astype(float), first) / n  # noqa: B023, E731
            runs = (speed >= s.running_speed) & (share(s.running_speed * 0.8) >= MAJORITY)
            level = np.where(runs, s.running_speed, s.walking_speed)
            support = np.where(runs, share(s.running_speed), share(s.walking_speed))
            motion = both["motion"].to_numpy()
            going = (motion == "moving") & (speed >= s.walking_speed) & enough & (support >= MAJORITY)
            pace = np.minimum(1.0, np.abs(speed - level) / level)
            waits = (motion == "stationary") & (dwell >= s.loiter_s)
            arms = enough & (_sums(both["arm_raised"].to_numpy(bool).astype(float), first) == n)
            found = [
                (going, np.where(runs, "running", "walking").astype(object), 0.5 * pace + 0.5 * support, dwell),
                (waits, "loitering", np.minimum(1.0, 0.5 + 0.5 * (dwell - s.loiter_s) / max(s.loiter_s, 1e-6)), dwell),
                (arms, "arm_raised", _sums(both["arm_confidence"].to_numpy(float), first) / n, (t - t[first]) / 1e6),
            ]
            moments = m["moments"] + _moments(m, both, new, s)
            found += [((t >= at) & (t - at <= us(s.transient_hold_s)), name, sure, (t - at) / 1e6) for name, at, sure in moments]
            m["moments"] = [x for x in moments if t[-1] - x[1] <= us(s.transient_hold_s)]
            busy = np.any([f[0] for f in found], axis=0)
            found.append((~busy, "idle", 1.0, (t - m["begun"]) / 1e6))
            step = both["step"].to_numpy()
            for on, name, sure, held in found:
                at = np.flatnonzero(on & new)
                if len(at):
                    whole = lambda x: x[at] if isinstance(x, np.ndarray) else np.full(len(at), x, object if isinstance(x, str) else None)  # noqa: B023, E731
                    parts.append((step[at], t[at], whole(name), whole(sure), held[at]))
        columns = dict(zip(("step", "t_us", "activity", "confidence", "duration_s"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
        return pd.DataFrame({"source_id": rows["source_id"].iloc[0], "track_id": rows["track_id"].iloc[0], **columns})

    return complete


def stream_activities(state: DataFrame, settings: ActivitySettings = ActivitySettings(), **options) -> DataFrame:
    """Activities per entity and step, from motion rows with posture and arm columns."""
    out = "source_id string, track_id long, step long, t_us long, activity string, confidence double, duration_s double"
    cols = ["source_id", "track_id", "step", "t_us", "speed", "motion", "dwell_s", "posture", "posture_confidence", "arm_raised", "arm_confidence", "timestamp"]
    return in_order(state.select(*cols), ["source_id", "track_id"], out, _activities(settings), **options)


def _debounce(m: dict, rows: pd.DataFrame) -> pd.DataFrame:
    """A candidate fires when its own cooldown is over since the last firing of its presence."""
    t, gap, island = (rows[c].to_numpy(np.int64) for c in ("t_us", "cooldown_us", "island"))
    fired = gap <= 0
    edges = [0, *(np.flatnonzero(island[1:] != island[:-1]) + 1).tolist(), len(rows)]
    for a, b in zip(edges, edges[1:], strict=False):
        last = m["last"] if m.get("island") == island[a] else None
        free = t[a:b] - gap[a:b]
        i = a
        while i < b:
            open_ = np.flatnonzero((free[i - a :] >= last) | fired[i:b]) if last is not None else np.array([0])
            if not len(open_):
                break
            i += int(open_[0])
            fired[i], last = True, int(t[i])
            i += 1
        m.update(island=int(island[a]), last=last)
    m["forget_us"] = max(m.get("forget_us", 0), int(gap.max()))
    return rows.rename(columns={"who": "entity_id"}).assign(fired=fired)


def stream_debounce(candidates: DataFrame, **options) -> DataFrame:
    """Candidates with ``fired``, memory per (source, rule, entity), kept for the longest cooldown seen."""
    out = "source_id string, rule string, entity_id string, step long, t_us long, zone string, fired boolean"
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = candidates.select("source_id", "rule", blank("entity_id").alias("who"), "island", "step", "t_us", blank("zone").alias("zone"), "cooldown_us", "timestamp")
    return in_order(rows, ["source_id", "rule", "who"], out, _debounce, order=("t_us", "zone"), **options)
