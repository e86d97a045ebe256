"""Series, baselines, anomalies and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from scenelake.functions.clock import bucket_index, epoch_s, local_midnight, next_local_midnight, slot_index
from scenelake.functions.robust import anomaly_severity, small_sample_correction
from scenelake.operators import baseline as b
from scenelake.operators import series as s
from scenelake.session import settle
from scenelake.plans import reports as r
from scenelake.plans.analysis import AnalysisSettings, analyse

LO, MID, HI = v.START, v.WINDOW, v.END
HISTORY = AnalysisSettings(period_hours=24, training_span_s=float(MID - LO))
GRID = s.Grid(float(LO), 3600.0, 0, (HI - LO) // 3600 - 1)
Q: dict[str, tuple] = {}


def start(df):
    return df.withColumn("start_s", F.unix_seconds("bucket_start"))


# --- SQL pieces -----------------------------------------------------------------------------

VALUE = {
    "entities": "count(DISTINCT entity_id)", "observations": "count(*)", "events": "count(*)",
    "mean_speed": "coalesce(avg(speed), 0)", "moving_fraction": "sum(CASE WHEN motion = 'moving' THEN 1 ELSE 0 END) / count(*)",
}


def series_ctes(source: str, value: str, lo: int, hi: int, width: int = 3600, name: str = "ser", where: str = "TRUE", per_camera: bool = True) -> dict[str, str]:
    n = (hi - lo) // width
    cam, on = ("camera_id,", "USING (camera_id, bucket)") if per_camera else ("", "USING (bucket)")
    group = "camera_id, bucket" if per_camera else "bucket"
    axis = f"SELECT camera_id, bucket FROM (SELECT DISTINCT camera_id FROM {name}_r), range({n}) t(bucket)" if per_camera else f"SELECT bucket FROM range({n}) t(bucket)"
    return {
        f"{name}_r": f"SELECT *, CAST(floor((us - {lo}000000) / {width}000000) AS BIGINT) AS bucket FROM {source} WHERE us >= {lo}000000 AND us < {hi}000000 AND {where}",
        f"{name}_a": f"SELECT {group}, CAST({value} AS DOUBLE) AS value, count(*) AS samples FROM {name}_r GROUP BY {group}",
        f"{name}_c": axis,
        name: f"SELECT {cam} bucket, {lo} + bucket * {width} AS start_s, coalesce(value, 0) AS value, coalesce(samples, 0) AS samples FROM {name}_c LEFT JOIN {name}_a {on}",
    }


def zeros_ctes(src: str, name: str, alive: str | None = None) -> dict[str, str]:
    w = "OVER (PARTITION BY camera_id ORDER BY bucket ROWS BETWEEN {} AND {})"
    before, after = w.format("2 PRECEDING", "1 PRECEDING"), w.format("1 FOLLOWING", "2 FOLLOWING")
    near = f"(samples = 0 AND coalesce(max(samples) {before}, 0) > 0 AND coalesce(max(samples) {after}, 0) > 0)"
    if not alive:
        return {name: f"SELECT *, {near} AS known_zero FROM {src}"}
    beat = f"EXISTS (SELECT 1 FROM beats h WHERE h.camera_id = x.camera_id AND h.us >= x.start_s * 1000000 AND h.us < (x.start_s + 3600) * 1000000)"
    return {
        f"{name}_x": f"SELECT x.*, (samples = 0 AND {beat}) AS alive FROM {src} x",
        name: f"SELECT * EXCLUDE (alive), alive OR {near} AS known_zero FROM {name}_x",
    }


def correction(n: str) -> str:
    table = [(2, 2.20), (3, 1.85), (4, 1.49), (5, 1.34), (6, 1.26), (8, 1.17), (12, 1.12), (16, 1.10), (26, 1.05)]
    arms = [f"WHEN {n} <= 2 THEN 2.20::DOUBLE"]
    for (a, x), (c, y) in zip(table, table[1:]):
        arms.append(f"WHEN {n} <= {c} THEN {x}::DOUBLE + ({y}::DOUBLE - {x}::DOUBLE) * ({n} - {a}) / {c - a}")
    return f"CASE {' '.join(arms)} ELSE 1 + 1.3::DOUBLE / {n} END"


def baseline_ctes(src: str) -> dict[str, str]:
    return {
        "bv": f"SELECT camera_id, CAST((start_s // 3600) % 24 AS BIGINT) AS slot, value FROM {src} WHERE samples > 0 OR known_zero",
        "bc": "SELECT camera_id, slot, median(value) AS centre, count(*) AS n, count(DISTINCT value) AS kinds FROM bv GROUP BY camera_id, slot",
        "br": "SELECT bv.camera_id, slot, centre, n, kinds, abs(value - centre) AS off FROM bv JOIN bc USING (camera_id, slot)",
        "bp": f"""SELECT camera_id, m * 1.4826::DOUBLE * {correction('per')} AS dispersion FROM (SELECT camera_id, median(off / sqrt(abs(centre) + 1)) AS m,
            greatest(1, count(*) // count(DISTINCT slot)) AS per FROM br WHERE kinds > 1 GROUP BY camera_id)""",
        "bm": f"SELECT camera_id, slot, centre, n, median(off) * 1.4826::DOUBLE * {correction('n')} AS own FROM br GROUP BY camera_id, slot, centre, n",
        "bs": """SELECT camera_id, slot, centre, n AS samples, greatest(n / (n + 8.0::DOUBLE) * own + (1 - n / (n + 8.0::DOUBLE)) * coalesce(dispersion, 0) * sqrt(abs(centre) + 1),
            abs(centre) * 0.02::DOUBLE, 0.75::DOUBLE) AS spread FROM bm LEFT JOIN bp USING (camera_id)""",
    }


SCORED = """SELECT s.*, coalesce(samples_b >= 3 AND (s.samples > 0 OR s.known_zero), FALSE) AS judged, CASE WHEN samples_b >= 3 AND (s.samples > 0 OR s.known_zero)
    THEN abs(s.value - centre) / spread END AS score, centre, spread, s.value > centre AS above, samples_b FROM {win} s
    LEFT JOIN (SELECT camera_id, slot, centre, spread, samples AS samples_b FROM bs) b ON b.camera_id = s.camera_id AND b.slot = (s.start_s // 3600) % 24"""


def analysis_ctes(alive: bool = False, source: str = "obs") -> dict[str, str]:
    out = series_ctes(source, VALUE["entities"], LO, MID, name="tr1") | series_ctes(source, VALUE["entities"], MID, HI, name="wi1")
    out |= zeros_ctes("tr1", "trz", alive) | zeros_ctes("wi1", "wiz", alive) | baseline_ctes("trz")
    out["sc"] = SCORED.format(win="wiz")
    out["sv"] = "SELECT *, CASE WHEN NOT judged THEN 'unjudged' WHEN score >= 3.5 THEN 'anomaly' ELSE 'normal' END AS verdict FROM sc"
    return out


# --- queries --------------------------------------------------------------------------------


def _series_query(metric: str, table: str, **kw):
    def run(spark, d):
        df = v.alerts(spark, d) if table == "alerts" else v.observations(spark, d)
        out = start(s.bucket_series(df, metric, since=LO, until=HI, interval_s=3600.0, keys=["camera_id"], **kw))
        return out.select("camera_id", "bucket", "start_s", F.round("value", 6).alias("value"), "samples")

    return run


def _series_sql(metric: str, table: str, where: str = "TRUE") -> str:
    c = series_ctes(table, VALUE[metric], LO, HI, where=where)
    return v.sql("SELECT camera_id, bucket, start_s, round(value, 6) AS value, samples FROM ser", table, ctes=c)


for _m in ("entities", "observations", "mean_speed", "moving_fraction"):
    Q[f"series_{_m}"] = (_series_query(_m, "obs"), _series_sql(_m, "obs"))
Q["series_events"] = (_series_query("events", "alerts", zone="z3"), _series_sql("events", "alerts", "zone = 'z3'"))
Q["series_entities_filtered"] = (
    _series_query("entities", "obs", entity_type="click", zone="z2"), _series_sql("entities", "obs", "entity_type = 'click' AND list_contains(zones, 'z2')"),
)


def _within(spark, d, estimates, error):
    """Estimates of daily entities beside the exact counts: both within three standard errors and a half."""
    exact = s.bucket_series(v.observations(spark, d), "entities", since=LO, until=HI, interval_s=86400.0, keys=["camera_id"])
    both = start(exact).join(estimates.select("camera_id", "bucket", F.col("value").alias("_v"), F.col("samples").alias("_n")), ["camera_id", "bucket"], "left").fillna(0, ["_v", "_n"])
    near = (F.abs(F.col("_v") - F.col("value")) <= 3 * error * F.col("value") + 0.5) & (F.col("_n") == F.col("samples"))
    return both.select("camera_id", "bucket", "start_s", "value", "samples", near.alias("within"))


_DAILY = v.sql("SELECT camera_id, bucket, start_s, value, samples, TRUE AS within FROM ser", "obs", ctes=series_ctes("obs", VALUE["entities"], LO, HI, 86400))


def approx(spark, d):
    out = s.bucket_series(v.observations(spark, d), "entities_approx", since=LO, until=HI, interval_s=86400.0, keys=["camera_id"])
    return _within(spark, d, out, 0.02)


Q["series_entities_approx"] = (approx, _DAILY)


def sketched(spark, d):
    """Stored hourly sketches, unioned to days without the raw rows."""
    hours = settle(s.sketch_series(v.observations(spark, d), since=LO, until=HI, interval_s=3600.0, keys=["camera_id"]))
    return _within(spark, d, s.sketch_values(s.merge_sketches(hours, 24, ["camera_id"])), 1.04 / 2 ** (s.SKETCH_LG_K / 2))


Q["series_entities_sketched"] = (sketched, _DAILY)


def null_camera(spark, d):
    """One camera in four is not known: its rows are a series of their own, judged like the rest."""
    o = v.observations(spark, d).withColumn("camera_id", F.expr("nullif(camera_id, 'cam3')"))
    out = _judged(analyse(o, "entities", since=MID, until=HI, keys=["camera_id"], settings=HISTORY, heartbeats=v.beats(spark, d).withColumn("camera_id", F.expr("nullif(camera_id, 'cam3')"))))
    return out.withColumn("camera_id", F.coalesce("camera_id", F.lit("none")))


def whole(spark, d):
    """All cameras together, 6-hour buckets on a custom origin after ``since``."""
    out = s.bucket_series(v.observations(spark, d), "entities", since=LO + 1800, until=HI - 100, interval_s=21600.0, origin=float(LO + 86400))
    return start(out).select("bucket", "start_s", "value", "samples")


_n_from, _n_to = -4, 115
Q["series_custom_origin"] = (
    whole,
    v.sql(
        f"""SELECT t.b AS bucket, {LO + 86400} + t.b * 21600 AS start_s, coalesce(value, 0) AS value, coalesce(samples, 0) AS samples
        FROM range({_n_from}, {_n_to + 1}) t(b) LEFT JOIN a ON a.b = t.b""",
        "obs",
        ctes={"a": f"""SELECT CAST(floor((us / 1000000.0 - {LO + 86400}) / 21600) AS BIGINT) AS b, CAST(count(DISTINCT entity_id) AS DOUBLE) AS value, count(*) AS samples
            FROM obs WHERE us >= {LO}000000 AND us < {LO + 86400 + 116 * 21600}000000 GROUP BY 1"""},
    ),
)


def rollup(spark, d):
    out = s.series_rollup(v.observations(spark, d), ["camera_id", "entity_type"], "entities", since=LO, until=HI, interval_s=86400.0)
    return out.select(F.coalesce("camera_id", F.lit("all")).alias("camera_id"), F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "bucket", "value", "samples")


Q["series_rollup"] = (
    rollup,
    v.sql(
        f"""SELECT coalesce(camera_id, 'all') AS camera_id, coalesce(entity_type, 'all') AS entity_type, bucket, CAST(count(DISTINCT entity_id) AS DOUBLE) AS value, count(*) AS samples
        FROM r GROUP BY GROUPING SETS ((camera_id, entity_type, bucket), (camera_id, bucket), (bucket))""",
        "obs",
        ctes={"r": f"SELECT *, (us - {LO}000000) // 86400000000 AS bucket FROM obs WHERE us >= {LO}000000 AND us < {HI}000000"},
    ),
)


def _full_series(spark, d):
    return s.mark_observed_zeros(s.bucket_series(v.observations(spark, d), "entities", since=LO, until=HI, interval_s=3600.0, keys=["camera_id"]), ["camera_id"])


_full_c = series_ctes("obs", VALUE["entities"], LO, HI) | zeros_ctes("ser", "z")


def _sparse_series(spark, d):
    return s.bucket_series(v.sparse(spark, d), "entities", since=LO, until=HI, interval_s=3600.0, keys=["camera_id"])


def zeros(spark, d):
    return start(s.mark_observed_zeros(_sparse_series(spark, d), ["camera_id"])).select("camera_id", "bucket", "start_s", "value", "samples", "known_zero")


_sparse_c = series_ctes("sparse", VALUE["entities"], LO, HI)
Q["mark_observed_zeros"] = (
    zeros, v.sql("SELECT camera_id, bucket, start_s, value, samples, known_zero FROM z", "sparse", ctes=_sparse_c | zeros_ctes("ser", "z")),
)


def alive(spark, d):
    ser = s.mark_alive(_sparse_series(spark, d), v.beats(spark, d), GRID, ["camera_id"])
    return start(ser).select("camera_id", "bucket", "value", "samples", "known_zero")


Q["mark_alive"] = (
    alive,
    v.sql(
        """SELECT camera_id, bucket, value, samples, (samples = 0 AND EXISTS (SELECT 1 FROM beats h WHERE h.camera_id = x.camera_id
        AND h.us >= x.start_s * 1000000 AND h.us < (x.start_s + 3600) * 1000000)) AS known_zero FROM ser x""", "sparse", "beats", ctes=_sparse_c,
    ),
)


def gaps(spark, d):
    ser = s.mark_alive(_sparse_series(spark, d), v.beats(spark, d), GRID, ["camera_id"])
    return s.gap_report(s.mark_observed_zeros(ser, ["camera_id"]), ["camera_id"])


_sparse_z = _sparse_c | zeros_ctes("ser", "z", "y")
Q["gap_report"] = (
    gaps,
    v.sql(
        """SELECT camera_id, count(*) FILTER (samples > 0) AS recorded, count(*) FILTER (samples = 0 AND known_zero) AS known_zero,
        count(*) FILTER (samples = 0 AND NOT known_zero) AS unknown, count(*) AS total FROM z GROUP BY camera_id""", "sparse", "beats", ctes=_sparse_z,
    ),
)


def rebucketed(spark, d):
    out = s.rebucket(_full_series(spark, d), 6, "entities", ["camera_id"])
    return start(out).select("camera_id", "bucket", "start_s", "width_s", "value", "samples", "known_zero")


Q["rebucket"] = (
    rebucketed,
    v.sql(
        """SELECT camera_id, bucket // 6 AS bucket, min(start_s) AS start_s, 21600.0::DOUBLE AS width_s, sum(value) AS value, CAST(sum(samples) AS BIGINT) AS samples,
        bool_and(known_zero) AND sum(samples) = 0 AS known_zero FROM z GROUP BY camera_id, bucket // 6""", "obs", ctes=_full_c,
    ),
)


def stats(spark, d):
    out = s.series_stats(_full_series(spark, d), ["camera_id"])
    return out.select(
        "camera_id", "buckets", "occupied", F.round("coverage", 6).alias("coverage"), "total", F.round("mean", 6).alias("mean"), "peak_value",
        F.unix_seconds("peak_start").alias("peak_s"), "quiet_value", F.unix_seconds("quiet_start").alias("quiet_s"),
    )


_occ = "(samples > 0 OR known_zero)"
Q["series_stats"] = (
    stats,
    v.sql(
        f"""SELECT camera_id, count(*) AS buckets, count(*) FILTER {_occ} AS occupied, round(count(*) FILTER {_occ} / count(*), 6) AS coverage, sum(value) AS total,
        round(avg(value) FILTER {_occ}, 6) AS mean, max(value) AS peak_value, arg_max(start_s, value * 100000 - bucket) AS peak_s, min(value) FILTER {_occ} AS quiet_value,
        arg_min(start_s, value * 100000 + bucket) FILTER {_occ} AS quiet_s FROM z GROUP BY camera_id""", "obs", ctes=_full_c,
    ),
)


def zones(spark, d):
    return s.zone_breakdown(v.observations(spark, d), ["z0", "z1", "z2", "z3", "z9"], since=MID, until=HI, camera="cam1")


Q["zone_breakdown"] = (
    zones,
    v.sql(
        f"""SELECT w.zone, count(DISTINCT entity_id) AS entities FROM (VALUES ('z0'), ('z1'), ('z2'), ('z3'), ('z9')) w(zone)
        LEFT JOIN (SELECT entity_id, unnest(zones) AS zone FROM obs WHERE camera_id = 'cam1' AND us >= {MID}000000 AND us < {HI}000000) o ON o.zone = w.zone GROUP BY w.zone""", "obs",
    ),
)


def _training(spark, d):
    ser = s.bucket_series(v.observations(spark, d), "entities", since=LO, until=MID, interval_s=3600.0, keys=["camera_id"])
    return s.mark_observed_zeros(ser, ["camera_id"])


def baseline(spark, d):
    out = b.learn_baseline(_training(spark, d), ["camera_id"], period_hours=24)
    return out.select(
        "camera_id", F.col("slot").cast("long").alias("slot"), "centre", F.round("spread", 6).alias("spread"), F.col("samples").cast("long").alias("samples"),
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "trustworthy",
    )


_train_c = series_ctes("obs", VALUE["entities"], LO, MID) | zeros_ctes("ser", "z") | baseline_ctes("z")
Q["learn_baseline"] = (
    baseline,
    v.sql(
        """SELECT camera_id, slot, centre, round(spread, 6) AS spread, samples, round(centre - 3.5 * spread, 6) AS low, round(centre + 3.5 * spread, 6) AS high,
        samples >= 3 AS trustworthy FROM bs""", "obs", ctes=_train_c,
    ),
)


def pooled(spark, d):
    return b.pooled_dispersion(_training(spark, d), ["camera_id"], 24).select("camera_id", F.round("dispersion", 6).alias("dispersion"))


Q["pooled_dispersion"] = (pooled, v.sql("SELECT camera_id, round(dispersion, 6) AS dispersion FROM bp", "obs", ctes=_train_c))


def mad(spark, d):
    out = b.slot_values(_training(spark, d), ["camera_id"], 24, False)
    return out.select(
        "camera_id", F.col("slot").cast("long").alias("slot"), "centre", F.round(b.array_median(F.col("_off")) * 1.4826 * small_sample_correction(F.col("samples")), 6).alias("mad")
    )


Q["median_mad"] = (mad, v.sql("SELECT camera_id, slot, centre, round(own, 6) AS mad FROM bm", "obs", ctes=_train_c))


def _analysed(spark, d, beats=False):
    return analyse(
        v.observations(spark, d), "entities", since=MID, until=HI, keys=["camera_id"], settings=HISTORY, heartbeats=v.beats(spark, d) if beats else None
    )


def _judged(df):
    return start(df).select(
        "camera_id", "bucket", "start_s", "value", "samples", "known_zero", F.round("score", 6).alias("score"), "verdict", F.coalesce("direction", F.lit("-")).alias("direction")
    )


def analysed(spark, d):
    return _judged(_analysed(spark, d, beats=True))


_judged_sql = """SELECT camera_id, bucket, start_s, value, samples, known_zero, round(score, 6) AS score, verdict,
    CASE WHEN verdict <> 'anomaly' THEN '-' WHEN above THEN 'above' ELSE 'below' END AS direction FROM sv"""
Q["analyse"] = (analysed, v.sql(_judged_sql, "obs", "beats", ctes=analysis_ctes(True)))


def flagship(spark, d):
    """Every judged hour of the last week, most unusual first."""
    return _judged(_analysed(spark, d)).orderBy(F.desc_nulls_last("score"), "camera_id", "bucket")


Q["analyse_null_camera"] = (
    null_camera,
    f"SELECT CASE WHEN camera_id = 'cam3' THEN 'none' ELSE camera_id END AS camera_id, * EXCLUDE (camera_id) FROM ({v.sql(_judged_sql, 'obs', 'beats', ctes=analysis_ctes(True))})",
)


def described(spark, d):
    """A stored baseline says what it was learned from."""
    out = b.learn_baseline(_training(spark, d), ["camera_id"], period_hours=24, metric="entities")
    return out.select("camera_id", F.col("slot").cast("long").alias("slot"), "metric", "width_s", F.col("period_hours").cast("long").alias("period_hours"))


Q["baseline_measure"] = (described, v.sql("SELECT camera_id, slot, 'entities' AS metric, 3600.0::DOUBLE AS width_s, 24::BIGINT AS period_hours FROM bs", "obs", ctes=_train_c))
Q["flagship_unusual_hours"] = (flagship, v.sql(_judged_sql, "obs", ctes=analysis_ctes()))


def self_judged(spark, d):
    out = analyse(v.observations(spark, d), "entities", since=LO, until=HI, keys=["camera_id"], settings=HISTORY, train_on_window=True)
    return _judged(out)


_self = series_ctes("obs", VALUE["entities"], LO, HI, name="wi1") | zeros_ctes("wi1", "wiz") | baseline_ctes("wiz")
_self["sc"] = SCORED.format(win="wiz")
_self["sv"] = "SELECT *, CASE WHEN NOT judged THEN 'unjudged' WHEN score >= 3.5 THEN 'anomaly' ELSE 'normal' END AS verdict FROM sc"
Q["detect_train_on_window"] = (self_judged, v.sql(_judged_sql, "obs", ctes=_self))


def summary(spark, d):
    out = b.analysis_summary(_analysed(spark, d), ["camera_id"])
    return out.withColumn("coverage", F.round("coverage", 6))


Q["analysis_summary"] = (
    summary,
    v.sql(
        f"""SELECT camera_id, count(*) AS buckets, count(*) FILTER (verdict <> 'unjudged') AS judged, count(*) FILTER (verdict = 'unjudged') AS skipped,
        count(*) FILTER (verdict = 'anomaly') AS anomalies, count(*) FILTER (verdict = 'anomaly' AND above) AS above, count(*) FILTER (verdict = 'anomaly' AND NOT above) AS below,
        round(count(*) FILTER {_occ} / count(*), 6) AS coverage, count(DISTINCT CASE WHEN samples_b >= 3 THEN (start_s // 3600) % 24 END) AS slots_learned
        FROM sv GROUP BY camera_id""", "obs", ctes=analysis_ctes(),
    ),
)


def top(spark, d):
    out = analyse(v.observations(spark, d), "entities", since=LO, until=HI, keys=["camera_id"], settings=AnalysisSettings(period_hours=24, sensitivity=2.0), train_on_window=True)
    return start(b.top_anomalies(out, 8, ["camera_id"])).select("camera_id", "start_s", "value", F.round("score", 6).alias("score"), "severity")


_top = dict(_self)
Q["top_anomalies"] = (
    top,
    v.sql(
        """SELECT camera_id, start_s, value, round(score, 6) AS score, CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS severity
        FROM sc WHERE judged AND score >= 2.0 QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY sc.score DESC, start_s) <= 8""", "obs", ctes=_top,
    ),
)


def report(spark, d):
    out = r.series_report(_full_series(spark, d), "entities", ["camera_id"])
    return out.select(
        "camera_id", "buckets", "occupied", F.round("coverage", 6).alias("coverage"), "total", F.round("typical", 6).alias("typical"), "busiest",
        F.unix_seconds("busiest_start").alias("busiest_s"), "nothing_recorded", "too_few", F.coalesce("coverage_warning", F.lit("-")).alias("coverage_warning"),
    )


Q["series_report"] = (
    report,
    v.sql(
        f"""SELECT camera_id, buckets, occupied, round(occupied / buckets, 6) AS coverage, total, round(mean, 6) AS typical, CASE WHEN occupied >= 6 THEN peak END AS busiest,
        CASE WHEN occupied >= 6 THEN peak_s END AS busiest_s, occupied = 0 AS nothing_recorded, occupied BETWEEN 1 AND 5 AS too_few,
        CASE WHEN occupied / buckets < 0.25 THEN 'low' WHEN occupied / buckets < 0.7 THEN 'partial' ELSE '-' END AS coverage_warning FROM (
        SELECT camera_id, count(*) AS buckets, count(*) FILTER {_occ} AS occupied, sum(value) AS total, avg(value) FILTER {_occ} AS mean, max(value) AS peak,
        arg_max(start_s, value * 100000 - bucket) AS peak_s FROM z GROUP BY camera_id)""", "obs", ctes=_full_c,
    ),
)


def verdicts(spark, d):
    out = r.analysis_report(_analysed(spark, d), ["camera_id"])
    return out.select("camera_id", "anomalies", "nothing_judged", "mostly_unjudged", "maybe_camera_fault", F.coalesce("coverage_warning", F.lit("-")).alias("coverage_warning"))


Q["analysis_report"] = (
    verdicts,
    v.sql(
        f"""SELECT camera_id, count(*) FILTER (verdict = 'anomaly') AS anomalies, count(*) FILTER (judged) = 0 AS nothing_judged,
        count(*) FILTER (judged) > 0 AND count(*) FILTER (NOT judged) / count(*) > 0.5 AS mostly_unjudged, count(*) FILTER (verdict = 'anomaly' AND NOT above) > 0 AS maybe_camera_fault,
        CASE WHEN count(*) FILTER {_occ} / count(*) < 0.25 THEN 'low' WHEN count(*) FILTER {_occ} / count(*) < 0.7 THEN 'partial' ELSE '-' END AS coverage_warning
        FROM sv GROUP BY camera_id""", "obs", ctes=analysis_ctes(),
    ),
)


def chart(spark, d):
    r.check_payload(MID, HI, 3600.0, "entities")
    ser = s.bucket_series(v.observations(spark, d), "entities", since=MID, until=HI, keys=["camera_id"])
    return start(r.chart_buckets(ser, ["camera_id"])).select("camera_id", "start_s", "value", "samples", "known_zero")


Q["chart_buckets"] = (
    chart, v.sql("SELECT camera_id, start_s, round(value, 4) AS value, samples, FALSE AS known_zero FROM ser", "obs", ctes=series_ctes("obs", VALUE["entities"], MID, HI)),
)


def chart_list(spark, d):
    return start(r.chart_anomalies(_analysed(spark, d), ["camera_id"])).drop("bucket_start")


Q["chart_anomalies"] = (
    chart_list,
    v.sql(
        """SELECT camera_id, start_s, round(value, 3) AS observed, round(centre, 3) AS expected, CASE WHEN above THEN 'above' ELSE 'below' END AS direction,
        round(score, 2) AS score, CASE WHEN sv.score >= 8 THEN 'high' WHEN sv.score >= 5 THEN 'medium' ELSE 'low' END AS severity
        FROM sv WHERE verdict = 'anomaly' ORDER BY sv.score DESC, start_s LIMIT 50""", "obs", ctes=analysis_ctes(),
    ),
)


def power(spark, d):
    ser = _training(spark, d)
    base = b.learn_baseline(ser, ["camera_id"], period_hours=24)
    out = b.detection_power(
        ser.join(base.select("camera_id", F.col("slot").alias("_slot"), F.col("centre").alias("_c")), (ser.camera_id == base.camera_id) & (slot_index(F.col("bucket_start"), 24) == F.col("_slot")))
        .drop(base.camera_id),
        base, (1.15, 1.5, 2.0, 2.5), F.col("_c"), F.hour("bucket_start") == 12, ["camera_id"], period_hours=24,
    )
    return out.select("multiple", "trials", F.round("hit_rate", 6).alias("hit_rate"))


Q["detection_power"] = (
    power,
    v.sql(
        """SELECT m.multiple, count(*) AS trials, round(avg(CASE WHEN abs(centre * m.multiple - centre) / spread >= 3.5 AND samples_b >= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
        FROM (SELECT z.*, bs.centre, bs.spread, bs.samples AS samples_b FROM z JOIN bs ON bs.camera_id = z.camera_id AND bs.slot = (z.start_s // 3600) % 24) x,
        (VALUES (1.15::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (2.5::DOUBLE)) m(multiple) WHERE (start_s // 3600) % 24 = 12 GROUP BY m.multiple""", "obs", ctes=_train_c,
    ),
)


TRIALS, DAYS = 20, 14


def characterised(spark, d):
    """False alarms per week and the smallest rise seen, from days drawn of each camera's own history."""
    out = b.characterise(_full_series(spark, d), ["camera_id"], trials=TRIALS, training=DAYS, sizes=(0.5, 1.0, 2.0), period_hours=24)
    rate = lambda k: F.round(F.get("hit_rates", F.lit(k))["rate"], 6)
    none = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return out.select("camera_id", F.round("false_alarms_per_week", 6).alias("false_alarms_per_week"), "worst_week", *[rate(k).alias(f"hit_{k}") for k in range(3)], none("seen_half"), none("seen_mostly"))


_MD5 = "('0x' || substr(md5(concat(trial, ':', {})), 1, 8))::BIGINT"
_drawn = _full_c | {
    "dr": f"SELECT *, {_MD5.format('pos')} % {(HI - LO) // 86400} AS block FROM (SELECT DISTINCT camera_id FROM z), range({TRIALS}) a(trial), range({DAYS + 1}) c(pos)",
    "bt": "SELECT z.camera_id || ':' || trial AS camera_id, z.camera_id AS cam, trial, pos, start_s, value, samples, known_zero FROM dr JOIN z ON z.camera_id = dr.camera_id AND z.bucket // 24 = dr.block",
    "btr": "SELECT * FROM bt WHERE pos > 0",
} | baseline_ctes("btr") | {
    "al": """SELECT cam, trial, 7.0::DOUBLE * count(*) FILTER ((bt.samples > 0 OR known_zero) AND bs.samples >= 3 AND abs(value - centre) / spread >= 3.5) AS n FROM bt
        LEFT JOIN bs ON bs.camera_id = bt.camera_id AND bs.slot = (start_s // 3600) % 24 WHERE pos = 0 GROUP BY cam, trial""",
    "pw": f"""SELECT cam, size, avg(CASE WHEN samples >= 3 AND abs(centre * size) / spread >= 3.5 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM (SELECT split_part(camera_id, ':', 1) AS cam, CAST(split_part(camera_id, ':', 2) AS BIGINT) AS trial, * EXCLUDE (camera_id) FROM bs),
        (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) m(size) WHERE slot = {_MD5.format("'slot'")} % 24 GROUP BY cam, size""",
}
Q["characterise"] = (
    characterised,
    v.sql(
        """SELECT a.cam AS camera_id, round(f, 6) AS false_alarms_per_week, w AS worst_week, round(r0, 6) AS hit_0, round(r1, 6) AS hit_1, round(r2, 6) AS hit_2, coalesce(h, -1) AS seen_half, coalesce(m, -1) AS seen_mostly
        FROM (SELECT cam, avg(n) AS f, max(n) AS w FROM al GROUP BY cam) a LEFT JOIN (SELECT cam, max(rate) FILTER (size = 0.5) AS r0, max(rate) FILTER (size = 1) AS r1, max(rate) FILTER (size = 2) AS r2,
        min(size) FILTER (rate >= 0.5) AS h, min(size) FILTER (rate >= 0.95) AS m FROM pw GROUP BY cam) b ON a.cam = b.cam""", "obs", ctes=_drawn,
    ),
)


def scored_sets(spark, d):
    """Planted hours are every 97th; flagged ones those over 1.5 spreads."""
    from scenelake.operators.scoring import anomaly_scores

    out = analyse(v.observations(spark, d), "entities", since=LO, until=HI, keys=["camera_id"], settings=AnalysisSettings(period_hours=24, sensitivity=1.5), train_on_window=True)
    flagged = out.where("verdict = 'anomaly'").select("camera_id", "bucket")
    planted = out.where("bucket % 97 = 0").select("camera_id", "bucket")
    return anomaly_scores(flagged, planted, ["camera_id"], ["bucket"]).withColumn("recall", F.round("recall", 6))


Q["anomaly_scores"] = (
    scored_sets,
    v.sql(
        """SELECT camera_id, count(*) FILTER (f AND p) AS found, count(*) FILTER (p AND NOT f) AS missed, count(*) FILTER (f AND NOT p) AS false_positives,
        round(count(*) FILTER (f AND p) / count(*) FILTER (p), 6) AS recall, count(*) FILTER (f <> p) = 0 AS passed
        FROM (SELECT camera_id, bucket % 97 = 0 AS p, judged AND score >= 1.5 AS f FROM sc) WHERE f OR p GROUP BY camera_id""", "obs", ctes=_self,
    ),
)


def moments(spark, d):
    o = v.observations(spark, d)
    ts = F.col("timestamp")
    return o.select(
        "id",
        slot_index(ts, 168).cast("long").alias("week_slot"),
        slot_index(ts, 24).cast("long").alias("day_slot"),
        bucket_index(epoch_s(ts), MID, 5400.0).alias("bucket"),
        F.unix_seconds(local_midnight(ts)).alias("midnight"),
        F.unix_seconds(next_local_midnight(ts)).alias("next_midnight"),
        F.round(small_sample_correction(F.col("k")), 6).alias("correction"),
        anomaly_severity(F.col("speed") * 2).alias("severity"),
    )


Q["time_and_score_expressions"] = (
    moments,
    v.sql(
        f"""SELECT id, (isodow(timestamp) - 1) * 24 + hour(timestamp) AS week_slot, hour(timestamp) AS day_slot, CAST(floor((us / 1000000.0 - {MID}) / 5400) AS BIGINT) AS bucket,
        epoch_us(date_trunc('day', timestamp)) // 1000000 AS midnight, epoch_us(date_trunc('day', timestamp)) // 1000000 + 86400 AS next_midnight,
        round({correction('k')}, 6) AS correction, CASE WHEN speed * 2 >= 8 THEN 'high' WHEN speed * 2 >= 5 THEN 'medium' ELSE 'low' END AS severity FROM obs""", "obs",
    ),
)
