"""Matching labelled vectors: galleries with consent, best and runner-up, votes per track, audit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.vectors import unit
from scenelake.plans.bounds import fits
from scenelake.session import settle

UNKNOWN = "unknown"
THRESHOLD = 0.363
MARGIN = 0.05
GALLERY_BLOCK = 4_096
# Audit actions.
AUDIT_ACTIONS = ("enrolled", "revoked", "identified", "rejected")


def centroid(vectors: DataFrame, by: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label scaled to length 1, and how many went into it.

    Averaged per coordinate with partial sums, so a label of any size stays spread out.
    """
    dims = vectors.select(F.col(by).alias("name"), F.posexplode(vector).alias("_d", "_v"))
    mean = dims.groupBy("name", "_d").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    per = mean.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_a"), F.max("_n").alias("samples"))
    return per.select("name", unit(F.col("_a._m")).alias("template"), "samples")


def build_gallery(vectors: DataFrame, by: str = "label", vector: str = "embedding", *, consent: str, dimensions: int) -> DataFrame:
    """Templates of the labels that consented, from vectors of the right length."""
    usable = vectors.where(F.coalesce(F.col(consent), F.lit(False)) & (F.size(vector) == dimensions) & (F.trim(F.col(by).cast("string")) != ""))
    return centroid(usable, by, vector)


def refused_vectors(vectors: DataFrame, by: str = "label", vector: str = "embedding", *, consent: str, dimensions: int) -> DataFrame:
    """How many rows enrolment refused, by reason."""
    reason = F.when(~F.coalesce(F.col(consent), F.lit(False)), "no_consent").when(F.size(vector) != dimensions, "wrong_length").when(
        F.trim(F.col(by).cast("string")) == "", "no_name"
    )
    return vectors.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _top_two(probes: np.ndarray, names: np.ndarray, templates: np.ndarray) -> dict[str, np.ndarray]:
    """Best and runner-up cosine per probe; names are in order, so equals go to the earlier name."""
    size = np.linalg.norm(probes, axis=1)[:, None] * np.linalg.norm(templates, axis=1)[None, :]
    raw = probes @ templates.T
    scores = np.where(size > 1e-9, raw / np.where(size > 1e-9, size, 1.0), 0.0)
    first = scores.argmax(axis=1)
    at = np.arange(len(probes))
    best = scores[at, first]
    if len(names) == 1:
        none = np.full(len(probes), None, dtype=object)
        return {"best": names[first], "best_score": best, "second": none, "second_score": np.full(len(probes), np.nan)}
    rest = scores.copy()
    rest[at, first] = -np.inf
    second = rest.argmax(axis=1)
    return {"best": names[first], "best_score": best, "second": names[second], "second_score": rest[at, second]}


_TOP = "best string, best_score double, second string, second_score double"


def _stack(values) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in values])


def _against_one_block(probes: DataFrame, gallery: DataFrame, key: str, vector: str) -> DataFrame:
    """The whole gallery, its size checked, goes to every task; probes are not shuffled."""
    rows = gallery.select(F.col("name").cast("string"), "template").orderBy("name").collect()
    shared = probes.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=object), _stack([r[1] for r in rows])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, templates = shared.value
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], **_top_two(_stack(pdf[vector]), names, templates)})

    kind = probes.schema[key].dataType.simpleString()
    return probes.select(key, vector).mapInPandas(run, f"{key} {kind}, {_TOP}")


def _against_blocks(probes: DataFrame, gallery: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """A gallery of any size: every block meets every share of the probes, and only the best two per
    probe and block leave a task."""
    blocks = max(1, -(-gallery.count() // block) * 2)
    shares = max(blocks, int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    g = gallery.select(F.col("name").cast("string").alias("name"), "template")
    g = g.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(blocks))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    p = probes.select(key, vector).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))
    p = p.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    kind = probes.schema[key].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            none = pd.Series([], dtype=object)
            return pd.DataFrame({key: left[key].iloc[:0], "best": none, "best_score": np.empty(0), "second": none, "second_score": np.empty(0)})
        right = right.sort_values("name", kind="stable")
        names, templates = np.array(list(right["name"]), dtype=object), _stack(right["template"])
        chunks = [_top_two(_stack(left[vector].iloc[at : at + 8_192]), names, templates) for at in range(0, len(left), 8_192)]
        top = {c: np.concatenate([part[c] for part in chunks]) for c in chunks[0]}
        text = {c: pd.Series(top[c], dtype=object) for c in ("best", "second")}
        return pd.DataFrame({key: left[key].to_numpy(), **top, **text})

    per = p.groupBy("_b", "_s").cogroup(g.groupBy("_b", "_s")).applyInPandas(run, f"{key} {kind}, {_TOP}")
    rank = lambda name, score: F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))
    found = per.select(key, F.inline(F.array(F.struct(rank("best", "best_score").alias("r")), F.struct(rank("second", "second_score").alias("r")))))
    found = found.where(F.col("r.n").isNotNull())
    top = found.groupBy(key).agg(F.min("r").alias("_1"), F.array_sort(F.collect_list("r")).alias("_all"))
    second = F.try_element_at("_all", F.lit(2))
    return top.select(key, F.col("_1.n").alias("best"), (-F.col("_1.s")).alias("best_score"), second["n"].alias("second"), (-second["s"]).alias("second_score"))


def top2_similarity(probes: DataFrame, gallery: DataFrame, key: str = "vec_id", vector: str = "embedding", *, block: int = GALLERY_BLOCK) -> DataFrame:
    """Best and runner-up template per probe by cosine."""
    if gallery.isEmpty():
        return probes.select(
            key, F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("best_score"), F.lit(None).cast("string").alias("second"), F.lit(0.0).alias("second_score")
        )
    if fits(gallery, block):
        return _against_one_block(probes, gallery, key, vector)
    return _against_blocks(probes, gallery, key, vector, block)


def match_gallery(
    probes: DataFrame,
    gallery: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    block: int = GALLERY_BLOCK,
) -> DataFrame:
    """A name only when the best is similar enough and clearly ahead of the runner-up, else ``unknown``."""
    top = top2_similarity(probes, gallery, key, vector, block=block)
    runner = F.coalesce(F.nanvl("second_score", F.lit(0.0)), F.lit(0.0))
    sure = (F.col("best_score") >= threshold) & (F.col("second").isNull() | (F.col("best_score") - runner >= margin))
    return top.select(
        key,
        F.when(F.col("best").isNotNull() & sure, F.col("best")).otherwise(UNKNOWN).alias("name"),
        F.col("best_score").alias("similarity"),
        F.col("second").alias("runner_up"),
        runner.alias("runner_up_similarity"),
    )


def audit_rows(names: DataFrame, action: str, at: float, detail: str = "") -> DataFrame:
    """One audit row per name."""
    if action not in AUDIT_ACTIONS:
        raise ValueError(f"unknown audit action {action!r}")
    return names.select(
        F.timestamp_micros(F.lit(round(at * 1e6))).alias("timestamp"), F.lit(action).alias("action"), F.col("name").cast("string").alias("name"), F.lit(detail).alias("detail")
    )


def revoke(gallery: DataFrame, name: str, at: float) -> tuple[DataFrame, DataFrame]:
    """The gallery without a name, and the audit row if it was there. The template itself is gone."""
    hit = gallery.where(F.col("name").cast("string") == name).select("name").limit(1)
    return gallery.where(F.col("name").cast("string") != name), audit_rows(hit, "revoked", at, "template deleted")


def audit_trail(audit: DataFrame, *, since: float | None = None, name: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first by (timestamp, id)."""
    if since is not None:
        audit = audit.where(F.col("timestamp") >= F.timestamp_micros(F.lit(round(since * 1e6))))
    if name:
        audit = audit.where(F.col("name") == name)
    return audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def gallery_counts(gallery: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows of both tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in (("identities", gallery), ("audit_records", audit))]
    return parts[0].unionByName(parts[1])


def vote_identity(
    matches: DataFrame,
    keys: Sequence[str] = ("source_id", "track_id", "island"),
    *,
    interval: int = 10,
    min_votes: int = 3,
    max_attempts: int = 25,
    reverify: int = 150,
) -> DataFrame:
    """Name per track from repeated matches; one row per verdict, ``rejected`` where a re-check disagreed.

    ``age`` is the 1-based step of the track a match was made on, ``name``/``similarity`` its outcome.
    Until resolved every ``interval``-th step counts, ``max_attempts`` at most; the first name with
    ``min_votes`` is committed. Afterwards every ``reverify`` steps the name is checked; disagreement
    starts over. One round per restart, over the tracks that still have one.
    """
    keys = list(keys)
    rows = settle(matches.select(*keys, "age", "name", "similarity"))
    starts = rows.select(*keys).distinct().withColumn("_from", F.lit(0).cast("long"))
    verdicts = None
    while True:
        open_ = rows.join(starts, keys).where((F.col("age") > F.col("_from")) & (F.pmod("age", F.lit(interval)) == 0))
        attempts = _first_attempts(open_, keys, max_attempts)
        one = F.struct("age", "name", "similarity")
        seq = attempts.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_a"))
        votes = F.transform(
            F.sequence(F.lit(1), F.size("_a")),
            lambda i: F.size(F.filter(F.slice("_a", 1, i), lambda m: m["name"] == F.element_at("_a", i)["name"])),
        )
        seq = seq.withColumn("_at", F.array_position(F.transform(votes, lambda v: v >= min_votes), F.lit(True)).cast("int"))
        spent = (F.col("_at") == 0) & (F.size("_a") >= max_attempts)
        won = F.element_at("_a", F.greatest(F.col("_at"), F.lit(1)))
        last = F.element_at("_a", -1)
        resolved = settle(
            seq.where((F.col("_at") > 0) | spent).select(
                *keys,
                F.when(spent, last["age"]).otherwise(won["age"]).alias("resolved_at"),
                F.when(spent, UNKNOWN).otherwise(won["name"]).alias("name"),
                F.when(spent, 0.0).otherwise(won["similarity"]).alias("similarity"),
                F.when(spent, F.lit(max_attempts)).otherwise(F.col("_at")).alias("attempts"),
            )
        )
        named = resolved.withColumn("action", F.when(F.col("name") == UNKNOWN, "rejected").otherwise("identified"))
        named = named.select(*keys, F.col("resolved_at").alias("age"), "action", "name", "similarity", "attempts")
        verdicts = named if verdicts is None else verdicts.unionByName(named)
        if not reverify:
            return verdicts
        checks = rows.join(resolved.select(*keys, "resolved_at", F.col("name").alias("_held")), keys).where(
            (F.col("age") > F.col("resolved_at")) & (F.pmod(F.col("age") - F.col("resolved_at"), F.lit(reverify)) == 0) & (F.col("name") != F.col("_held"))
        )
        broken = settle(checks.groupBy(*keys).agg(F.min(F.struct("age", "_held", "similarity")).alias("_b")))
        if broken.isEmpty():
            return verdicts
        verdicts = verdicts.unionByName(
            broken.select(*keys, F.col("_b.age").alias("age"), F.lit("rejected").alias("action"), F.col("_b._held").alias("name"), F.col("_b.similarity").alias("similarity"), F.lit(0).alias("attempts"))
        )
        starts = broken.select(*keys, F.col("_b.age").alias("_from"))


def _first_attempts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` matches per track; the rank limit also runs before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("age"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
