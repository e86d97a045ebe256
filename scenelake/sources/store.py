"""Reading, appending, pruning and counting the stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.clock import epoch_s, us
from scenelake.session import settle, settled
from scenelake.sources.schemas import PARTITIONS, TABLES


def _at(kind: str, path: str) -> str:
    if kind not in TABLES:
        raise ValueError(f"unknown table {kind!r}; available: {', '.join(TABLES)}")
    return f"{path.rstrip('/')}/{kind}"


def read_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A stored table under its fixed schema; an absent one reads as empty."""
    where = _at(kind, path)
    schema = f"{TABLES[kind]}, dt date"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(where)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "observations", path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "events", path)


def read_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "heartbeat", path)


def parse_list_column(c: Column) -> Column:
    """``,a,b,`` to an array; empty parts dropped, null to an empty array."""
    return F.coalesce(F.filter(F.split(c, ","), lambda x: x != ""), F.array().cast("array<string>"))


def format_list_column(c: Column) -> Column:
    """An array to ``,a,b,``; empty to null."""
    return F.when(F.size(c) > 0, F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")))


def parse_evidence(c: Column) -> Column:
    """A JSON object to a map; text that is not one surfaces under ``_unparsed``, nothing fails."""
    parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
    raw = F.create_map(F.lit("_unparsed"), c)
    return F.when(c.isNull() | (c == ""), F.create_map().cast("map<string,string>")).otherwise(F.coalesce(parsed, raw))


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """The table's columns and types, with its partition date."""
    shaped = df.sparkSession.createDataFrame([], TABLES[kind]).schema
    missing = {f.name: F.lit(None).cast(f.dataType) for f in shaped if f.name not in df.columns}
    full = df.withColumns(missing) if missing else df
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in shaped]
    return full.select(*cols, F.to_date("timestamp").alias("dt"))


def append_records(df: DataFrame, kind: str, path: str) -> None:
    """Append rows. The rebalance splits a busy camera's day over several tasks and merges quiet ones."""
    rows = _stored(df, kind).hint("rebalance", *PARTITIONS)
    order = [*PARTITIONS, *(["entity_id"] if "entity_id" in rows.columns else []), "timestamp"]
    rows.sortWithinPartitions(*order).write.mode("append").partitionBy(*PARTITIONS).parquet(_at(kind, path))


def append_once(df: DataFrame, kind: str, path: str, staging: str) -> None:
    """Append rows so that a repeated call with the same ``staging`` folder adds nothing.

    The rows are written to the staging folder first. Once that is complete its files, and never newly
    written ones, are moved into the table one by one; a call after a crash moves what is left.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.Path(staging)
    fs = folder.getFileSystem(conf)
    if not fs.exists(jvm.Path(f"{staging}/_SUCCESS")):
        rows = _stored(df, kind).hint("rebalance", *PARTITIONS)
        rows.sortWithinPartitions(*PARTITIONS, "timestamp").write.mode("overwrite").partitionBy(*PARTITIONS).parquet(staging)
    root, table = fs.makeQualified(folder).toString(), jvm.Path(_at(kind, path))
    files = fs.listFiles(folder, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith(("_", ".")):
            continue
        inside = file.getParent().toString()[len(root) + 1 :]
        target = jvm.Path(table, inside) if inside else table
        fs.mkdirs(target)
        if not fs.rename(file, jvm.Path(target, file.getName())):
            raise OSError(f"cannot move {file.getName()} into {table}")


def route_records(batch: DataFrame, path: str, staging: str | None = None) -> None:
    """One mixed batch (column ``kind`` and a struct per table) to its three tables.

    Read once from a settled copy, however many tables it feeds; with ``staging`` (a folder of this
    batch alone) a repeated call adds nothing.
    """
    with settled(batch) as kept:
        for kind in TABLES:
            if kind in kept.columns:
                rows = kept.where(F.col("kind") == kind).select(f"{kind}.*")
                if staging:
                    append_once(rows, kind, path, f"{staging}/{kind}")
                else:
                    append_records(rows, kind, path)


def prune(spark: SparkSession, path: str, horizons: Mapping[str, float]) -> DataFrame:
    """Delete rows older than each table's own horizon (epoch seconds); one row per table with the count.

    Partitions of the boundary day that keep rows are overwritten by a settled copy of these rows;
    partitions without any are then removed under the names their files really have. A crash in
    between leaves old rows for the next call and loses none.
    """
    removed = []
    for kind, before in horizons.items():
        table = read_table(spark, kind, path)
        cut = F.timestamp_micros(F.lit(us(before)))
        old = (F.col("timestamp") < cut) & (F.col("dt") <= F.to_date(cut))
        removed.append((kind, table.where(old).count()))
        if removed[-1][1] == 0:
            continue
        rows = table.where(F.col("dt") <= F.to_date(cut)).select(*table.columns, F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1).alias("_folder"))
        folders = settle(rows.groupBy("_folder").agg(F.count_if(old).alias("gone"), F.count_if(F.col("timestamp") >= cut).alias("stay")).where("gone > 0"))
        mixed = settle(rows.where(F.col("timestamp") >= cut).join(folders.where("stay > 0"), "_folder", "left_semi").drop("_folder"))
        mixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(_at(kind, path))
        _drop_folders(spark, folders.where("stay = 0"))
    return spark.createDataFrame(removed, "table string, removed long")


def _drop_folders(spark: SparkSession, folders: DataFrame) -> None:
    """Remove partition folders. Their names stream through the driver one at a time, no rows do."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in folders.select("_folder").toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["_folder"]))
        folder.getFileSystem(conf).delete(folder, True)


def store_counts(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Rows per table and the whole seconds the observations span."""
    ts = epoch_s(F.col("timestamp"))
    o = observations.agg(F.count(F.lit(1)).alias("observations"), F.floor(F.max(ts) - F.min(ts)).cast("long").alias("span_s"))
    e = events.agg(F.count(F.lit(1)).alias("events"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(o).join(one(e), "_one").select("events", "observations", F.coalesce("span_s", F.lit(0)).alias("span_s"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes on disk of all three tables, from the file listing."""
    total = 0
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for kind in TABLES:
        where = jvm.Path(_at(kind, path))
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(where):
            total += fs.getContentSummary(where).getLength()
    return total
