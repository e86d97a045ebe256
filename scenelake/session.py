"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(app: str = "scenelake", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own, with ``spark.checkpoint.dir`` on shared storage."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where a local session has none, one folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_SCRATCH[app]


def _settled_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's settled tables; frames built on them can no longer be read."""
    remove_folder(spark, _settled_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write ``df`` and give back the shuffle files of the writing, which nothing reads again."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """``settle`` for the length of a block: the written copy is removed at its end, so nothing built on it may leave the block."""
    path = f"{_settled_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    _write(df, path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(df.sparkSession, path)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that later steps read several times: lineage is cut at a table
    that outlives any executor, and nothing upstream runs twice.
    """
    path = f"{_settled_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        remove_folder(spark, folder)
