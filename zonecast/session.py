"""Session settings and the shared scratch folder that every stage table is written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "zonecast", cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans count on. None of them changes a result except the time zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # lets a join on (zone, date) reuse a partitioning on zone, which the panel windows need next
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for stage tables: the cluster's spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="zonecast-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/zonecast-{sc.applicationId}"


_STAGE_TABLES: dict[str, list[str]] = {}


def drop_tables(spark: SparkSession, scope: str) -> None:
    """Delete the tables that were written while `scope` was open and close it.

    For a caller that has stored what it made of them: nothing that still reads them may be used afterwards.
    """
    jvm = spark.sparkContext._jvm
    for path in _STAGE_TABLES.pop(scope, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def table_scope(scope: str) -> Iterator[None]:
    """Tables written inside belong to `scope`, for `drop_tables`."""
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)


_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and gives the optimizer the true size of the table, so a later
    automatic broadcast rests on a measured size.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scope := _SCOPE.get():
        _STAGE_TABLES.setdefault(scope, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
