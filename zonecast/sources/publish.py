"""Versions of a mart and the manifest that names the current one.

A mart at `path` is written as `path/_versions/<version>` and becomes current when the one-line file `path/_CURRENT` is replaced. A write
that fails or is killed leaves the manifest, and so every reader, with the version before, which is kept until the next publish.
A folder without a manifest is read as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MANIFEST, VERSIONS = "_CURRENT", "_versions"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the mart at `path` now."""
    jvm, where, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(where):
        return path
    stream = fs.open(where)
    try:
        version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path}/{VERSIONS}/{version}"


def draft(path: str) -> str:
    """A folder for the next version."""
    return f"{path}/{VERSIONS}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make the version in `folder` (of `draft`) the current one; versions before the last are deleted."""
    before = current(spark, path)
    jvm, where, fs = _hadoop(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(where, True)
    out.write(folder.rsplit("/", 1)[1].encode())
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    # replaces the manifest in one step
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(where, target, over)
    keep = {p.rsplit("/", 1)[1] for p in (before, folder)}
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSIONS}")):
        if status.getPath().getName() not in keep:
            fs.delete(status.getPath(), True)


def partition_values(spark: SparkSession, folder: str, column: str) -> list[str]:
    """Values of the partition column of a partitioned folder that have data, in order, from its folder names alone."""
    jvm, where, fs = _hadoop(spark, f"{folder}/{column}=*")
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.globStatus(where) or [])
