"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only, for UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: White space between words: \x20 and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gaps: str) -> Column:
    """Words of `text` between runs of `gaps`; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gaps), lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """`_key` (unique long), `doc_id`, `text` and `_row`, a struct of all columns as they came.

    `_key` is doc_id where that is never null and never repeated; otherwise rows are numbered once, in a written table,
    so that null and repeated ids name one row each. Other columns are out of the way of the operators' own names.
    """
    unusable = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    row = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    if unusable.isEmpty():
        return row.withColumn("_key", F.col("doc_id"))
    return materialize(row.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from the `_row` that `keyed` made."""
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def crc_fold(doc_id: str, parts: int, held: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == held, F.lit(False))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: T.StructType, size: int = 512) -> DataFrame:
    """`mapInArrow` in slices of at most `size` rows: dicts of lists in, dicts of lists out.

    `make` runs once a task and returns the function for a slice, so models and caches are built where they are used.
    Slices keep what a task holds in Python small, however long single texts are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = work(batch.slice(at, size).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
