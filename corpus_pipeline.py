"""Clean and pack the documents: quality rules, near-dedup, substring dedup, decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of `documents`, but for
the last, which returns the places of the packed pieces. Stages are written as Parquet in the shared folder and read again, so a
lost executor never sets the pipeline back by more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from zonecast.llm import decontaminate, near_dup, packing, quality_rules, substring_dedup
from zonecast.llm.common import table
from zonecast.llm.registry import PACK_END, vocabulary
from zonecast.session import drop_tables, materialize, table_scope


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_passages(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), PACK_END)


SCOPE = "pipeline"


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """`work` after the tables of the stage before are gone; its own belong to the pipeline."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, SCOPE)
        with table_scope(SCOPE):
            return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", stage(good_documents)),
    ("near_dedup", stage(without_near_duplicates)),
    ("substring_dedup", stage(without_repeated_passages)),
    ("decontamination", stage(without_benchmark)),
    ("packing", stage(packed)),
]

#: Verified candidates and packing plans are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = materialize(work(spark, docs, sf_dir), name)
    drop_tables(spark, SCOPE)
    return docs
