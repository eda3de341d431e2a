"""Bounded samples of labelled texts for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, wanted: Column, most: int | None) -> DataFrame:
    """Texts of at most `most` rows of `labels(doc_id, ...)` that are `wanted`, chosen by a hash of the id.

    The ids are chosen first: each task sends its `most` smallest hashes, so the broadcast is bounded by `most` ids of 8 bytes.
    None takes all rows that are wanted, by a plain join.
    """
    ids = labels.filter(wanted & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if most is None:
        return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def texts(rows: DataFrame) -> list[str]:
    """The sampled texts, in an order that does not depend on tasks."""
    found = [(r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()]
    return [t for _, t in sorted(found)]
