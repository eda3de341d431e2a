"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it owns more than 1/HOT_KEYS of the rows, so there are fewer than HOT_KEYS hot keys: that bounds
# the broadcast below whatever the size of the tables.
HOT_KEYS = 1000


def hot_keys(facts: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Hot keys of `facts` with `_salts`, the number of pieces each is to be split into."""
    counts = facts.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * HOT_KEYS > total).select(
        *keys, F.ceil(F.col("_n") * HOT_KEYS / total).cast("int").alias("_salts")
    )


def lookup_join(
    facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join `facts` to `dim`, which holds each key once.

    A caller that knows the hot keys passes them (`hot_keys`): their fact rows spread over `_salts` buckets and the one
    matching row of `dim` is copied to each bucket. Any other join is plain: the inputs are written tables, so Spark
    knows their sizes, and splits a skewed partition of `facts` at run time.
    """
    if hot is None:
        return facts.join(dim, keys, how)
    hot = F.broadcast(hot)
    # salted by row content, so that a task run again after a lost executor puts every row where it was
    spread = F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int")
    # a null key matches nothing, so its rows may go anywhere
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    anywhere = F.pmod(F.xxhash64(*facts.columns), F.lit(HOT_KEYS)).cast("int")
    salt = F.when(no_key, anywhere).otherwise(F.coalesce(spread, F.lit(0)))
    left = facts.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = dim.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
