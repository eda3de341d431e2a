"""Best-fit packing planned on the histogram of piece lengths.

Documents longer than a sequence are cut into pieces. Only the number of pieces of each length goes to the driver: at most `length`
rows, whatever the corpus. `plan` runs best-fit decreasing over those counts: bins with the same contents are one entry with a
count, so planning takes as long for a billion documents as for a thousand. The plan is a list of runs: ranks [first, first + n) of
a length go to consecutive sequences at one offset. Pieces get their rank within their length (partition by partition, so a length
that holds a third of all rows is no single task) and join the run that holds it, by length and block of ranks.

Defined results: a null text is an empty document, which still has its end id; repeated rows are packed each; no rows, no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.llm.tokens import encoder
from zonecast.session import materialize

LENGTH = 4096
#: Pieces find their run by (length, rank // RANKS), so a join key has few runs and at most RANKS pieces.
RANKS = 1 << 16


def pieces(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` (and `ids`, little-endian) of every document of `docs(doc_id, text)`."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def make():
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()

        def work(rows: dict) -> dict:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            for doc_id, ids in zip(rows["doc_id"], encode(rows["text"])):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    values = doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part
                    for k, v in zip(out, values):
                        out[k].append(v)
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, schema(fields))


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, copies a sequence, offset) of best-fit decreasing.

    `counts` has the number of pieces of each length. Rank first + j * copies + t goes to sequence + j, at offset + t * length.
    """
    # bins by room left: room -> list of [count, contents]; contents is a chain (length, copies, offset, contents before)
    open_bins: dict[int, list[list]] = {length: []}
    rooms: list[int] = []

    def put(room: int, n: int, contents: tuple | None) -> None:
        if n:
            if room not in open_bins or not open_bins[room]:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append([n, contents])

    def place(size: int, n: int, room: int, bins: int, contents: tuple | None) -> int:
        """Put up to n pieces into `bins` equal bins, as many a bin as fit; returns how many bins were used."""
        a_bin = min(room // size, n)
        full = min(bins, n // a_bin)
        put(room - a_bin * size, full, (size, a_bin, length - room, contents))
        rest = min(n - full * a_bin, a_bin) if full < bins else 0
        if rest:
            put(room - rest * size, 1, (size, rest, length - room, contents))
        return full * a_bin + rest

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n > 0:
            at = bisect_left(rooms, size)
            if at == len(rooms):  # none has room: open new ones
                n -= place(size, n, length, n, None)
                continue
            room = rooms[at]
            bins, contents = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            a_bin = min(room // size, n)
            used = min(bins, -(-n // a_bin))
            put(room, bins - used, contents)
            n -= place(size, n, room, used, contents)

    runs, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for groups in open_bins.values():
        for n, contents in groups:
            while contents:
                size, copies, offset, contents = contents
                runs.append((size, taken[size], n * copies, sequence, copies, offset))
                taken[size] += n * copies
            sequence += n
    assert taken == counts
    return runs


def place(spark: SparkSession, cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to the written table `cut(doc_id, piece, length, _part, ...)`."""
    by_part = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = materialize(by_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `length` rows
    runs = spark.createDataFrame(
        plan(counts, length) or [], "length long, _first long, _ranks long, _sequence long, _copies long, _offset long"
    )
    blocks = F.sequence(F.expr(f"_first div {RANKS}"), F.expr(f"(_first + _ranks - 1) div {RANKS}"))
    runs = runs.withColumn("_block", F.explode(blocks))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start")
    # merged, not broadcast: there are more of these offsets the more tasks there are, and the window has dealt the pieces by the same keys
    ranked = cut.withColumn("_in", F.row_number().over(inside)).join(by_part.drop("_n").hint("merge"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {RANKS}")).join(runs, ["length", "_block"])
    ranked = ranked.filter("_rank >= _first AND _rank < _first + _ranks")
    return ranked.withColumns({
        "sequence_id": F.expr("_sequence + (_rank - _first) div _copies"),
        "offset": F.expr("_offset + (_rank - _first) % _copies * length"),
    }).drop("_part", "_block", "_in", "_before", "_rank", "_first", "_ranks", "_sequence", "_copies", "_offset")


def pack(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). The text is encoded once."""
    cut = pieces(docs, path, end_id, length, with_ids).withColumn("_part", F.spark_partition_id())
    return place(docs.sparkSession, materialize(cut, "pieces"), length)
