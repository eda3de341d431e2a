"""Alignment of the tokens that two tokenizers make of the same text, by the bytes they cover.

Tokens of both sides lie on one line of bytes. In each batch of documents `pandas.merge_asof`, keyed by document, finds for every
token start the token of the other side that covers it; the union of both directions is the set of overlapping pairs, since the
later start of two overlapping tokens lies in the other token. Places where tokens of both sides end cut a document into groups.

The number of documents that hold a pair of ids is counted over all documents. The `HOT` commonest pairs, which make up nearly all
links, are looked up in the tasks; each rarer pair owns less than 1/HOT of the rows, so the join that finds their counts has no hot key.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and ''. Repeated rows and
null or repeated ids are rows of their own, and each counts as a document. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.session import materialize

#: Pairs looked up in the tasks; bounds what the driver and each task hold of them, at 17 bytes a pair.
HOT = 1 << 17
#: Documents aligned at once.
BATCH = 64

_LONG_RUN = re.compile(r"\S{500}|\s{500}")

_SIDES: dict[tuple[str, str], "Sides"] = {}


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        import os

        import numpy as np
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        self.left = Tokenizer.from_file(byte_level)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = printable_bytes()
        entries = sorted(self.left.get_vocab(with_added_tokens=True).items(), key=lambda e: e[1])
        # entries that are no byte-level text are never the token of a plain text
        self.left_bytes = [bytes(byte.get(c, 0) for c in token) for token, _ in entries]
        # the ids of this vocabulary are the order of its merges, which is all that the faster library needs
        special = self.left.get_added_tokens_decoder()
        ranks = {b: i for i, b in enumerate(self.left_bytes) if i not in special}
        self.fast = tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = self.right.get_piece_size()
        self.right_bytes = [self._piece(i) for i in range(size)]
        self.left_sizes = np.array([len(b) for b in self.left_bytes], dtype=np.int64)
        self.right_sizes = np.array([len(b) for b in self.right_bytes], dtype=np.int64)
        ids = max(len(entries), size)
        self.texts = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(ids)]
        self.ids, self.right_ids = ids, size

    def _piece(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode()

    def _left(self, text: str) -> list[int]:
        """Ids of the byte-level side; a run without white space takes the faster library the square of its length."""
        if _LONG_RUN.search(text):
            return self.left.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none on either side for a text that one of them does not give back."""
        at = [i for i, t in enumerate(texts) if t]
        found = [texts[i] for i in at]
        left = [self._left(" " + t) for t in found]
        right = self.right.encode(found, out_type=int, num_threads=1) if found else []
        a, b = [[] for _ in texts], [[] for _ in texts]
        for i, text, x, y in zip(at, found, left, right, strict=True):
            whole = b" " + text.encode()
            if b"".join(map(self.left_bytes.__getitem__, x)) == whole == b"".join(map(self.right_bytes.__getitem__, y)):
                a[i], b[i] = x, y
        return a, b


def sides(byte_level: str, pieces: str) -> Sides:
    """The tokenizers of this Python worker, kept from task to task."""
    if (byte_level, pieces) not in _SIDES:
        _SIDES[byte_level, pieces] = Sides(byte_level, pieces)
    return _SIDES[byte_level, pieces]


def _line(ids, sizes):
    """Document, start and end of each token, with the documents of a batch one after the other on one line of bytes."""
    import numpy as np

    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=len(doc))
    ends = np.cumsum(sizes[flat])
    return doc, flat, ends - sizes[flat], ends


def overlaps(doc_a, start_a, doc_b, start_b):
    """Index pairs (into a, into b) of tokens that share a byte; both sides cover the same bytes of each document."""
    import numpy as np
    import pandas as pd

    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(doc_b))})
    into_b = pd.merge_asof(a, b, on="at", by="doc")
    into_a = pd.merge_asof(b, a, on="at", by="doc")
    # tokens that start together find each other from both sides
    later = start_a[into_a["a"]] != start_b
    return np.concatenate([into_b["a"], into_a["a"][later]]), np.concatenate([into_b["b"], into_a["b"][later]])


def align(texts: list[str | None], both: Sides) -> dict[str, list]:
    """Counts, the hash of the groups, and the linked id pairs (`pairs`, ascending) with their links (`times`), for each text."""
    import numpy as np

    n = len(texts)
    a, b = both.encode(texts)
    doc_a, id_a, start_a, end_a = _line(a, both.left_sizes)
    doc_b, id_b, start_b, end_b = _line(b, both.right_sizes)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)  # both sides ascend
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    in_a, in_b = overlaps(doc_a, start_a, doc_b, start_b)

    # tokens of a group, first the left ones: each with what stands after it
    order = np.lexsort((np.r_[np.zeros(len(id_a)), np.ones(len(id_b))], np.r_[group_a, group_b]))
    group, right = np.r_[group_a, group_b][order], order >= len(id_a)
    after = np.full(len(order), 2)
    after[:-1] = np.where(group[1:] != group[:-1], 2, (right[1:] != right[:-1]).astype(int))
    tokens = np.searchsorted(np.r_[doc_a, doc_b][order], np.arange(n + 1))
    after[tokens[1:][tokens[1:] > tokens[:-1]] - 1] = 3
    names = list(map(both.texts.__getitem__, (np.r_[id_a, id_b][order] + after * both.ids).tolist()))

    pair = id_a[in_a] * both.right_ids + id_b[in_b]
    space = len(both.left_bytes) * both.right_ids
    keys, times = np.unique(doc_a[in_a] * space + pair, return_counts=True)
    at = np.searchsorted(keys, np.arange(n + 1) * space)
    count = lambda docs: np.bincount(docs, minlength=n).tolist()
    return {
        "n_a": count(doc_a), "n_b": count(doc_b), "n_links": count(doc_a[in_a]),
        "n_groups": count(doc_a[np.searchsorted(end_a, cuts)]),
        "groups_sha256": [
            hashlib.sha256("".join(names[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(tokens, tokens[1:])
        ],
        "pairs": [keys[i:j] - k * space for k, (i, j) in enumerate(zip(at, at[1:]))],
        "times": [times[i:j] for i, j in zip(at, at[1:])],
    }


_STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per document: `_row` (unique), doc_id, the counts, and its linked pairs with their number of links."""

    def make():
        both = sides(byte_level, pieces)
        return lambda rows: {"_row": rows["_row"], "doc_id": rows["doc_id"], **align(rows["text"], both)}

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return map_rows(rows, make, schema(f"_row long, doc_id long, {_STATS}, pairs array<long>, times array<int>"), BATCH)


def pair_counts(rows: DataFrame, right_ids: int) -> DataFrame:
    """`pair`, the number of documents that hold it, and whether no other pair of its left id is in more (`best`)."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    left = F.expr(f"pair div {right_ids}")
    # at most one row for each id of the left tokenizer
    top = counts.groupBy(left.alias("left")).agg(F.max("docs").alias("most"))
    return counts.withColumn("left", left).join(F.broadcast(top), "left").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _look_up(rows: DataFrame, hot: list) -> DataFrame:
    """Sums over the pairs in `hot` (pair, docs, best); the other pairs of a row stay with it."""
    import numpy as np

    hot = sorted((r["pair"], r["docs"], r["best"]) for r in hot)
    pairs, docs = (np.array([h[i] for h in hot], dtype=np.int64) for i in (0, 1))
    best = np.array([h[2] for h in hot], dtype=np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((pairs, docs, best))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches):
        import pyarrow as pa

        known, docs, best = sent.value
        for batch in batches:
            flat, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            sizes = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.searchsorted(known, flat)
            found = np.zeros(len(flat), dtype=bool)
            inside = at < len(known)
            found[inside] = known[at[inside]] == flat[inside]
            total = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            for sums, value in zip(total, (best, docs)):
                np.add.at(sums, row[found], times[found] * value[at[found]])
            rest = np.r_[0, np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~found], type=t)) for v, t in ((flat, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(t) for t in total], *lists],
                names=[*names, "n_best", "count_sum", "pairs", "times"],
            )

    return rows.mapInArrow(run, f"_row long, doc_id long, {_STATS}, n_best long, count_sum long, pairs array<long>, times array<int>")


def cross_alignment(docs: DataFrame, byte_level: str, pieces: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of `docs`."""
    rows = materialize(aligned(docs, byte_level, pieces), "aligned")
    counts = materialize(pair_counts(rows, sides(byte_level, pieces).right_ids), "pair_counts")
    commonest = counts.orderBy(F.desc("docs"), "pair").limit(hot).collect()
    found = materialize(_look_up(rows, commonest), "looked_up")
    rare = found.filter(F.size("pairs") > 0).select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    sums = (
        rare.select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(counts, "pair")
        .groupBy("_row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return found.join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256"
    )
