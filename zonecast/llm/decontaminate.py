"""Benchmark decontamination (native): a positional inverted index of the training text, searched from the rarest terms.

`build_index` stores a posting (term, document, position) for every word of every document; each part of the table is one shard,
sorted by term. `search` ranks the terms of a test window by their count in the index, takes the two rarest posting lists, shifts
them by the term's offset in the window and intersects them; what is left is confirmed on the words of the document. With
`slop`, the two lists may differ by that many places and all words of the window must occur near the place: a proximity match.

Terms are 64-bit hashes in the index; the confirmation compares words, so a collision costs time and nothing else. Test windows
are searched in blocks of at most `BLOCK` windows. That bounds what is broadcast, whatever the size of the test set, and the
index is scanned once a block without moving it.

Defined results: null or empty texts have no words; an item with fewer words than a window is one window, an item with none is left
out; repeated items and windows are searched once and reported for every item; documents with null or repeated ids are kept apart
row by row; empty tables give empty matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import keyed, lower_ascii, restored, split_words
from zonecast.session import materialize

#: What stands between words, once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows searched at a time: two lists of some 40 bytes each are broadcast, 20 MB at most.
BLOCK = 250_000
#: Keys of candidate documents that are broadcast, 8 MB of them; the number is counted first.
MOST_KEYS = 1_000_000


def tokens(text: Column) -> Column:
    return split_words(lower_ascii(text), GAPS)


def build_index(docs: DataFrame) -> DataFrame:
    """Postings `term, key, pos` of `docs(_key, text)`, written to the shared folder, each shard sorted by term."""
    words = docs.select("_key", F.posexplode(tokens(F.col("text"))).alias("pos", "_word"))
    postings = words.select(F.xxhash64("_word").alias("term"), F.col("_key").alias("key"), "pos")
    return materialize(postings.sortWithinPartitions("term"), "postings")


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows `window_id, phrase, words` and their `window_id, item_id` of `items(item_id, text)`."""
    split = items.select("item_id", tokens(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - size, F.lit(0)) + 1
    cut = split.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("_w", i, size))).alias("words"))
    cut = materialize(cut.select("item_id", F.array_join("words", " ").alias("phrase")).distinct(), "windows")
    ids = materialize(cut.select("phrase").distinct().withColumn("window_id", F.monotonically_increasing_id()), "phrases")
    return ids.withColumn("words", F.split("phrase", " ")), cut.join(ids, "phrase").select("window_id", "item_id")


def _rarest_lists(index: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """The two rarest terms of each window: `window_id, block, term, offset, lists`.

    A window with a term that the index does not hold cannot occur and is left out here.
    """
    terms = windows.select("window_id", F.posexplode("words").alias("offset", "_word"))
    terms = terms.select("window_id", "offset", F.xxhash64("_word").alias("term"))
    wanted = materialize(terms.select("term").distinct(), "terms")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    # a block has some BLOCK * WINDOW terms of 8 bytes at most
    found = [index.join(F.broadcast(wanted.filter(block == b)), "term", "left_semi") for b in range(blocks)]
    counts = reduce(DataFrame.unionByName, found).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = terms.join(materialize(counts, "counts"), "term", "left").groupBy("window_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("_by")
    )
    ranked = ranked.filter(F.element_at("_by", 1)["n"] > 0).withColumn("_two", F.slice("_by", 1, 2))
    lists = ranked.select(
        "window_id", F.pmod(F.xxhash64("window_id"), F.lit(blocks)).alias("block"),
        F.size("_two").alias("lists"), F.posexplode("_two").alias("rank", "_t"),
    )
    return lists.select("window_id", "block", "lists", "rank", F.col("_t.term").alias("term"), F.col("_t.offset").alias("offset"))


def _texts_of(docs: DataFrame, met: DataFrame) -> DataFrame:
    """`_key, text, _met` of the documents that `met(key, _met)` names.

    As long as the keys are few enough to be sent to every task, texts without a candidate are dropped where they are read. Beyond that
    number all texts are dealt by key; the rows are the same.
    """
    if met.count() <= MOST_KEYS:
        docs = docs.join(F.broadcast(met.select(F.col("key").alias("_key"))), "_key", "left_semi")
    return docs.join(met.withColumnRenamed("key", "_key").hint("merge"), "_key")


def search(docs: DataFrame, index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Matches `_key, n_words, hits`: for each document with any, its hits (start, len, window_id, exact).

    `start` counts words from 0. With `slop` 0 only exact phrases are returned. Otherwise a hit whose words all occur within `slop`
    places of the window at `start` is returned too, with exact = false.
    """
    blocks = max(1, -(-windows.count() // BLOCK))
    lists = materialize(_rarest_lists(index, windows, blocks), "lists")
    # the same window in two near places is one candidate per cell of slop + 1 starts; exact phrases need no cell
    start = F.col("pos") - F.col("offset")
    shifted = []
    for b in range(blocks):
        part = F.broadcast(lists.filter(F.col("block") == b).drop("block"))
        at = index.join(part, "term").select("window_id", "key", start.alias("start"), "lists", "rank")
        shifted.append(at)
    shifted = reduce(DataFrame.unionByName, shifted)
    if slop == 0:
        met = shifted.filter("start >= 0").groupBy("window_id", "key", "start").agg(
            F.count(F.lit(1)).alias("_n"), F.max("lists").alias("lists")
        )
        met = met.filter(F.col("_n") == F.col("lists")).select("window_id", "key", "start")
    else:
        # the rarest list names the place, the second is looked up in its cell and both neighbours
        cell = F.floor(F.col("start") / (slop + 1))
        first = shifted.filter("rank = 0").withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        second = shifted.filter("rank = 1").select("window_id", "key", F.col("start").alias("_other"), cell.alias("_cell"))
        near = first.filter("lists = 2").join(second, ["window_id", "key", "_cell"])
        near = near.filter(F.abs(F.col("start") - F.col("_other")) <= slop).select("window_id", "key", "start")
        met = near.unionByName(first.filter("lists = 1").select("window_id", "key", "start")).distinct()
    met = materialize(met, "met").join(windows.select("window_id", "phrase", "words"), "window_id")
    hit = F.struct(
        F.col("start").cast("int").alias("start"), F.size("words").alias("len"), "window_id", "phrase",
        *([F.col("words")] if slop else []),
    )
    met = materialize(met.groupBy("key").agg(F.collect_list(hit).alias("_met")), "met_by_key")
    # written, since every use of the words in a condition would otherwise split the text again
    words = materialize(_texts_of(docs, met).select("_key", tokens(F.col("text")).alias("_words"), "_met"), "candidates")
    words = words.withColumn("n_words", F.size("_words"))

    def exact(h: Column) -> Column:
        inside = (h["start"] >= 0) & (h["start"] + h["len"] <= F.col("n_words"))
        return inside & (F.array_join(F.slice("_words", F.greatest(h["start"], F.lit(0)) + 1, h["len"]), " ") == h["phrase"])

    def close(h: Column) -> Column:
        low = F.greatest(h["start"] - slop, F.lit(0))
        around = F.slice("_words", low + 1, F.greatest(h["start"] + h["len"] + slop - low, F.lit(0)))
        return F.size(F.array_except(h["words"], around)) == 0

    told = F.transform("_met", lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"), h["window_id"].alias("window_id"), exact(h).alias("exact"), (close(h) if slop else exact(h)).alias("_near")))
    hits = F.filter(told, lambda h: h["exact"] | h["_near"])
    hits = F.transform(hits, lambda h: F.struct(h["start"], h["len"], h["window_id"], h["exact"]))
    return materialize(words.select("_key", "n_words", hits.alias("hits")).filter(F.size("hits") > 0), "hits")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base = keyed(docs).drop("_row")
    index = build_index(base)
    windows, owners = windows_of(items, size)
    hits = search(base, index, windows)
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    covered = hits.select("_key", F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    found = hits.select("_key", F.explode(F.array_distinct(F.col("hits.window_id"))).alias("window_id"))
    found = found.join(owners, "window_id").select("_key", F.col("item_id").cast("string").alias("_item")).distinct()
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    sizes = index.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n_words"))
    rows = base.drop("text").join(sizes, "_key", "left").join(covered.join(found, "_key"), "_key", "left")
    return rows.select(
        "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with their columns as they came."""
    base = keyed(docs)
    windows, _ = windows_of(items, size)
    hits = search(base, build_index(base), windows)
    return restored(base.join(hits.select("_key"), "_key", "left_anti"), docs)
