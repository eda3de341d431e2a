"""Passages that repeat across documents, by collinear chaining of shared seeds.

1. Seeds: of every `SPAN` successive hashes of `SEED` words the smallest one (a minimizer), so two equal runs of SEED + SPAN - 1
   words always share a seed.
2. A seed that occurs in several documents is anchored at its first holder, the smallest document that has it; every other occurrence is
   matched with that one. So matches grow with the occurrences of a seed, never with their pairs.
3. The matches of a document with one anchor document are chained: the best path of matches that ascend in both documents,
   where a match is worth its words and a gap costs a part of the words it skips in either. A Fenwick tree over anchor places
   gives the best predecessor. Chains are cut at gaps over REACH words.
4. Where parts of a passage were first held by different documents, a shared seed may be left outside of every passage. Around such seeds
   the pairs of seeds that stand FAR apart are matched with the first holder of the pair, and every run of LEAST words around a pair that
   several documents hold with the first holder of that run. Any LEAST words hold such a pair, so a run of them that an earlier
   document holds as well is found whoever first held its parts. Both grow with the occurrences, never with their pairs.
5. Chains are aligned on the words of both documents: between matches, along the better split of the two diagonals, and outwards from
   both ends while matches outweigh the differences. What is at least `LEAST` words long with at least `IDENTITY` of
   them equal is a repeated passage; a chain that falls short is cut at its widest gap and its parts are tried. Its anchor stays, the later occurrence is the copy.

Words are runs of [^\\x20\\x09-\\x0D], compared with A-Z in lower case. Repeats within one document are no copies.

Defined results: null and empty texts and texts under LEAST words hold no passage; of repeated rows and documents with equal texts all
but the first are copies from end to end; null and repeated ids are told apart row by row; no rows, no passages.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import keyed, map_rows, restored, schema
from zonecast.llm.near_dup import Shingler
from zonecast.session import materialize

SEED = 5
SPAN = 8
LEAST = 50
IDENTITY = 0.8
#: What a word skipped in either text costs a chain, in matched words.
GAP_COST = 0.1
#: Longest gap inside a chain, in words.
REACH = 40
#: Words from the first to the second seed of a pair: the least that makes a chain, and what a chain may skip. Of LEAST equal words, the
#: first 8 places hold a seed and so do any 8 places after, hence two that are 26 to 33 apart.
FAR = (LEAST - 2 * (SPAN - 1) - 2 * SEED, REACH)
#: Classes of documents, by their keys, whose first holder of a pair of seeds is matched.
HOLDERS = 1
#: Places of a pair or run in one document that are all matched.
OFTEN = 8
#: Requests for words of one document that travel with one copy of its text, on average.
REQUESTS = 64
#: Extension stops when its score, +1 for an equal word and -2 for another, is this far below its best.
DROP = 12

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seeds_of(hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the minimizers of a text's hashes, in order."""
    n = len(hashes)
    if n <= span:
        return np.array([hashes.argmin()]) if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(windows.argmin(axis=1) + np.arange(n - span + 1))


class Fenwick:
    """Largest value over a prefix of places, each with where it came from."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """Over places below `at`."""
        found = (-np.inf, -1)
        while at > 0:
            found = max(found, self.best[at])
            at -= at & -at
        return found


def chains(x: np.ndarray, y: np.ndarray, width: int = SEED) -> list[list[tuple[int, int, int]]]:
    """Chains of matched runs (start in x, start in y, words) for matches sorted by x.

    Matches that go on along a diagonal within SPAN words are one run, worth its words. Going from run i to a later j costs
    GAP_COST for each word skipped in either text. That is linear in the ends of i and the starts of j, so the best predecessor
    is the largest of score + GAP_COST * (both ends) among the runs that end before j in both texts.
    """
    diagonal = x - y
    order = np.lexsort((x, diagonal))
    x, y, diagonal = x[order], y[order], diagonal[order]
    new = np.ones(len(x), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (x[1:] - x[:-1] > SPAN + width)
    at = np.nonzero(new)[0]
    last = np.append(at[1:], len(x)) - 1
    runs = sorted(zip(x[at].tolist(), y[at].tolist(), (x[last] - x[at] + width).tolist()))
    if len(runs) == 1:
        return [runs]
    ends = sorted({b + n for _, b, n in runs})
    tree = Fenwick(len(ends))
    score, before = [0.0] * len(runs), [-1] * len(runs)
    by_end = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    waiting = 0
    for i, (a, b, n) in enumerate(runs):
        while waiting < len(by_end) and runs[by_end[waiting]][0] + runs[by_end[waiting]][2] <= a:
            j = by_end[waiting]
            ja, jb, jn = runs[j]
            tree.put(bisect_left(ends, jb + jn), (score[j] + GAP_COST * (ja + jb + 2 * jn), j))
            waiting += 1
        value, j = tree.upto(bisect_left(ends, b + 1))
        gained = value - GAP_COST * (a + b)
        score[i] = n + max(gained, 0.0)
        before[i] = j if gained > 0 else -1
    out, used = [], set()
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            if chain and max(chain[-1][0] - runs[i][0], chain[-1][1] - runs[i][1]) - runs[i][2] > REACH:
                out.append(chain[::-1])
                chain = []
            chain.append(runs[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _extend(equal: np.ndarray) -> int:
    """How many places of `equal`, from its start, raise the score to its best before it drops too far."""
    if not len(equal):
        return 0
    score = np.cumsum(np.where(equal, 1, -2))
    best = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.nonzero(best - score > DROP)[0]
    score = score[: stop[0]] if len(stop) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """start and end in `a`, start and end in `b`, and equal words, for a chain between the word hashes of two texts."""
    x0, y0, _ = chain[0]
    n = min(x0, y0)
    back = _extend((a[x0 - n : x0] == b[y0 - n : y0])[::-1])
    start, other = x0 - back, y0 - back
    same, x, y = 0, start, other
    for nx, ny, _ in chain[1:]:
        # one change of diagonal: along the old one first, along the new one after the split that keeps most words equal
        n = min(nx - x, ny - y)
        head = np.concatenate([[0], np.cumsum(a[x : x + n] == b[y : y + n])])
        tail = np.concatenate([[0], np.cumsum((a[nx - n : nx] == b[ny - n : ny])[::-1])])[::-1]
        same += int((head + tail).max()) if n > 0 else 0
        x, y = nx, ny
    n = min(len(a) - x, len(b) - y)
    length = chain[-1][2]
    equal = a[x : x + n] == b[y : y + n]
    last = min(length, n)
    last += _extend(equal[last:])
    same += int(np.count_nonzero(equal[:last]))
    return start, x + last, other, y + last, same


def confirmed(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What `align` gives for the chain if that is a passage, or else for its parts."""
    start, end, other, other_end, same = align(a, b, chain)
    if end - start >= LEAST and same >= IDENTITY * max(end - start, other_end - other):
        return [(start, end, other, other_end, same)]
    if len(chain) == 1:
        return []
    gap = [max(q[0] - p[0], q[1] - p[1]) - p[2] for p, q in zip(chain, chain[1:])]
    cut = gap.index(max(gap)) + 1
    return sorted({*confirmed(a, b, chain[:cut]), *confirmed(a, b, chain[cut:])})


def seed_table(docs: DataFrame) -> DataFrame:
    """`seed, key, pos` of `docs(_key, text)`, written to the shared folder."""
    def make():
        shingler = Shingler()

        def work(rows: dict) -> dict:
            keys, places, hashes = [], [], []
            for key, text in zip(rows["_key"], rows["text"]):
                h = shingler.runs(text, SEED)
                at = seeds_of(h)
                keys.append(np.full(len(at), key, np.int64))
                places.append(at.astype(np.int32))
                hashes.append(h[at].view(np.int64))
            return {"seed": np.concatenate(hashes), "key": np.concatenate(keys), "pos": np.concatenate(places)} if keys else None

        return work

    return materialize(map_rows(docs.select("_key", "text"), make, schema("seed long, key long, pos int")), "seeds")


def _chain_table(matches: DataFrame) -> DataFrame:
    """`key, anchor, chain` from `matches(key, anchor, pos, at)`: chains that may hold a passage once they are extended.

    Rows come sorted by (key, anchor); pairs are cut out of the stream, so a document with many anchors is never held as a whole.
    """
    least = LEAST - 2 * (SPAN - 1) - SEED

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("chain", pa.list_(pa.int32()))])

        def found(key, anchor, x, y):
            if x.max() - x.min() + SEED < least:
                return
            for chain in chains(x, y):
                if chain[-1][0] + chain[-1][2] - chain[0][0] >= least:
                    yield key, anchor, [v for run in chain for v in run]

        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            cuts = np.nonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))[0] + 1
            out = [c for s, e in zip(np.append(0, cuts[:-1]), cuts) for c in found(held[0][s], held[1][s], held[2][s:e].astype(np.int64), held[3][s:e].astype(np.int64))] if len(cuts) else []
            if len(cuts):
                held = [h[cuts[-1] :] for h in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)
        if held is not None:
            out = list(found(held[0][0], held[1][0], held[2].astype(np.int64), held[3].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)

    rows = matches.select("key", "anchor", "pos", "at")
    return materialize(rows.mapInArrow(run, "key long, anchor long, chain array<int>"), "chains")


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`id, side, words` (32-bit word hashes as bytes) for `wanted(_key, id, side, from, to)`.

    Requests for one document travel in lists of some REQUESTS, so a document that is the anchor of very many is sent
    once a list, and a list stays small.
    """
    lists = wanted.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).alias("_lists"))
    lists = wanted.join(lists, "_key").groupBy("_key", F.pmod(F.xxhash64("id"), F.col("_lists")).alias("_list")).agg(
        F.collect_list(F.struct("id", "side", "from", "to")).alias("wanted")
    )

    def make():
        shingler = Shingler()

        def work(rows: dict) -> dict:
            out = {"id": [], "side": [], "words": []}
            for text, wanted in zip(rows["text"], rows["wanted"]):
                words = shingler.words(text).astype("<u4")
                for x in wanted:
                    out["id"].append(x["id"])
                    out["side"].append(x["side"])
                    out["words"].append(words[x["from"] : x["to"]].tobytes())
            return out

        return work

    rows = docs.select("_key", "text").join(lists.drop("_list"), "_key")
    return map_rows(rows.select("text", "wanted"), make, schema("id long, side int, words binary"), size=128)


def _confirmed_table(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Passages of `docs` by the chains of `matches(key, anchor, pos, at)`, written."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matches = matches.repartition(parts, "key", "anchor").sortWithinPartitions("key", "anchor", "pos", "at")
    found = _chain_table(matches)
    # each side takes the words from its part of the chain and as many around as a passage can be extended by
    around = 4 * SPAN + LEAST
    last = F.size("chain")
    spans = found.withColumns({
        "x0": F.element_at("chain", 1), "y0": F.element_at("chain", 2),
        "x1": F.element_at("chain", last - 2) + F.element_at("chain", last),
        "y1": F.element_at("chain", last - 1) + F.element_at("chain", last),
    })
    spans = materialize(spans.withColumn("id", F.monotonically_increasing_id()), "spans")
    low = lambda c: F.greatest(F.col(c) - around, F.lit(0))
    sides = spans.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("key").alias("_key"), low("x0").alias("from"), (F.col("x1") + around).alias("to")),
        F.struct(F.lit(1).alias("side"), F.col("anchor").alias("_key"), low("y0").alias("from"), (F.col("y1") + around).alias("to")),
    )).alias("s")).select("id", "s.*")
    words = _slices(docs, sides)
    both = words.groupBy("id").agg(
        F.max(F.when(F.col("side") == 0, F.col("words"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("words"))).alias("b")
    )
    both = both.join(spans, "id").select("key", "anchor", "chain", "a", "b", low("x0").alias("a0"), low("y0").alias("b0"))

    def make():
        def work(rows: dict) -> dict:
            out = {k: [] for k in ("key", "start", "end", "anchor", "anchor_start", "anchor_end", "n_equal")}
            for key, anchor, flat, a, b, a0, b0 in zip(*rows.values()):
                chain = [(x - a0, y - b0, n) for x, y, n in zip(flat[::3], flat[1::3], flat[2::3])]
                for s, e, t, f, same in confirmed(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), chain):
                    for k, v in zip(out, (key, s + a0, e + a0, anchor, t + b0, f + b0, same)):
                        out[k].append(v)
            return out

        return work

    fields = "key long, start int, end int, anchor long, anchor_start int, anchor_end int, n_equal int"
    return materialize(map_rows(both, make, schema(fields)), "passages")


def _by_document(rows: DataFrame, make, columns: str) -> DataFrame:
    """`make(key, other columns as arrays)` of the rows of each document, in the order of `rows`' other columns.

    Documents are cut out of the sorted stream; one has as many rows as shared seeds or passages.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions(*rows.columns)

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            cuts = np.nonzero(held[0][1:] != held[0][:-1])[0] + 1
            for s, e in zip(np.append(0, cuts[:-1]), cuts) if len(cuts) else ():
                yield from made(pa, [h[s:e] for h in held])
            if len(cuts):
                held = [h[cuts[-1] :] for h in held]
        if held is not None:
            yield from made(pa, held)

    def made(pa, columns_of):
        out = make(int(columns_of[0][0]), *columns_of[1:])
        if len(next(iter(out.values()))):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

    return rows.mapInArrow(run, columns)


def _open_places(shared: DataFrame, found: DataFrame) -> DataFrame:
    """`key, seed, pos, open, near` of the shared seeds. Open: shared with an earlier document, in no passage; near: one that is open is."""
    rows = shared.select("key", "pos", F.lit(0).alias("minus_end"), "seed", (F.col("key") != F.col("anchor")).alias("later"))
    # sorts before a seed that starts where the passage does
    spans = found.select("key", F.col("start").alias("pos"), (-F.col("end")).alias("minus_end"), F.lit(0).cast("long").alias("seed"), F.lit(False).alias("later"))
    rows = rows.unionByName(spans)

    def make(key, pos, minus_end, seed, later):
        # open: no passage that starts at the place or before it reaches beyond it
        open_ = later & (-np.minimum.accumulate(minus_end) <= pos)
        at = pos[open_]
        seeds = minus_end == 0
        pos, seed, open_ = pos[seeds], seed[seeds], open_[seeds]
        near = np.searchsorted(at, pos - FAR[1], "left") < np.searchsorted(at, pos + FAR[1], "right")
        return {"key": np.full(len(pos), key), "pos": pos, "seed": seed, "open": open_, "near": near}

    return _by_document(rows, make, "key long, pos int, seed long, open boolean, near boolean")


def _turns(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each of the sorted `values`."""
    at = np.arange(len(values))
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _seed_pairs(places: DataFrame) -> DataFrame:
    """`pair, key, x, y, open` of the seeds of a document that stand FAR apart; open if one of them is."""

    def make(key, pos, seed, open_):
        low, high = np.searchsorted(pos, pos + FAR[0], "left"), np.searchsorted(pos, pos + FAR[1], "right")
        first = np.repeat(np.arange(len(pos)), high - low)
        second = np.arange(len(first)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        with np.errstate(over="ignore"):
            mixed = (seed[first] ^ (seed[first] >> 29)) * np.int64(-4658895280553007687) + seed[second]
        x, y, open_ = pos[first], pos[second], open_[first] | open_[second]
        order = np.lexsort((y, x, ~open_, mixed))
        mixed, x, y, open_ = mixed[order], x[order], y[order], open_[order]
        # in a line said again and again a pair comes back within the reach of its passage: after OFTEN times, one in FAR[0] words is enough
        apart = np.ones(len(x), bool)
        apart[1:] = (x[1:] // FAR[0] != x[:-1] // FAR[0]) | (open_[1:] != open_[:-1])
        kept = apart | (_turns(mixed) < OFTEN)
        return {"pair": mixed[kept], "key": np.full(int(kept.sum()), key), "x": x[kept], "y": y[kept], "open": open_[kept]}

    return _by_document(places, make, "pair long, key long, x int, y int, open boolean")


def _windows(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """`run, turn, key, pos, open, kept` of the places whose LEAST words hold one of `pairs(key, x, y, open)`.

    `run` is the hash of those words and `turn` counts their places in the document; of very many, some are kept, as pairs are.
    """
    lists = pairs.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("x", "y", F.col("open").cast("int").alias("open"))).alias("pairs"))

    def make():
        shingler = Shingler()

        def work(rows: dict) -> dict:
            out = {"run": [], "turn": [], "key": [], "pos": [], "open": [], "kept": []}
            for key, text, pairs in zip(rows["_key"], rows["text"], rows["pairs"]):
                words = shingler.words(text)
                x, y, open_ = np.array([[p["x"], p["y"], p["open"]] for p in pairs]).T
                low, high = np.maximum(y + SEED - LEAST, 0), np.minimum(x, len(words) - LEAST) + 1
                # how many pairs, and open ones, lie in the words from each place
                covers = np.zeros((2, len(words) + 1), np.int64)
                held = low < high
                for cover, of in zip(covers, (held, held & (open_ > 0))):
                    np.add.at(cover, low[of], 1)
                    np.add.at(cover, high[of], -1)
                every, opened = np.cumsum(covers, axis=1)
                at = np.nonzero(every)[0]
                run = shingler.runs_from(words, at, LEAST).view(np.int64)
                order = np.lexsort((at, run))
                at, run = at[order], run[order]
                turn, apart = _turns(run), np.ones(len(at), bool)
                apart[1:] = at[1:] // FAR[0] != at[:-1] // FAR[0]
                values = run, turn.astype(np.int32), np.full(len(at), key, np.int64), at.astype(np.int32), opened[at] > 0, apart | (turn < OFTEN)
                for k, v in zip(out, values):
                    out[k].append(v)
            return {k: np.concatenate(v) for k, v in out.items()} if out["run"] else None

        return work

    rows = docs.select("_key", "text").join(lists, "_key")
    return materialize(map_rows(rows, make, schema("run long, turn int, key long, pos int, open boolean, kept boolean"), size=128), "windows")


def _at_first(rows: DataFrame, held: DataFrame, by: list[str], ends: list[tuple[str, int]]) -> DataFrame:
    """`key, anchor, pos, at` of the `rows(*by, key, ...)` after the `first` that `held` has for them.

    A row matches at each of `ends`: a column of places and what is added to it.
    """
    both = rows.join(held, by).filter("key > first.key")
    points = F.array(*[F.struct((F.col(c) + n).alias("pos"), (F.col(f"first.{c}") + n).alias("at")) for c, n in ends])
    return both.select("key", F.col("first.key").alias("anchor"), F.explode(points).alias("m")).select("key", "anchor", "m.pos", "m.at")


def _pair_matches(pairs: DataFrame) -> DataFrame:
    """`key, anchor, pos, at` of open pairs, each with the first place of its first holder, of each class of documents."""
    held = pairs.groupBy("pair", F.pmod(F.xxhash64("key"), F.lit(HOLDERS))).agg(F.min(F.struct("key", "x", "y")).alias("first")).select("pair", "first")
    return _at_first(pairs.filter("open"), held, ["pair"], [("x", 0), ("y", 0)])


def _run_matches(windows: DataFrame) -> DataFrame:
    """`key, anchor, pos, at` of open runs, each with the first document that holds it as often, or else with its first place at all.

    So a repeated text that comes again is matched along one diagonal, not place by place.
    """
    held = windows.groupBy("run", "turn").agg(F.min(F.struct("key", "pos")).alias("first"), F.max("key").alias("last"))
    held = materialize(held.filter("first.key < last").drop("last"), "held_runs")
    # close enough together to be one run of matches
    ends = [("pos", n) for n in (*range(0, LEAST - SEED, SEED + SPAN), LEAST - SEED)]
    rows = windows.filter("open")
    later = rows.filter("kept AND turn > 0").join(held, ["run", "turn"], "left").filter("first IS NULL OR key <= first.key").drop("first")
    return _at_first(rows, held, ["run", "turn"], ends).unionByName(_at_first(later.drop("turn"), held.filter("turn = 0").drop("turn"), ["run"], ends))


def _further_passages(docs: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Passages that take in shared seeds outside of the passages `found`; `shared` has `seed, key, pos, anchor`."""
    places = materialize(_open_places(shared, found), "open_seeds")
    # a seed of an earlier holder need not be near an open one itself
    wanted = materialize(places.filter("near").select("seed").distinct(), "open_seed_values")
    pairs = materialize(_seed_pairs(places.join(wanted, "seed").select("key", "pos", "seed", "open")), "seed_pairs")
    held = pairs.groupBy("pair").agg(F.min("key").alias("first"), F.max(F.when(F.col("open"), F.col("key"))).alias("last"))
    held = materialize(held.filter("first < last").select("pair"), "shared_pairs")
    pairs = materialize(pairs.join(held, "pair"), "held_pairs")
    matches = _pair_matches(pairs).unionByName(_run_matches(_windows(docs, pairs)))
    return _confirmed_table(docs, matches.distinct())


def _outermost(found: DataFrame, further: DataFrame) -> DataFrame:
    """The rows of `found`, and of `further` those that lie in no other passage of their document, of equal ones the first anchor's."""
    numbers = ["start", "end", "anchor", "anchor_start", "anchor_end", "n_equal"]
    rows = found.withColumn("new", F.lit(0)).unionByName(further.withColumn("new", F.lit(1)))
    rows = rows.select("key", "start", (-F.col("end")).alias("_end"), "new", "anchor", "anchor_start", "anchor_end", "n_equal")

    def make(key, start, end, new, *rest):
        end = -end
        reached = np.maximum.accumulate(np.append(-1, end[:-1]))
        kept = (new == 0) | (end > reached)
        values = dict(zip(numbers, (start, end, *rest)))
        return {"key": np.full(int(kept.sum()), key), **{k: v[kept] for k, v in values.items()}}

    return _by_document(rows, make, "key long, start int, end int, anchor long, anchor_start int, anchor_end int, n_equal int").select(*found.columns)


def passages(docs: DataFrame) -> DataFrame:
    """`key, start, end, anchor, anchor_start, anchor_end, n_equal` (places in words) of `docs(_key, text)`, written."""
    seeds = seed_table(docs)
    first = seeds.groupBy("seed").agg(F.min(F.struct("key", "pos")).alias("first"), F.max("key").alias("last"))
    first = first.filter("first.key < last").select("seed", F.col("first.key").alias("anchor"), F.col("first.pos").alias("at"))
    # written, so that both sides of the join have an exchange of their own and Spark can split a seed that very many share
    first = materialize(first, "shared")
    shared = materialize(seeds.join(first, "seed").select("seed", "key", "pos", "anchor", "at"), "shared_seeds")
    found = _confirmed_table(docs, shared.filter("key <> anchor").select("key", "anchor", "pos", "at"))
    return materialize(_outermost(found, _further_passages(docs, shared, found)), "passages")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per copied passage: doc_id, start_word, end_word, first_doc_id, first_start, first_end, n_equal, key, first_key.

    The keys equal the ids unless ids are null or repeated.
    """
    base = keyed(docs).drop("_row")
    found = passages(base)
    ids = base.select("_key", "doc_id")
    found = found.join(ids.select(F.col("_key").alias("key"), "doc_id"), "key")
    found = found.join(ids.select(F.col("_key").alias("anchor"), F.col("doc_id").alias("first_doc_id")), "anchor")
    return found.select(
        "doc_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), "first_doc_id",
        F.col("anchor_start").cast("long").alias("first_start"), F.col("anchor_end").cast("long").alias("first_end"),
        F.col("n_equal").cast("long").alias("n_equal"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` (start, end) and the white space before each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        end = min(end, len(places))
        if start >= end:
            continue
        begin = places[start - 1][1] if start else 0
        if begin > at:
            out.append(text[at:begin])
        at = max(at, places[end - 1][1])
    return "".join([*out, text[at:]])


def cut_passages(docs: DataFrame) -> DataFrame:
    """`docs` with every copied passage cut out of its text (and n_chars as it is then); the first occurrence stays."""
    base = keyed(docs)
    spans = passages(base.select("_key", "text")).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_words(t, [(x["start"], x["end"]) for x in s]) if t and s is not None and len(s) else t)

    rows = base.join(spans, "_key", "left").withColumn("_new", cut("text", "_spans"))
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast(kind)))
    return restored(rows.withColumn("_row", row), docs)
