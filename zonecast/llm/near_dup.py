"""MinHash near-duplicates with sequential Bayesian verification.

1. A document's set: its distinct five-word shingles as 64-bit hashes. Documents with the same set are one class, named by its smallest
   key; only classes go on.
2. `BANDS` bands of `ROWS` MinHash values. Classes that share a band are candidates. A pair at the threshold 0.85 shares none with
   probability (1 - 0.85**5)**25 < 5e-7.
3. Candidates are gathered in units, so that each class is sent once: a unit is a connected group of bands (linked through their
   smallest member, not in pairs). A unit that is too large for one task falls apart into its bands, and a band that is still
   too large is cut into blocks, of which every two meet in a task. No candidate pair is lost on the way.
4. In a unit each class is compared with those not yet known to be connected to it: MinHash values in batches of 16, and after each batch
   the pairs are dropped whose probability of reaching the threshold, given the matches so far and a uniform prior, is below
   `MISS`. Survivors are confirmed on the full sets with integers. Confirmed links that connect something new are returned: at most one
   less than the unit has classes.
5. Components over all links; the smallest doc_id of a component is its name.

Only links inside what is already connected are skipped, which changes no component.

Defined results: a document without words has an empty set and is alone; repeated rows and null ids are told apart row by row, of rows
that share the smallest doc_id of a component one is kept; null ids count as larger than any other and a component of nothing else
has a null name; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import LOWER_BYTES, keyed, map_rows, restored, schema
from zonecast.llm.components import smallest_reachable
from zonecast.session import materialize

SHINGLE = 5
BANDS, ROWS = 25, 5
HASHES = 128
BATCH = 16
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Probability at which a pair may be given up although it reaches the threshold.
MISS = 1e-6
#: Shingles in a unit that one task takes, 8 bytes each, and classes, for the quadratic part.
MOST_SHINGLES, MOST_CLASSES = 4_000_000, 6_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_A = np.random.default_rng(20240501).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(20240502).integers(0, 2**32, HASHES, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text. The hashes of words are kept from text to text, up to `most` words."""

    def __init__(self, most: int = 300_000):
        self._hash: dict[bytes, bytes] = {}
        self._most = most

    def words(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        found = list(map(self._hash.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self._hash[words[i]] = xxhash.xxh3_64_digest(words[i])
            if len(self._hash) > self._most:
                self._hash = {}
        return np.frombuffer(b"".join(found), "<u8")

    def runs(self, text: str | None, size: int) -> np.ndarray:
        """Hash of the `size` words from each place on, or of all words if there are fewer."""
        h = self.words(text)
        if not len(h):
            return h
        n = max(len(h) - size + 1, 1)
        out = np.full(n, len(h) if len(h) < size else size, np.uint64)
        for i in range(min(size, len(h))):
            out = _mixed(out * _MULTIPLIER + h[i : i + n])
        return out

    @staticmethod
    def runs_from(words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` word hashes from each of `places` on."""
        out = np.full(len(places), size, np.uint64)
        for i in range(size):
            out = _mixed(out * _MULTIPLIER + words[places + i])
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.runs(text, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):  # long texts in pieces
        np.minimum(low, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    grid = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _mixed(out * _MULTIPLIER + grid[:, i])
    return out.view(np.int64)


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[int]:
    """After each batch of n values: the fewest matches m for which P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the similarity follows Beta(m + 1, n - m + 1), whose upper tail at t is that of a binomial:
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, term, m = 0.0, (1 - threshold) ** (n + 1), 0
        while m <= n:
            tail += term
            if tail >= miss:
                break
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return out


_LEAST = least_matches()


def survivors(sig: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Of `others`, those that batch after batch stay likely enough to reach the threshold with `one`."""
    matches = np.zeros(len(others), np.int32)
    for k, least in enumerate(_LEAST):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        matches += (sig[others, batch] == sig[one, batch]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        others, matches = others[stay], matches[stay]
        if not len(others):
            break
    return others


class _Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)


def links(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Confirmed links among `sets` that connect what was not connected: a spanning forest of all links."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    sig = np.stack([signature(s) for s in sets])
    # ids of shingles within the unit; flat with a document each, to count intersections at once
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    forest, out = _Forest(n), []
    # the class nearest to the commonest values first: it tends to connect most of the unit at once
    common = np.zeros(n, np.int64)
    for c in range(0, HASHES, 4):
        value, counts = np.unique(sig[:, c], return_counts=True)
        common += sig[:, c] == value[counts.argmax()]
    for rank, one in enumerate(order := np.argsort(-common, kind="stable")):
        others = order[rank + 1 :]
        others = others[forest.label[others] != forest.label[one]]
        # sets of too different sizes cannot reach the threshold
        others = others[100 * np.minimum(size[others], size[one]) >= threshold * np.maximum(size[others], size[one])]
        others = survivors(sig, one, others)
        if not len(others):
            continue
        mark[flat[begin[one] : begin[one + 1]]] = True
        for other in others:
            if forest.label[other] == forest.label[one]:
                continue
            both = int(np.count_nonzero(mark[flat[begin[other] : begin[other + 1]]]))
            if 100 * both >= threshold * (size[one] + size[other] - both):
                forest.join(one, other)
                out.append((int(one), int(other)))
        mark[flat[begin[one] : begin[one + 1]]] = False
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """`_key, n_shingles, class (16 bytes, null if empty), bands` of `docs(_key, text)`; the bands of one document, 200 bytes."""
    def make():
        shingler = Shingler()

        def work(rows: dict) -> dict:
            out = {"_key": rows["_key"], "n_shingles": [], "class": [], "bands": []}
            for text in rows["text"]:
                s = shingler(text)
                out["n_shingles"].append(len(s))
                out["class"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["bands"].append(band_hashes(signature(s)).tolist() if len(s) else [])
            return out

        return work

    return map_rows(docs.select("_key", "text"), make, schema("_key long, n_shingles long, class binary, bands array<long>"))


def _units(classes: DataFrame, most_shingles: int, most_classes: int) -> DataFrame:
    """`_key, unit`: every two classes that share a band meet in a unit at least."""
    bands = classes.select("_key", "n_shingles", F.explode("bands").alias("band"))
    # only bands with two classes or more matter; a band's size and smallest member are combined before the shuffle
    shared = bands.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"), F.min("_key").alias("first")
    ).filter("n > 1")
    member = materialize(bands.join(shared, "band"), "bands")
    groups = smallest_reachable(member.select(F.col("_key").alias("u"), F.col("first").alias("v")))
    groups = materialize(groups.select(F.col("node").alias("_key"), F.col("component").alias("group")), "groups")
    weight = groups.join(classes.select("_key", "n_shingles"), "_key").groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")
    )
    fits = (F.col("n") <= most_classes) & (F.col("s") <= most_shingles)
    groups = groups.join(weight.select("group", fits.alias("fits")), "group")
    whole = groups.filter("fits").select("_key", F.xxhash64(F.lit("group"), "group").alias("unit"))
    apart = member.join(groups.filter("NOT fits").select("_key"), "_key")
    blocks = F.greatest(F.ceil(F.col("n") / most_classes * 2), F.ceil(F.col("s") / most_shingles * 2)).cast("int")
    blocks = F.when((F.col("n") <= most_classes) & (F.col("s") <= most_shingles), 1).otherwise(blocks)
    apart = apart.withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("_key"), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64(F.lit("band"), F.col("band"), F.least(F.col("b"), j), F.greatest(F.col("b"), j)))
    # two blocks meet in unit (i, j), which has the rows of both; (i, i) alone would add nothing if there is another
    apart = apart.select("_key", F.explode(pairs).alias("unit"))
    return materialize(whole.unionByName(apart).distinct(), "units")


def _confirm(texts: DataFrame, threshold: int) -> DataFrame:
    """Links `u, v` from `texts(_key, text, unit)`."""
    def unit(frame):
        import pandas as pd

        frame = frame.sort_values("_key").drop_duplicates("_key")
        shingler = Shingler()
        found = links([shingler(t) for t in frame["text"]], threshold)
        keys = frame["_key"].to_numpy()
        return pd.DataFrame({"u": [keys[a] for a, _ in found], "v": [keys[b] for _, b in found]}, dtype="int64")

    return texts.groupBy("unit").applyInPandas(unit, "u long, v long")


def components(
    docs: DataFrame, threshold: int = THRESHOLD, most_shingles: int = MOST_SHINGLES, most_classes: int = MOST_CLASSES
) -> DataFrame:
    """`_key, doc_id, n_shingles, component_id, kept` for every row of `docs`, which `keyed` has made."""
    rows = materialize(sketches(docs), "sketches")
    named = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("_key").alias("_class"))
    rows = materialize(rows.join(named, "class", "left").withColumn("_class", F.coalesce("_class", "_key")), "classes")
    units = _units(rows.filter("_class = _key AND n_shingles > 0"), most_shingles, most_classes)
    # units grow with the corpus: merged at every size, where a broadcast of small ones would change the plan as they grow
    texts = docs.select("_key", "text").join(units.hint("merge"), "_key")
    found = materialize(_confirm(texts, threshold), "links")
    groups = smallest_reachable(found).select(F.col("node").alias("_class"), F.col("component").alias("_group"))
    rows = rows.select("_key", "n_shingles", "_class").join(groups, "_class", "left")
    rows = rows.withColumn("_group", F.coalesce("_group", "_class")).join(docs.select("_key", "doc_id"), "_key")
    rows = materialize(rows.drop("_class"), "grouped")
    # the first of a group by doc_id, then key; combined before the shuffle and joined back, as a group may be very large
    first = rows.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("_first"))
    rows = rows.join(first, "_group")
    return rows.select(
        "_key", "doc_id", "n_shingles", F.col("_first.doc_id").alias("component_id"), (F.col("_first._key") == F.col("_key")).alias("kept")
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return components(keyed(docs).drop("_row"), threshold).drop("_key")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with its columns as they came."""
    base = keyed(docs)
    found = components(base.drop("_row"), threshold)
    return restored(base.join(found.filter("kept").select("_key").hint("merge"), "_key", "left_semi"), docs)
