"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance).

Training counts the n-grams of 1 to `LONGEST` letters inside words, a word with a mark at either end, per language over all training texts. Words are
counted first, per task and then over the cluster, so each n-gram is cut once from a distinct word and weighted. A language's profile
is its `TOP` most frequent n-grams in order; profiles are what goes to the driver: TOP rows a language.

A document is scored by its own `TOP` most frequent n-grams, from its whole text: the sum over them of how far each is out of
place in a profile, or TOP where the profile lacks it. The nearest profile names the language. Ties between n-grams go to the one
that sorts first, ties between languages too. The score is 1 - distance / largest possible distance.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all texts if nothing was learned; rows without
a language do not train; repeated rows count each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.session import materialize

LONGEST = 3
TOP = 400
UNDETERMINED = "und"
MARK = "_"
#: Parts in which the n-grams of a language are ranked before its first are put together.
PARTS = 32
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def _word_counts(docs: DataFrame) -> DataFrame:
    """`lang, word, n` summed over `docs(lang, text)`."""
    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

        def flush(held: dict[str, Counter]):
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=kind)

        held: dict[str, Counter] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for lang, text in zip(part["lang"], part["text"]):
                    held.setdefault(lang, Counter()).update(letters(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flush(held)
                    held = {}
        yield from flush(held)

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_of(size: int):
    """From a place to the n-gram of `size` letters there. Spark would hand the place in the array to a second parameter."""
    return lambda i: F.substring("w", i, F.lit(size))


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """`lang, gram, place` (from 0) of the `top` n-grams of each language in `docs(lang, text)`."""
    words = _word_counts(docs.filter("lang IS NOT NULL AND text IS NOT NULL"))
    marked = words.select("lang", F.concat(F.lit(MARK), "word", F.lit(MARK)).alias("w"), "n")
    cuts = []
    for k in range(1, LONGEST + 1):
        first, last = (2, F.length("w") - 1) if k == 1 else (1, F.length("w") - k + 1)
        # a sequence would count down in a word shorter than k
        starts = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(starts, piece_of(k)))
    grams = marked.select("lang", "n", F.explode(F.flatten(F.array(*cuts))).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first of a language are among the first of its parts, which are ranked side by side
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    first = grams.withColumn("_part", part).withColumn("_rank", rank("_part")).filter(F.col("_rank") <= top)
    return first.withColumn("place", rank() - 1).filter(F.col("place") < top).select("lang", "gram", "place")


#: Bits of a letter in the number of an n-gram; the code points of three letters fill it. Numbers sort as the n-grams do.
LETTER_BITS = 21


def number(gram: str) -> int:
    """An n-gram as an integer: its code points from the left, zeros where it ends."""
    return sum(ord(c) << LETTER_BITS * (LONGEST - 1 - i) for i, c in enumerate(gram))


def gram_numbers(text: str | None) -> np.ndarray:
    """The numbers of all n-grams of a text: its words in a row, with one mark between two of them."""
    words = letters(text)
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer((MARK + MARK.join(words) + MARK).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inner = c != ord(MARK)
    one, two, three = (c << LETTER_BITS * k for k in (2, 1, 0))
    pair = one[:-1] | two[1:]  # words are not empty, so no pair is two marks
    return np.concatenate([one[inner], pair, (pair[:-1] | three[2:])[inner[1:-1]]])  # a mark in the middle parts two words


class Identifier:
    """Predicts from profiles given as {language: n-grams in order}."""

    def __init__(self, ranked: dict[str, list[str]], top: int = TOP):
        self.langs, self.top = sorted(ranked), top
        rows: dict[int, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            for place, gram in enumerate(ranked[lang]):
                rows.setdefault(number(gram), np.full(len(self.langs), -1))[k] = place
        self._known = np.array(sorted(rows), np.int64)
        # the last row is for n-grams that no profile has
        self._places = np.stack([*(rows[g] for g in self._known.tolist()), np.full(len(self.langs), -1)])

    def ranked(self, text: str | None) -> np.ndarray:
        """Numbers of the text's most frequent n-grams, in order."""
        numbers, n = np.unique(gram_numbers(text), return_counts=True)
        return numbers[np.argsort(-n, kind="stable")[: self.top]]  # ties stay in the order of the n-grams

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = self.ranked(text) if self.langs else ()
        if not len(grams):
            return UNDETERMINED, 0.0
        at = np.searchsorted(self._known, grams)
        found = (at < len(self._known)) & (self._known[np.minimum(at, len(self._known) - 1)] == grams) if len(self._known) else np.zeros(len(grams), bool)
        place = self._places[np.where(found, at, len(self._known))]
        out_of_place = np.where(place < 0, self.top, np.abs(place - np.arange(len(grams))[:, None]))
        distance = out_of_place.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(grams))


def identify(docs: DataFrame, training: DataFrame, top: int = TOP) -> DataFrame:
    """Add lang_pred and score to `docs(doc_id, text, ...)`, learned from `training(lang, text)`."""
    learned = materialize(profiles(training, top), "profiles")
    ranked: dict[str, list[str]] = {}
    for row in learned.orderBy("lang", "place").collect():  # `top` rows a language
        ranked.setdefault(row["lang"], []).append(row["gram"])
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes)

    def make():
        identifier = Identifier(ranked, top)

        def work(rows: dict) -> dict:
            found = [identifier(t) for t in rows["text"]]
            return {c: rows[c] for c in names} | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return work

    return map_rows(docs.select(*names, "text"), make, schema(f"{fields}, lang_pred string, score double"))
