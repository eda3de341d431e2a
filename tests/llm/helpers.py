"""Small tables and plain Python versions to hold the operators against."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Rows that every operator must take: nulls, empty texts, white space, repeated rows, repeated and null ids.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (4, "three four five"), (None, "one two"), (None, None),
    (5, "é 日本語 ß \x00 x"), (6, "#*$%&|<> !!"),
]
#: Names that operators use themselves, as further columns of the input.
CLASHING = ["_key", "key", "kept", "n_words", "band", "class", "pos", "start", "length", "host", "_row", "score", "unit", "words", "term"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    if clash:
        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def shingle_sets(rows, size=5):
    out = []
    for _, text in rows:
        w = words(text)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def near_groups(rows, percent=85):
    """For each row the index of the first row (by doc_id, null last, then place) of its component."""
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sets, [groups[find(i)] for i in range(len(rows))]


def crc_fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def exact_repeats(rows, least=50):
    """Row index -> words inside runs of `least` words that an earlier row has too."""
    first, found = {}, {}
    for i, (_, text) in enumerate(rows):
        w = words(text)
        for j in range(len(w) - least + 1):
            if first.setdefault(tuple(w[j : j + least]), i) != i:
                found.setdefault(i, set()).update(range(j, j + least))
    return found


def counts(values):
    return Counter(values)
