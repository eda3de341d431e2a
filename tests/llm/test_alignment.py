"""Token alignment against a plain version that looks at every byte."""

import hashlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import public_tokenizers
import pytest
from conftest import SF_DIR
from helpers import ODD, frame

from zonecast.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    (20, "a<|endoftext|>b <s> </s> <unk> <0x41>"), (21, " two  spaces and a tab\tend "), (22, "ends in space "), (23, "日本語 ▁ under"),
    (24, "\x00\x01 \x7f"), (25, "ﬁ ligature ½"), (26, "word " * 3000), (27, "🙂" * 50), (28, "line\nline\r\n"),
]


@pytest.fixture(scope="module")
def both():
    return alignment.sides(*PATHS)


def owners(ids, sizes):
    """For each byte the place of its token, and the ends of the tokens."""
    line = [i for i, t in enumerate(ids) for _ in range(sizes[t])]
    ends, at = set(), 0
    for t in ids:
        at += sizes[t]
        ends.add(at)
    return line, ends


def plain(rows, both):
    out, held, per_doc = [], Counter(), []
    for _, text in rows:
        (a,), (b,) = both.encode([text])
        (own_a, ends_a), (own_b, ends_b) = owners(a, both.left_sizes), owners(b, both.right_sizes)
        links = {(i, j) for i, j in zip(own_a, own_b)}
        parts, cuts = [], sorted(ends_a & ends_b)
        for start, end in zip([0, *cuts], cuts):
            inside = [[str(t) for t in dict.fromkeys(own[start:end])] for own in (own_a, own_b)]
            parts.append("|".join(",".join(str(ids[int(i)]) for i in side) for ids, side in zip((a, b), inside)))
        pairs = Counter((a[i], b[j]) for i, j in links)
        held.update(set(pairs))
        per_doc.append((len(a), len(b), len(cuts), pairs, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for (doc_id, _), (n_a, n_b, groups, pairs, sha) in zip(rows, per_doc):
        best = sum(n for p, n in pairs.items() if held[p] == most[p[0]])
        out.append((doc_id, n_a, n_b, groups, sum(pairs.values()), best, sum(n * held[p] for p, n in pairs.items()), sha))
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row[:1]) + tuple(row[1:])


@pytest.mark.parametrize("hot", [1, 50, alignment.HOT])
def test_odd_rows_and_any_number_of_hot_pairs(spark, both, hot):
    rows = ODD + HARD
    got = alignment.cross_alignment(frame(spark, rows, clash=True).repartition(3), *PATHS, hot=hot)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, both), key=key)


def test_query_equals_plain_version(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op12_cross_alignment"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, both))


def test_tokens_are_those_of_the_libraries(both):
    text = "Ein <|endoftext|> Wort, déjà vu."
    (a,), (b,) = both.encode([text])
    assert a and 50256 not in a
    texts = [t for _, t in HARD] + [text, "x" * 600 + " y", " " * 700 + "z", "don't WE'LL 12 3,4.5 é\u0301 \u00a0 a\n\n b"]
    for t in texts:
        assert both._left(" " + t) == both.left.encode(" " + t, add_special_tokens=False).ids
    assert b"".join(both.left_bytes[i] for i in a) == b" " + text.encode() == b"".join(both.right_bytes[i] for i in b)
    assert both.encode(["two  spaces"])[0] != [[]] and both.encode([None, ""]) == ([[], []], [[], []])


def test_empty_table(spark):
    assert alignment.cross_alignment(frame(spark, ODD).limit(0), *PATHS).count() == 0
    nothing = alignment.cross_alignment(frame(spark, [(1, None), (2, "")]), *PATHS).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
