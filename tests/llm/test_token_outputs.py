import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from helpers import ODD, frame
from zonecast.llm import packing as p
from zonecast.llm import token_files as t
from zonecast.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
MIXED = ["İstanbul ǅ ß ² ½ ª", "<|endoftext|> a<|startoftext|>b", "a\x1cb c\x85d", "é café x", "日本語 テキスト 한국어", "it's I'LL don't x'south !'s 'S", "ΑΣ Σ ΟΔΟΣ", " x　y", "'re're 12 345 ٣٤", "\n\n a\nb "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_the_tokenizer(tokenizer):
    rng, encode = random.Random(1), WordEncoder(PATH, most_words=200)
    letters = ["a", "é", "'s", "S", "İ", "²", " ", "<|endoftext|>", "́", "\x1c", "\t", "\n", "日", "!?", "12"]
    texts = [*MIXED, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(800))]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, got in zip(part, encode(part)):
            assert np.array_equal(np.frombuffer(got, "<u4"), ids(tokenizer, text)), repr(text)
    assert encode([None, ""]) == [b"", b""]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    raw = np.array(values, "<u4")
    shard = t.Shard(t.encode_shard([None, 3], [raw[: len(raw) // 3].tobytes(), raw[len(raw) // 3 :].tobytes()]))
    assert np.array_equal(shard.ids(), raw) and shard.known.tolist() == [False, True]
    a, b = len(raw) // 4, len(raw) - len(raw) // 5
    assert np.array_equal(shard.ids(a, b), raw[a:b])


def test_outliers_do_not_widen_a_block():
    raw = np.full(t.BLOCK * 4, 1000, "<u4")
    raw[::20] = 49_000
    low, width, odd, *_ = t.encode_blocks(raw)
    assert width.max() == 0 and odd.min() > 0 and np.array_equal(t.Shard(t.encode_shard([1], [raw.tobytes()])).ids(), raw)


@pytest.mark.parametrize("shard_ids", [1, 500, t.SHARD_IDS])
def test_files_against_the_tokenizer(spark, tokenizer, shard_ids):
    rows = [*ODD, *((20 + i, x) for i, x in enumerate(MIXED)), (50, "word " * 30_000)]
    rows = [r for r in rows if r[0] != 4] + [(4, "one two"), (4, "one two"), (4, "three four five")]
    folder, manifest = t.write(frame(spark, rows, clash=True), PATH, 2, parts=3, shard_ids=shard_ids)
    longest = 30_001  # a document is never cut
    assert manifest.filter(F.col("n_ids") >= shard_ids + longest).isEmpty() and (manifest.count() == len(rows)) == (shard_ids == 1)
    got = t.read(spark, folder, manifest).collect()
    want, at = [], 0
    tie = {r.text: r.h for r in frame(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])):
        x = np.append(ids(tokenizer, text), 2).astype("<u4").tobytes()
        want.append((i, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    folder, manifest = t.write(frame(spark, rows).limit(0), PATH, 2)
    assert t.read(spark, folder, manifest).count() == 0


def best_fit(counts, length):
    """Bins of best-fit decreasing, one piece at a time."""
    room = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [(r, i) for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits)[1]] -= size
            else:
                room.append(length - size)
    return len(room)


def test_plan_fills_every_rank_once_and_no_bin_over():
    rng = random.Random(2)
    for _ in range(25):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        bins, ranks = {}, {k: [] for k in counts}
        for size, first, n, sequence, copies, offset in p.plan(counts, 64):
            for rank in range(first, first + n):
                j, k = divmod(rank - first, copies)
                ranks[size].append(rank)
                bins.setdefault(sequence + j, []).append((offset + k * size, size))
        assert all(sorted(r) == list(range(counts[k])) for k, r in ranks.items())
        for parts in bins.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end <= 64
        assert len(bins) == best_fit(counts, 64)


def test_packing_against_the_tokenizer(spark, tokenizer):
    rows = [*ODD, *((20 + i, x) for i, x in enumerate(MIXED)), (50, "word " * 3000), (51, "a " * 127), (52, "a " * 128)]
    got = p.pack(frame(spark, rows, clash=True), PATH, 1, length=128, with_ids=True).collect()
    want = []
    for i, text in rows:
        x = np.append(ids(tokenizer, text), 1).astype("<u4")
        want += [((i is None, i or 0), n, s, len(x[s : s + 128]), zlib.crc32(x[s : s + 128].tobytes())) for n, s in enumerate(range(0, len(x), 128))]
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 128 and len(ends) <= -(-sum(r.length for r in got) // 128) + 1
    assert p.pack(frame(spark, rows).limit(0), PATH, 1).count() == 0
