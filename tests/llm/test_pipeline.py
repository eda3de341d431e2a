"""The whole pipeline on a small table, stage by stage against plain versions."""

import corpus_pipeline
import pytest
from helpers import exact_repeats, frame, near_groups, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonecast import session
from zonecast.llm.registry import PACK_END, vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and benchmark with planted junk, copies, shared passages and leaks."""
    import random

    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    passage, base = text(80), [text(150) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, "too short"), (101, "one two three four five " * 20), (102, None), (103, "")]
    rows += [(110, base[3]), (111, base[4] + " tail"), (112, base[4].replace("w1", "w1", 1))]
    rows += [(120, f"{text(60)} {passage} {text(60)}"), (121, f"{text(70)} {passage} {text(50)}"), (122, f"{text(80)} {passage}")]
    rows += [(130, f"{text(40)} {items[2][1]} {text(40)}"), (131, f"{items[4][1]} {text(30)}"), (140, text(30_00))]
    top = str(tmp_path_factory.mktemp("pipeline"))
    frame(spark, rows).coalesce(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    return top


def ids(rows):
    return sorted(i for i, _ in rows)


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, outs = docs.columns, [tuple(r) for r in docs.select("doc_id", "text").collect()], {}
    for name, work in corpus_pipeline.STAGES:
        docs = session.materialize(work(spark, docs, folder), name)
        outs[name] = docs
        assert name == "packing" or docs.columns == columns
    rows = {name: sorted((r.doc_id, r.text) for r in df.collect()) for name, df in outs.items() if name != "packing"}

    def failed(text):
        w = words(text)
        twice = {}
        for i in range(len(w) - 4):
            twice.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {j for at in twice.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(covered) > 20 * len(w)

    want = [r for r in kept if not failed(r[1])]
    assert ids(rows["quality_rules"]) == ids(want)

    groups = near_groups(sorted(want))[1]
    want = [r for i, r in enumerate(sorted(want)) if min(groups[i]) == i]
    assert rows["near_dedup"] == want

    # the first of the three passages stays, and nothing else is cut
    cut = dict(rows["substring_dedup"])
    assert ids(rows["substring_dedup"]) == ids(want) and not exact_repeats(rows["substring_dedup"])
    assert all(cut[i] == t for i, t in want if i not in (121, 122))
    assert all(len(words(cut[i])) == len(words(dict(want)[i])) - 80 for i in (121, 122))

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(words(t)[i : i + 10]) for i in range(len(words(t)) - 9)}
    leaks = set().union(*map(grams, items))
    want = [r for r in rows["substring_dedup"] if not grams(r[1]) & leaks]
    assert rows["decontamination"] == want and len(want) == len(cut) - 2

    encoder, sizes, sequences = Tokenizer.from_file(vocabulary()), {}, {}
    for i, t in want:
        sizes[i] = len([*encoder.encode(t, add_special_tokens=False).ids, PACK_END])
    got = outs["packing"].collect()
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        sizes[r.doc_id] -= r.length
    assert not any(sizes.values())
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096


def test_run_leaves_no_tables_but_the_outputs(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and not session._STAGE_TABLES.get(corpus_pipeline.SCOPE)
    assert got.select(F.sum("length")).first()[0] > 0
