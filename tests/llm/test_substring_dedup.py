import random

import numpy as np
from helpers import ODD, exact_repeats, frame, words
from zonecast.llm import substring_dedup as s


def test_fenwick_and_chains_against_plain_search():
    rng = random.Random(1)
    tree, kept = s.Fenwick(30), {}
    for k in range(60):
        at, value = rng.randrange(30), (rng.random(), k)
        tree.put(at, value)
        kept[at] = max(kept.get(at, value), value)
        for end in range(31):
            assert tree.upto(end) == max([(-np.inf, -1), *(v for a, v in kept.items() if a < end)])


def best_score(runs):
    score = []
    for a, b, n in runs:
        before = [sc - s.GAP_COST * (a - ja - jn + b - jb - jn) for (ja, jb, jn), sc in zip(runs, score) if ja + jn <= a and jb + jn <= b]
        score.append(n + max([0.0, *before]))
    return max(score)


def test_best_chain_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(60):
        x = np.array(sorted(rng.sample(range(0, 300), 12)))
        y = np.array([rng.randrange(300) for _ in x])
        found = s.chains(x, y)
        runs = sorted((int(a), int(b), s.SEED) for a, b in zip(x, y)) if len({*zip(x, y)}) == len(x) else None
        chain_runs = [r for c in found for r in c]
        assert len(chain_runs) == len(set(chain_runs))
        for chain in found:
            assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(chain, chain[1:]))
        if runs and sorted(chain_runs) == runs:
            worth = max(sum(n for *_, n in c) - s.GAP_COST * sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(c, c[1:])) for c in found)
            if all(q[0] - p[0] - p[2] <= s.REACH and q[1] - p[1] - p[2] <= s.REACH for c in found for p, q in zip(c, c[1:])):
                assert worth <= best_score(runs) + 1e-9


def planted():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, other = text(70), text(90)
    rows, exact, fuzzy = list(ODD), [], []
    for i in range(50):
        w = text(rng.randint(20, 200))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
            exact.append(100 + i)
        elif i % 7 == 0:
            changed = list(other)
            for k in (20, 45, 70):
                changed[k] = rng.choice(vocab)
            del changed[33]
            at = rng.randint(0, len(w))
            w[at:at] = changed
            fuzzy.append(100 + i)
        rows.append((100 + i, " ".join(w)))
    rows += [(300, "a b c " * 60), (301, " ".join(text(25_000)))]
    return rows, exact, fuzzy, passage


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rows, exact, fuzzy, _ = planted()
    got = s.repeated_passages(frame(spark, rows, clash=True)).collect()
    assert {r.doc_id for r in got} == set(exact[1:]) | set(fuzzy[1:])
    assert {r.first_doc_id for r in got} <= {exact[0], fuzzy[0]} | set(fuzzy)
    for r in got:
        assert r.end_word - r.start_word >= s.LEAST and r.n_equal >= s.IDENTITY * (r.end_word - r.start_word)


def test_every_word_of_long_exact_repeats_is_cut(spark):
    rows, exact, _, passage = planted()
    df = frame(spark, rows, clash=True)
    out = s.cut_passages(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    got = {r.doc_id: r for r in out.collect() if r.doc_id and r.doc_id >= 100}
    core = " ".join(passage[3:-3])
    assert [i for i, r in got.items() if core in r.text] == exact[:1]
    assert all(r.n_chars == len(r.text) for r in got.values())
    source = dict(rows)
    touched = set(exact[1:])
    clean = [i for i in got if i not in touched and got[i].text != source[i]]
    assert len(clean) <= 10 and out.count() == len(rows)  # the fuzzy copies
    for i in exact[1:]:
        left = words(got[i].text)
        assert len(words(source[i])) - len(left) >= len(passage) - 2 and set(left) <= set(words(source[i]))
    assert {i for i, _ in enumerate(rows) if rows[i][0] in touched} == set(exact_repeats(rows)) & {i for i, _ in enumerate(rows) if rows[i][0] in touched}


def test_copies_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, text), (None, text), (2, text.upper())]
    got = s.repeated_passages(frame(spark, rows)).collect()
    assert len(got) == 3 and all((r.start_word, r.end_word, r.n_equal) == (0, 80, 80) for r in got)
    df = frame(spark, rows)
    assert sorted(r.text != "" for r in s.cut_passages(df).collect()) == [False, False, False, True]
    assert s.repeated_passages(df.limit(0)).count() == 0 and s.cut_passages(df.limit(0)).count() == 0


def test_cut_words():
    assert s.cut_words("a b  c\nd e", [(1, 3)]) == "a\nd e"
    assert s.cut_words("a b c", [(0, 1), (2, 9)]) == " b" and s.cut_words("a b c", [(0, 3)]) == ""
    assert s.cut_words("a b c d", [(1, 3), (0, 2)]) == " d"


def test_a_passage_whose_parts_were_first_held_by_different_documents(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = text(90)
    changed = shared[:20] + ["other"] + shared[21:70] + shared[71:]
    rows = [
        (1, text(30) + shared[:45] + text(30)), (2, text(20) + shared[45:] + text(40)),
        (3, text(10) + shared + text(10)), (4, text(25) + shared + text(5)), (5, text(15) + changed), (6, text(60)),
    ]
    got = s.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert {r.doc_id for r in got} == {4, 5} and {r.first_doc_id for r in got} == {3}
    four, = (r for r in got if r.doc_id == 4)
    assert (four.start_word, four.end_word, four.first_start, four.first_end, four.n_equal) == (25, 115, 10, 100, 90)


def test_parts_that_very_many_hold(spark, monkeypatch):
    monkeypatch.setattr(s, "HOLDERS", 2)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line, tail = text(42), text(30)
    rows = [(i, text(20) + line + text(20)) for i in range(30)] + [(50, tail + text(40))]
    rows += [(60, text(12) + line + tail), (61, text(3) + line + tail + text(9))]
    got = s.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert [(r.doc_id, r.first_doc_id, r.start_word, r.end_word, r.n_equal) for r in got] == [(61, 60, 3, 75, 72)]


def test_a_passage_that_many_hold_is_matched_with_its_first_holder(spark, monkeypatch):
    """Documents that hold the same passage in two parts first held elsewhere are not matched with each other pair by pair."""
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = text(90)
    rows = [(1, text(30) + shared[:45] + text(30)), (2, text(20) + shared[45:] + text(40))]
    rows += [(i, text(20) + shared + text(20)) for i in range(10, 40)]
    matched, confirm = [], s._confirmed_table
    monkeypatch.setattr(s, "_confirmed_table", lambda docs, m: matched.append(m.select("key", "anchor").distinct().count()) or confirm(docs, m))
    got = s.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.start_word, r.end_word) for r in got) == [(i, 10, 20, 110) for i in range(11, 40)]
    assert sum(matched[1:]) <= 4 * len(rows)


def test_a_line_that_many_hold_is_not_matched_pair_by_pair(spark, monkeypatch):
    """A line too short for a passage is matched once a document, and the longer run that two of them share is found all the same."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line, tail = text(42), text(8)
    rows = [(i, text(20) + line + text(20)) for i in range(80)] + [(90, tail + text(40))]
    rows += [(100, text(12) + line + tail + text(5)), (101, text(3) + line + tail + text(9))]
    matched, confirm = [], s._confirmed_table
    monkeypatch.setattr(s, "_confirmed_table", lambda docs, m: matched.append(m.select("key", "anchor").distinct().count()) or confirm(docs, m))
    got = s.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert [(r.doc_id, r.first_doc_id, r.start_word, r.end_word, r.n_equal) for r in got] == [(101, 100, 3, 53, 50)]
    assert sum(matched) <= 4 * len(rows)


def test_a_document_that_says_a_line_again_and_again_is_matched_along_few_diagonals(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line, start = text(26), text(30)
    rows = [(1, line[:20] + text(40)), (2, line[6:] + text(40)), (3, start + line * 40 + text(30)), (4, start + line * 40 + text(30))]
    got = s.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(4, 3)}
    assert len(got) <= 3 and {w for r in got for w in range(r.start_word, r.end_word)} == set(range(1070))
