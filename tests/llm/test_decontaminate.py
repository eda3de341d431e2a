import hashlib
import random
import re

from helpers import ODD, frame
from zonecast.llm import decontaminate as d
from zonecast.llm.common import keyed

GAPS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(text):
    return [w for w in GAPS.split((text or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def windows(text):
    w = toks(text)
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def brute(rows, items):
    out = []
    for i, text in rows:
        w, hit, found = toks(text), set(), set()
        for item, t in items:
            for win in windows(t):
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        names = ",".join(sorted(found))
        out.append(((i is None, i or 0), len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 14, 40])))) for i in range(25)]
    items += [(25, items[3][1].upper()), (26, None), (27, ""), (28, "--"), (29, "solo"), (30, "absent words here")]
    rows = list(ODD)
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(items[:25])[1].replace(" ", ", ").split(" ")[: rng.choice([9, 10, 40])]
        rows.append((100 + i, " ".join(w) + (" Solo!" if i == 7 else "")))
    rows.append((999, " ".join(vocab * 300) + " " + items[4][1] + " " + items[4][1]))
    return rows, items


def test_equals_brute_force(spark, monkeypatch):
    rows, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block, keys in ((d.BLOCK, d.MOST_KEYS), (40, 0)):  # one block of windows, and several; candidates sent out, and dealt by key
        monkeypatch.setattr(d, "BLOCK", block)
        monkeypatch.setattr(d, "MOST_KEYS", keys)
        got = d.contamination(frame(spark, rows, clash=True), benchmark).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in got) == brute(rows, items)


def test_stage_drops_the_contaminated(spark):
    rows, items = case()
    df, benchmark = frame(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string")
    out = d.drop_contaminated(df, benchmark)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(k for k, *_, bad in brute(rows, items) if not bad)
    assert d.drop_contaminated(df, benchmark.limit(0)).count() == len(rows)
    assert d.contamination(df.limit(0), benchmark).count() == 0


def test_proximity(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "alpha beta x gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "q r " + phrase + " s"), (2, "q " + moved + " t"), (3, "alpha " + "y " * 30 + phrase[6:]), (4, "kappa alpha")]
    docs = keyed(frame(spark, rows))
    wins, _ = d.windows_of(spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    index = d.build_index(docs)
    exact = {r["_key"]: [h["exact"] for h in r["hits"]] for r in d.search(docs, index, wins).collect()}
    near = {r["_key"]: {h["exact"] for h in r["hits"]} for r in d.search(docs, index, wins, slop=2).collect()}
    assert exact == {1: [True]} and near == {1: {True}, 2: {False}}


def test_no_python_in_the_plan(spark):
    docs = keyed(frame(spark, [(1, "a b")]))
    wins, _ = d.windows_of(spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    hits = d.search(docs, d.build_index(docs), wins)
    plan = d.contamination(docs.select("doc_id", "text"), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert hits.count() == 1 and "Python" not in plan and "Arrow" not in plan
