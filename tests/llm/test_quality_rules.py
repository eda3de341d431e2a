import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ODD, frame, words
from zonecast.llm import quality_rules as q


def repeated(ws, k=5):
    seen = {}
    for i in range(len(ws) - k + 1):
        seen.setdefault(tuple(ws[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def stats(text):
    import re

    raw = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(raw), sum(map(len, raw)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(raw)


def test_statistics_of_each_text(spark):
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    rows = [*ODD, (10, "a b c d e " * 9), (11, "a b c d e f g h i j\n" * 2 + "x"), (12, long), (13, "a a a a a a a"), (14, "l\n\nl\n \nm")]
    got = q.judge(frame(spark, rows, clash=True).withColumn("source", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string")))
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect())
    want = []
    for i, t in rows:
        n, chars, symbols, dup, rep = stats(t)
        bad = n < 10 or 100 * rep > 20 * n
        want.append(((i is None, i or 0), n, chars, symbols, dup, rep, bad, not bad))
    assert found == sorted(want)


def test_host_of_failures_is_rejected_and_a_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "junk") for i in range(100)] + [(2000, bad, "tiny"), (2001, good, "tiny")] + [(3000, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    assert got[1000].host_rejected and not got[1010].kept and not got[1010].base_failed
    assert got[2001].kept and not got[2000].kept and got[3000].kept and got[3000].host_docs is None
    assert {r.doc_id for r in q.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_stage_returns_rows_as_they_came(spark):
    rows = [*ODD, (7, " ".join(f"w{i}" for i in range(30))), (7, " ".join(f"w{i}" for i in range(30)))]
    df = frame(spark, rows, clash=True)
    out = q.keep_good(df.withColumn("source", F.lit(None).cast("string")))
    assert out.columns == df.columns and len(out.columns) > 5 and [r.doc_id for r in out.collect()] == [7, 7]
    assert q.keep_good(df.limit(0)).count() == 0 and q.judge(df.limit(0)).count() == 0


def test_prior():
    assert q.prior(0, 0, 0, 0, 0) == (0.0, q.MAX_STRENGTH, q.FLOOR)
    # hosts alike: the strongest prior, and a limit relative to the rate of all
    assert q.prior(2, 20, 200, 4, 0.8) == (0.2, q.MAX_STRENGTH, pytest.approx(0.6))
    assert q.prior(2, 20, 200, 12, 7.2)[2] == 0.8
    # hosts that differ no more than chance gives: the raw variance of their rates is not zero, the prior is still the strongest
    rng = np.random.default_rng(4)
    n = np.full(400, 25)
    f = rng.binomial(n, 0.1)
    sums = lambda f: (len(n), n.sum(), (n * n).sum(), f.sum(), (f * f / n).sum())
    assert np.var(f / n) > 0.002 and q.prior(*sums(f))[1] > 300
    # rates drawn from a beta of strength 8 give about that strength
    f = rng.binomial(n, rng.beta(0.8, 7.2, len(n)))
    assert 5 < q.prior(*sums(f))[1] < 12
    assert words("A b") == ["a", "b"]


def test_registered_hosts_are_rejected_and_shrunk_back(spark):
    from zonecast.llm import registry

    rows = registry.QUERIES["host_verdicts"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.host_rejected for r in rows) and not all(r.host_rejected for r in rows)
    rates = {r.host: r.failed_short / r.host_docs for r in rows}
    assert max(rates[r.host] for r in rows if r.host_rejected) > q.FLOOR


def test_small_host_of_failures_is_shrunk_below_the_limit(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, bad if i // 40 % 10 == 0 else good, f"h{i % 40}x") for i in range(1600)] + [(9000, bad, "tiny"), (9001, good, "tiny")]
    rows += [(9100 + i, bad if i % 4 else good, "junk") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    assert got[9001].kept and not got[9000].host_rejected and got[9100].host_rejected and not got[9100].kept
    assert {r.doc_id for r in q.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_no_python_in_the_plan(spark):
    df = frame(spark, ODD)
    plan = q.document_stats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
