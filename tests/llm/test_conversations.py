"""Conversation repair against an exhaustive search over edits and a plain version of the damage and the counts."""

import hashlib
import heapq
import re
import zlib

import __spark_entry__ as entry
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from zonecast.llm import conversations as C

BODY = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_search(rows):
    """Cheapest edits by best-first search over (cost, audit): rows of (role, text, fault); cost, audit, lines."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, out, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, list(lines)
        # what has been put out must be the beginning of a sound conversation
        for letter, role in (("u", "user"), ("a", "assistant")):
            if re.fullmatch("s?(ua)*u?", out + letter):
                heapq.heappush(queue, (cost + 5, audit + "I", at, out + letter, (*lines, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, out, lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault else 0
            ways = [("K", 0, role)] + [("R", 1, r) for r in ("user", "assistant")]
            for letter, price, name in ways:
                if re.fullmatch("s?(ua)*u?", out + name[:1]) and name[:1]:
                    heapq.heappush(queue, (cost + price + late, audit + letter, at + 1, out + name[:1], (*lines, f"{name}:{text}")))


def plain(table):
    show = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = show(role), show(text)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, rows in convs.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, marked = set(), []
        for _, role, text in rows:
            fault = "blank" if not BODY.search(text) else "duplicate" if (role, text) in seen else ""
            if not fault and BODY.findall(text)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = by_search(marked)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")],
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "unknown"]), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=6))
def test_cheapest_edits_are_those_of_a_search(rows):
    faults = {"": C.SOUND, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.CUT}
    cost, audit, lines = by_search([(role, f"{i}", fault) for i, (role, fault) in enumerate(rows)])
    assert C.cheapest([(role[:1], faults[fault]) for role, fault in rows]) == (cost, audit)
    repaired = C.Repaired(audit)
    for i, (role, _) in enumerate(rows):
        repaired.feed(role, f"{i}")
    assert repaired.digest() == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_long_conversation_needs_no_recursion():
    rows = [("ua"[i % 2], C.SOUND) for i in range(4000)]
    assert C.cheapest([*rows, ("u", C.SOUND)]) == (2, "K" * 4000 + "D")


def test_query_equals_plain_version(spark):
    got = entry.queries()["op11_conversation_repair"](spark, SF_DIR)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got.columns == COLUMNS
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain(rows))


@pytest.mark.parametrize("partitions", [1, 7])
def test_nulls_ties_repeats_and_other_columns(spark, partitions):
    rows = [
        (c, t, r, x)
        for c in (None, 0, 1, 5) for t in (None, 3, 3, 7, 90) for r in ("user", None, "assistant") for x in ("Hi.", "", None)
        if (c or 0) + (t or 0) + len(x or "") != 9
    ][:60] + [(8, 4, "user", "é ß?"), (9, None, "system", " \t"), (10, -5, "assistant", "so it ends\n"), (10, 2, "user", "yes. ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("digest", "gone", "part", "audit", "code", "cost"):
        df = df.selectExpr("*", f"'own' AS {name}")
    small = [r for r in rows if sum(q[0] == r[0] for q in rows) <= 8]
    got = {r["conv_id"]: tuple(r) for r in C.repair(df.repartition(partitions)).collect()}
    for want in plain(small):
        assert got[want[0]] == want
    assert set(got) == {r[0] for r in rows}


def test_all_rows_dropped_and_empty_table(spark):
    lost = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in lost], "conv_id long, turn long, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, C.repair(df).collect())) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, _ in lost]
    assert C.repair(df.limit(0)).count() == 0
