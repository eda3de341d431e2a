import random

import numpy as np
from helpers import ODD, frame, near_groups, shingle_sets
from zonecast.llm import near_dup as n
from zonecast.llm.common import keyed
from zonecast.llm.components import smallest_reachable


def case():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    rows = list(ODD)
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 60, 250]))]
        for c in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + 20 * g + c, " ".join(w) if c % 2 else " ".join(w).upper()))
    rows.append((900, " ".join(rng.choice(vocab) for _ in range(30_000))))
    return rows


def check(got, rows):
    sets, groups = near_groups(rows)
    want = {}
    for i, members in enumerate(groups):
        ids = [rows[j][0] for j in members if rows[j][0] is not None]
        want.setdefault((rows[i][0] is None, rows[i][0] or 0), []).append((len(sets[i]), min(ids) if ids else None))
    found = {}
    for r in got:
        found.setdefault((r.doc_id is None, r.doc_id or 0), []).append((r.n_shingles, r.component_id))
    order = lambda v: sorted(v, key=str)
    assert {k: order(v) for k, v in found.items()} == {k: order(v) for k, v in want.items()}
    assert sum(r.kept for r in got) == len({tuple(g) for g in groups})


def test_equals_brute_force_whole_and_split(spark):
    rows = case()
    base = keyed(frame(spark, rows, clash=True)).drop("_row")
    check(n.components(base).collect(), rows)
    check(n.components(base, most_shingles=300, most_classes=2).collect(), rows)  # units fall apart into bands and blocks


def test_kept_is_the_smallest_id_where_ids_are_unique(spark):
    rows = [(i, t) for i, (_, t) in enumerate(case())]
    got = n.near_duplicates(frame(spark, rows)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stage_keeps_one_of_each_group(spark):
    rows = case()
    df = frame(spark, rows, clash=True)
    out = n.drop_near_duplicates(df)
    assert out.columns == df.columns and out.count() == len({tuple(g) for g in near_groups(rows)[1]})
    assert n.drop_near_duplicates(df.limit(0)).count() == 0


def test_links_span_what_all_pairs_connect():
    rng = random.Random(2)
    base = [f"x{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"y{rng.random()}"
        texts.append(" ".join(w))
    shingler = n.Shingler()
    sets = [shingler(t) for t in texts]
    rows = list(enumerate(texts))
    groups = {tuple(g) for g in near_groups(rows)[1]}
    found = n.links(sets)
    assert len(found) == len(texts) - len(groups)
    plain = shingle_sets(rows)
    for a, b in found:
        assert 100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b])


def test_pruning_bound():
    least = n.least_matches(0.85, 1e-6)
    assert all(a <= b for a, b in zip(least, least[1:])) and least[-1] < 0.85 * n.HASHES
    # exact tail by numeric integration of the posterior
    grid = np.linspace(0, 1, 200_001)
    for k, m in enumerate(least):
        size = (k + 1) * n.BATCH
        density = grid**m * (1 - grid) ** (size - m)
        assert density[grid >= 0.85].sum() / density.sum() >= 1e-6
        if m:
            density = grid ** (m - 1) * (1 - grid) ** (size - m + 1)
            assert density[grid >= 0.85].sum() / density.sum() < 1.1e-6


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
