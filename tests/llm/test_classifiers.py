import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, crc_fold, frame
from zonecast.llm import labelled, language, quality_cnn, registry, toxicity

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_as_text(spark):
    from zonecast.llm.common import crc_fold as fold

    rows = frame(spark, [(i, "x") for i in range(50)] + [(None, "x")]).withColumn("h", fold("doc_id", 4, 2)).collect()
    assert all(r.h == (r.doc_id is not None and crc_fold(r.doc_id, 4) == 2) for r in rows)


def plain_profile(texts, top):
    from collections import Counter

    grams = Counter()
    for text in texts:
        for w in language.letters(text):
            w = f"_{w}_"
            grams.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:top]]


def test_profiles_and_distance_against_plain_python(spark):
    texts = {"a": ["the cat sat on the mat", "then a hat"], "b": ["der hund und die katze", "ünd öl"]}
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts] + [(None, "zzz"), ("a", None)], "lang string, text string")
    got = {}
    for r in language.profiles(df, top=25).orderBy("lang", "place").collect():
        got.setdefault(r.lang, []).append(r.gram)
    assert got == {k: plain_profile(ts, 25) for k, ts in texts.items()}
    identifier = language.Identifier(got, top=25)
    for text in ["the hat", "Die Katze!", "ab " * 500 + "x" * 3000, "ÖL"]:
        doc = plain_profile([text], 25)
        far = {k: sum(abs(g.index(x) - i) if x in g else 25 for i, x in enumerate(doc)) for k, g in got.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert identifier(text) == (best, 1 - far[best] / (25 * len(doc)))


def test_language_of_odd_texts_and_held_out_accuracy(spark):
    df = frame(spark, [*ODD, (7, "123 !")], clash=True)
    got = language.identify(df.select("doc_id", "text"), df.select("lang", "text")).collect()
    assert len(got) == len(ODD) + 1 and all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6, 7)] == ["und"] * 5
    assert {r.lang_pred for r in language.identify(df.select("doc_id", "text"), df.limit(0)).collect()} == {"und"}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in registry.QUERIES["op3_language"](spark, SF).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.98 and len(got) > 200


def test_sample_is_bounded_and_repeatable(spark):
    df = frame(spark, [(i, f"t{i}") for i in range(100)] + [(None, "n")])
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("y"))
    once = labelled.texts(labelled.sample(df, labels, F.col("y") == 1, 20))
    assert len(once) == 20 and once == labelled.texts(labelled.sample(df.repartition(7), labels, F.col("y") == 1, 20))


def held(query, column, threshold_fold, spark, sf=SF, n=1000):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.QUERIES[query](spark, sf).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc_fold(r.doc_id, threshold_fold[0]) == threshold_fold[1]) for r in got)
    return [(labels[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in labels]


def area(pairs):
    good, bad = [s for y, s, _ in pairs if y], [s for y, s, _ in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_held_out(spark):
    pairs = held("op8_quality_cnn", "quality", (5, 0), spark)
    assert area(pairs) > 0.9 and np.mean([y == p for y, _, p in pairs]) > 0.85


def test_toxicity_held_out(spark):
    # the smallest table that has enough confirmed texts of each language: of sf0.01's 37 to learn from, 2 are German, 4 of 14 held out are
    pairs = held("op10_toxicity", "toxic", (4, 2), spark, "/root/testdata/sf0.1", 10_000)
    assert area(pairs) > 0.95 and np.mean([y == p for y, _, p in pairs]) > 0.93
    assert np.mean([p for y, _, p in pairs if y]) > 0.8  # toxic texts found


def test_features_counts_and_risk_against_plain_python(spark):
    texts = [(1, "bad bad Word", 1), (2, "a word", 0), (3, None, 0), (4, "badly", 1)]
    rows = spark.createDataFrame([(k, i % 3, t) for i, t, k in texts] + [(0, 0, "a word")], "kind int, fold int, text string").repartition(3)
    hashes, counts = toxicity.count_features(rows)
    want = {}
    for i, t, k in [*texts, (0, "a word", 0)]:
        for h in {h for w in (t or "").lower().split() for h in toxicity.features_of(w)}:
            want.setdefault(h, np.zeros((2, 3), int))[k, i % 3] += 1
    assert {int(h): counts[:, :, j].tolist() for j, h in enumerate(hashes)} == {h: c.tolist() for h, c in want.items() if c.sum() > 2}
    z_p, z_u = np.array([1.0, -2.0]), np.array([0.5, -1.0, 3.0])
    loss = lambda z: np.log1p(np.exp(z))
    clean = np.mean(loss(z_u)) - 0.3 * np.mean(loss(z_p))
    assert toxicity.nn_pu_risk(z_p, z_u, 0.3) == 0.3 * np.mean(loss(-z_p)) + max(0, clean)
    a, n, b, m = 6, 10, 3, 40
    table, total = np.array([[a, n - a], [b, m - b]]), n + m
    expected = np.outer([n, m], table.sum(axis=0)) / total
    assert np.isclose(toxicity.likelihood_ratio(np.array([a]), n, np.array([b]), m)[0], 2 * (table * np.log(table / expected)).sum())


def test_sample_may_be_all(spark):
    df = frame(spark, [(i, f"t{i}") for i in range(30)] + [(None, "n")])
    assert labelled.sample(df, df.select("doc_id"), F.lit(True), None).count() == 30
    nothing = toxicity.learn(df, df.select("doc_id", F.lit(0).alias("toxic")).limit(0), F.lit(True), None, None)
    assert nothing.scorer()("any text") < 0.3


def test_whole_text_score_of_the_network_against_plain_loops():
    q, net = quality_cnn, quality_cnn.Network(3)
    net.p["bias"] = net.p["bias"] + 0.2
    for text in (None, "short one", "ä long text, " * 120, "x" * 20_000):
        x, n = q.as_bytes(text), len((text or "").encode())
        pooled = []
        for start in range(0, (len(x) - q.WIDTH) // (q.STRIDE * q.STEP) - q.CHUNK + 1, q.ADVANCE):
            best = np.full(q.FILTERS, -np.inf)
            for place in range(start * q.STEP, (start + q.CHUNK) * q.STEP):
                best = np.maximum(best, sum(net.p["filters"][k][x[place * q.STRIDE + k]] for k in range(q.WIDTH)))
            pooled.append(np.maximum(best + net.p["bias"], 0))
        whole = q.STEP * q.CHUNK * q.STRIDE
        pooled = np.array(pooled)
        v = np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0), [min(n / whole, 1), np.log1p(n / whole)]])
        z = np.maximum(v @ net.p["w1"] + net.p["b1"], 0) @ net.p["w2"] + net.p["b2"][0]
        assert abs(net(text) - 1 / (1 + np.exp(-z))) < 1e-5


def test_network_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    size = quality_cnn.STEP * quality_cnn.CHUNK * quality_cnn.STRIDE + quality_cnn.WIDTH
    docs = [rng.integers(0, 256, (c, size)).astype(np.uint8) for c in (2, 1)]
    y, sizes = np.array([1.0, 0.0]), np.zeros((2, 2))

    def loss():
        total = 0.0
        for d, t in zip(docs, y):
            pooled = np.stack([net.answers(x).max(axis=0) for x in d])
            v = np.concatenate([f(np.maximum(pooled + net.p["bias"], 0), axis=0) for f in (np.mean, np.max, np.min)] + [np.zeros(2)])
            z = np.maximum(v @ net.p["w1"] + net.p["b1"], 0) @ net.p["w2"] + net.p["b2"][0]
            total += np.logaddexp(0, -z if t else z) / len(docs)
        return total

    g = net.gradient(docs, sizes, y)
    for name in ("bias", "w1", "b1", "w2", "b2"):
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-3 - grad[i]) < 1e-3


def test_chunks_cover_every_byte_and_scores_of_odd_texts(spark):
    for n in (0, 1, 511, 512, 513, 5000, 100_001):
        x = quality_cnn.as_bytes("a" * n)
        steps = (len(x) - quality_cnn.WIDTH) // (quality_cnn.STRIDE * quality_cnn.STEP)
        assert steps * quality_cnn.STRIDE * quality_cnn.STEP >= n and (steps - quality_cnn.CHUNK) % quality_cnn.ADVANCE == 0
    df = frame(spark, [*ODD, (8, "long " * 20_000)], clash=True)
    for module, model in ((quality_cnn, quality_cnn.Network()), (quality_cnn, 0.5), (toxicity, toxicity.fit([], [], 0.1))):
        got = module.score(df.select("doc_id", "kept", "text"), model).collect()
        assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
        assert module.score(df.select("doc_id", "text").limit(0), model).count() == 0
    assert quality_cnn.fit([], []) == 0.5 and quality_cnn.fit(["a"], []) == 1.0


def test_negative_clean_risk_steps_back():
    z_p, z_u = np.array([5.0, 6.0]), np.array([-9.0, -9.0])
    g_p, g_u, clean = toxicity.nn_pu_gradient(z_p, z_u, 0.5)
    assert clean < 0 and (g_u < 0).all() and (g_p > 0).all()
    g_p, g_u, clean = toxicity.nn_pu_gradient(np.array([-1.0]), np.array([1.0, 0.5]), 0.2)
    assert clean > 0 and (g_p < 0).all() and (g_u > 0).all()


def test_positive_unlabelled_learning_finds_planted_words():
    rng = np.random.default_rng(3)
    vocab = [f"wort{i}" for i in range(300)]
    text = lambda bad: " ".join([*rng.choice(vocab, 30), *(["schimpf" + rng.choice(["er", "te", "ling"])] if bad else [])])
    positive = [text(True) for _ in range(80)]
    mixture = [text(rng.random() < 0.1) for _ in range(600)]
    scorer = toxicity.fit(positive, mixture, 0.1).scorer()
    bad, good = [scorer(text(True)) for _ in range(60)], [scorer(text(False)) for _ in range(60)]
    assert min(bad) > max(good)
