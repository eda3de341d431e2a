"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; all other texts, whatever their label, are unlabelled: a mixture that holds toxic texts at the
rate `prior`. With loss l the risk is

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

where the second term is the loss on clean texts as the mixture shows it. Where a batch drives it below zero, the step goes
against it instead. Two linear models, trained on different batches, are averaged.

Features are words and their parts of 4 to 6 characters (marks at both ends), hashed. Tasks count in how many positive and unlabelled
texts each hash occurs; a feature is kept if that differs by more than chance allows among so many features (likelihood ratio). How
strict the test is and how strongly weights are held back is chosen by the risk on held-out thirds of the training texts, whose
features were not chosen with them. A text has a feature or has not, however long it is, and every word of it counts.

Bounds: `MOST_POSITIVE` and `MOST_UNLABELLED` texts, chosen by a hash of their id, train the weights; None takes all. What reaches the driver
is the counts of at most 2^`HASH_BITS` hashes and the numbers of at most 4 `FEATURES` kept ones for each training text, never a text.
All texts are scored.

Defined results: null and empty texts get the score of a text without features; without a positive or an unlabelled text every score is
the prior; repeated rows are scored each, null ids too.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.llm.labelled import sample
from zonecast.session import materialize

MOST_POSITIVE, MOST_UNLABELLED = 2000, 8000
#: Most features that are kept, the strongest first.
FEATURES = 1024
#: Likelihood ratios from which a feature is kept, and penalties of the weights, to choose from.
STRICT, DECAY = (11.0, 16.0, 24.0), (1e-4, 1e-3, 1e-2)
FOLDS = 3
HASH_BITS = 20
PARTS = (4, 5, 6)
#: A text is called toxic from this score on.
CUT = 0.3

_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> set[int]:
    marked = f"^{word}$"
    found = {marked} | {marked[i : i + n] for n in PARTS for i in range(len(marked) - n + 1)}
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1) for x in found}


class Featurizer:
    """Kept features of a text, with those of each word remembered up to `most` words. `kept` maps hashes to columns; None keeps all."""

    def __init__(self, kept: dict[int, int] | None = None, most: int = 300_000):
        self._kept, self._most, self._words = kept, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        found: set[int] = set()
        for word in words:
            known = self._words.get(word)
            if known is None:
                if len(self._words) > self._most:
                    self._words = {}
                known = features_of(word)
                if self._kept is not None:
                    known = {self._kept[x] for x in known if x in self._kept}
                self._words[word] = known = tuple(known)
            if known:
                found.update(known)
        return np.array(sorted(found), np.int32)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def nn_pu_gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the risk in the outputs for positives and unlabelled texts (logistic loss), and the clean part of the risk."""
    clean = softplus(z_u).mean() - prior * softplus(z_p).mean()
    on_u = sigmoid(z_u) / len(z_u)
    on_p = -prior * sigmoid(z_p) / len(z_p)
    if clean < 0:  # the estimate overfits: step back
        return -on_p, -on_u, clean
    return on_p - prior * sigmoid(-z_p) / len(z_p), on_u, clean


def nn_pu_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The non-negative risk of outputs for positives and unlabelled texts."""
    on_positive = softplus(-z_p).mean()
    return float(prior * on_positive + max(0.0, softplus(z_u).mean() - prior * softplus(z_p).mean()))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, decay: float, epochs: int = 60, batches: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        n = max(1, min(batches, len(p), len(u)))
        for i in range(n):
            x_p, x_u = positive[p[i::n]], unlabelled[u[i::n]]
            g_p, g_u, _ = nn_pu_gradient(x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1], prior)
            g = np.append(x_p.T @ g_p + x_u.T @ g_u + decay * w[:-1], g_p.sum() + g_u.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= (0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def likelihood_ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """G squared of features that `a` of `n` positives and `b` of `m` unlabelled texts have."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    share = (a + b) / max(n + m, 1)
    total = np.zeros(a.shape)
    for seen, expected in ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share))):
        part = seen > 0
        total[part] += 2 * seen[part] * np.log(seen[part] / expected[part])
    return total


def strongest(strength: np.ndarray, strict: float, features: int) -> np.ndarray:
    """Places of the features of at least `strict`, at most so many, in order of place."""
    best = np.argsort(-strength, kind="stable")[:features]
    return np.sort(best[strength[best] >= strict])


class Model:
    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.kept, self.weights, self.bias = kept, weights, bias

    def scorer(self):
        featurize = Featurizer({int(h): i for i, h in enumerate(self.kept)})
        return lambda text: float(sigmoid(self.weights[:, featurize(text)].sum(axis=1) + self.bias).mean())


def constant(prior: float) -> Model:
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([np.log(p / (1 - p))]))


def dense(rows: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """1 where a text has a feature; `rows` hold sorted hashes, `hashes` ascend."""
    x = np.zeros((len(rows), len(hashes)), np.float32)
    for i, found in enumerate(rows):
        at = np.searchsorted(hashes, found)
        inside = at < len(hashes)
        inside[inside] = hashes[at[inside]] == found[inside]
        x[i, at[inside]] = 1
    return x


def fit_counted(
    hashes: np.ndarray, counts: np.ndarray, rows: tuple[list[np.ndarray], list[np.ndarray]], folds: tuple[np.ndarray, np.ndarray],
    prior: float, features: int = FEATURES, models: int = 2,
) -> Model:
    """Choose features and penalty by the risk on held-out folds and fit them on all texts.

    `counts[k, f]` holds for each of `hashes` in how many texts of fold f it occurs, positive (k = 0) and unlabelled ones (1). `rows` are the
    hashes of the texts, `folds` their folds.
    """
    sizes = np.array([np.bincount(f, minlength=FOLDS) for f in folds])
    if not 0 < prior < 1 or not sizes[0].sum() or not sizes[1].sum():
        return constant(prior)

    def strength(held: int | None) -> np.ndarray:
        used = [f for f in range(FOLDS) if f != held]
        return likelihood_ratio(counts[0, used].sum(axis=0), sizes[0][used].sum(), counts[1, used].sum(axis=0), sizes[1][used].sum())

    risks: dict[tuple[float, float], float] = dict.fromkeys([(s, d) for s in STRICT for d in DECAY], 0.0)
    for held in range(FOLDS):
        if (sizes[:, held] == 0).any() or (sizes.sum(axis=1) == sizes[:, held]).any():
            continue
        alone = strength(held)
        for strict in STRICT:
            kept = hashes[strongest(alone, strict, features)]
            x = [dense(r, kept) for r in rows]
            for decay in DECAY:
                w, bias = train(*[m[f != held] for m, f in zip(x, folds)], prior, 0, decay)
                risks[strict, decay] += nn_pu_risk(*[m[f == held] @ w + bias for m, f in zip(x, folds)], prior)
    strict, decay = min(risks, key=lambda k: (risks[k], -k[0], -k[1]))
    kept = hashes[strongest(strength(None), strict, features)]
    x = [dense(r, kept) for r in rows]
    found = [train(*x, prior, seed, decay) for seed in range(models)]
    return Model(kept, np.stack([w for w, _ in found]), np.array([b for _, b in found]))


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """`learn` for texts at hand."""
    featurize = Featurizer()
    rows = tuple([featurize(t) for t in part] for part in (positive, unlabelled))
    folds = tuple(np.arange(len(part)) % FOLDS for part in rows)
    hashes = np.unique(np.concatenate([*rows[0], *rows[1], np.zeros(0, np.int32)])).astype(np.int64)
    counts = np.zeros((2, FOLDS, len(hashes)), np.int64)
    for k, (part, fold) in enumerate(zip(rows, folds)):
        for found, f in zip(part, fold):
            counts[k, f, np.searchsorted(hashes, found)] += 1
    return fit_counted(hashes, counts, rows, folds, prior)


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their counts by kind and fold, of `rows(kind, fold, text)`: summed in each task first, 2^HASH_BITS rows at most."""
    def run(batches):
        import pyarrow as pa

        featurize, total = Featurizer(), np.zeros((2 * FOLDS, 1 << HASH_BITS), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for kind, fold, text in zip(part["kind"], part["fold"], part["text"]):
                    total[kind * FOLDS + fold, featurize(text)] += 1
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(t[seen].astype(np.int64)) for t in total]], names=["hash", *names])

    names = [f"n{i}" for i in range(2 * FOLDS)]
    counted = rows.mapInArrow(run, ", ".join(["hash long", *(f"{n} long" for n in names)])).groupBy("hash").agg(*[F.sum(n).alias(n) for n in names])
    # a feature that one text has can pass no test
    positives = sum(F.col(n) for n in names[:FOLDS])
    got = counted.filter(positives + sum(F.col(n) for n in names[FOLDS:]) > 2).toPandas().sort_values("hash")
    return got["hash"].to_numpy(np.int64), got[names].to_numpy(np.int64).T.reshape(2, FOLDS, -1)


def learn(
    docs: DataFrame, labels: DataFrame, usable, most_positive: int | None = MOST_POSITIVE, most_unlabelled: int | None = MOST_UNLABELLED
) -> Model:
    """Fit on the rows that are `usable` (a condition on doc_id). The prior is the share of confirmed toxic texts among usable labels."""
    labels = labels.filter(usable & F.col("toxic").isNotNull())
    total, toxic = labels.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = (toxic or 0) / total if total else 0.0
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    parts = [sample(docs, labels, F.col("toxic") == 1, most_positive), sample(docs, docs.select("doc_id"), usable, most_unlabelled)]
    parts = [p.select(F.lit(kind).alias("kind"), fold, "doc_id", "text") for kind, p in enumerate(parts)]
    rows = materialize(parts[0].unionByName(parts[1]), "toxicity_rows")
    hashes, counts = count_features(rows.drop("doc_id"))
    # all that any choice may keep
    sizes = {(r["kind"], r["fold"]): r["count"] for r in rows.groupBy("kind", "fold").count().collect()}  # 6 rows
    wanted: set[int] = set()
    for held in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != held]
        n = [sum(sizes.get((kind, f), 0) for f in used) for kind in (0, 1)]
        wanted.update(strongest(likelihood_ratio(counts[0, used].sum(axis=0), n[0], counts[1, used].sum(axis=0), n[1]), min(STRICT), FEATURES).tolist())
    at = np.array(sorted(wanted), dtype=np.int64)
    hashes, counts = hashes[at], counts[:, :, at]
    column = {int(h): int(h) for h in hashes}

    def make():
        featurize = Featurizer(column)
        return lambda r: {"kind": r["kind"], "fold": r["fold"], "doc_id": r["doc_id"], "found": [featurize(t) for t in r["text"]]}

    found = map_rows(rows, make, schema("kind int, fold int, doc_id long, found array<int>")).collect()
    # in an order that does not depend on tasks
    found = sorted(found, key=lambda r: (r["kind"], r["doc_id"], len(r["found"]), r["found"]))
    kinds = [[r for r in found if r["kind"] == k] for k in (0, 1)]
    texts = tuple([np.array(r["found"], np.int64) for r in part] for part in kinds)
    return fit_counted(hashes, counts, texts, tuple(np.array([r["fold"] for r in part], int) for part in kinds), prior)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Add score and predicted to `docs(text, ...)`, dropping the text. The model travels with the tasks: some 40 KB."""
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes)

    def make():
        scorer = model.scorer()

        def work(rows: dict) -> dict:
            found = [scorer(t) for t in rows["text"]]
            return {c: rows[c] for c in names} | {"score": found, "predicted": [int(s >= cut) for s in found]}

        return work

    return map_rows(docs.select(*names, "text"), make, schema(f"{fields}, score double, predicted int"))
