"""Quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Learned filters of `WIDTH` bytes stand at every second byte; a filter
over one-hot bytes is a sum of table rows, so a layer of filters is WIDTH table lookups a place. Each chunk keeps the largest
answer of every filter (max pooling); the mean, largest and smallest over chunks and the size of the text (a short text shows few
patterns) go through a small hidden layer to one probability.

Training runs on the driver, on at most `MOST` texts of each label, chosen by a hash of their id, with some chunks of each in
turn; that sample is the only bound. Scoring runs in the tasks over all bytes of all texts, a block of places at a time.

Defined results: null and empty texts are one chunk of padding; if a label is missing in training the score is the share of
good labels (0.5 without any); repeated rows and null ids are scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import map_rows, schema
from zonecast.llm.labelled import sample, texts

MOST = 2000
WIDTH = 7
FILTERS = 24
HIDDEN = 16
STRIDE = 2
#: Places in a step, steps in a chunk, steps from a chunk to the next: chunks of 512 bytes that share 128.
STEP, CHUNK, ADVANCE = 64, 4, 3
#: Share of training texts of which a short part is shown.
CROPPED = 0.3
#: A text is called good from this score on.
CUT = 0.3


def as_bytes(text: str | None) -> np.ndarray:
    """The bytes with zeros behind, so that they fill whole steps and at least one chunk."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    places = -(-max(len(raw), 1) // STRIDE)
    steps = max(CHUNK, -(-places // STEP))
    steps = CHUNK + -(-(steps - CHUNK) // ADVANCE) * ADVANCE
    out = np.zeros(steps * STEP * STRIDE + WIDTH, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)),
            "bias": np.zeros(FILTERS),
            "w1": rng.normal(0, 0.2, (3 * FILTERS + 2, HIDDEN)),
            "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, 0.3, HIDDEN),
            "b2": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Filter answers (places, filters) of padded bytes."""
        n = (len(x) - WIDTH) // STRIDE
        out = np.take(self.p["filters"][0], x[0 : n * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.p["filters"][k], x[k : k + n * STRIDE : STRIDE], axis=0)
        return out

    @staticmethod
    def size(n_bytes: int) -> tuple[float, float]:
        """How full the first chunk is, and how long the text."""
        whole = STEP * CHUNK * STRIDE
        return min(n_bytes / whole, 1.0), np.log1p(n_bytes / whole)

    def chunks(self, text: str | None, block: int = 64) -> np.ndarray:
        """Pooled answers (chunks, filters) of a whole text."""
        x = as_bytes(text)
        steps = (len(x) - WIDTH) // (STRIDE * STEP)
        best = np.empty((steps, FILTERS), np.float32)
        for s in range(0, steps, block):
            e = min(s + block, steps)
            part = self.answers(x[s * STEP * STRIDE : e * STEP * STRIDE + WIDTH])
            best[s:e] = part.reshape(e - s, STEP, FILTERS).max(axis=1)
        starts = np.arange(0, steps - CHUNK + 1, ADVANCE)
        pooled = best[starts]
        for k in range(1, CHUNK):
            pooled = np.maximum(pooled, best[starts + k])
        return np.maximum(pooled + self.p["bias"], 0)

    def combine(self, pooled: np.ndarray, n_bytes: int) -> float:
        """The probability from pooled answers."""
        v = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), pooled.min(axis=0), self.size(n_bytes)])
        h = np.maximum(v @ self.p["w1"] + self.p["b1"], 0)
        return float(1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"][0], -30, 30))))

    def __call__(self, text: str | None) -> float:
        return self.combine(self.chunks(text), len((text or "").encode("utf-8", "surrogatepass")))

    def gradient(self, docs: list[np.ndarray], sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy over `docs`, each a stack of chunks of padded bytes (chunks, bytes)."""
        counts = np.array([len(d) for d in docs])
        x = np.concatenate(docs)
        n, places = len(x), STEP * CHUNK
        at = np.arange(places) * STRIDE
        best = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64)
        for s in range(0, n, 32):
            part = self.p["filters"][0][x[s : s + 32][:, at]]
            for k in range(1, WIDTH):
                part += self.p["filters"][k][x[s : s + 32][:, at + k]]
            where[s : s + 32] = part.argmax(axis=1)
            best[s : s + 32] = part.max(axis=1)
        pooled = np.maximum(best + self.p["bias"], 0)
        doc = np.repeat(np.arange(len(docs)), counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(pooled, begin) / counts[:, None]
        high, low = np.maximum.reduceat(pooled, begin), np.minimum.reduceat(pooled, begin)
        v = np.concatenate([mean, high, low, sizes], axis=1).astype(np.float32)
        a = v @ self.p["w1"] + self.p["b1"]
        h = np.maximum(a, 0)
        z = h @ self.p["w2"] + self.p["b2"][0]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = {"w2": h.T @ dz, "b2": dz.sum(keepdims=True)}
        da = np.outer(dz, self.p["w2"]) * (a > 0)
        g |= {"w1": v.T @ da, "b1": da.sum(axis=0)}
        dv = (da @ self.p["w1"].T)[:, : 3 * FILTERS]
        d_mean, d_high, d_low = np.split(dv, 3, axis=1)
        d = d_mean[doc] / counts[doc][:, None]
        for grad, ext in ((d_high, high), (d_low, low)):
            d += grad[doc] * (pooled == ext[doc]) / np.maximum(np.add.reduceat((pooled == ext[doc]).astype(np.float32), begin), 1)[doc]
        d *= pooled > 0
        g["bias"] = d.sum(axis=0)
        table = np.zeros((WIDTH, 256, FILTERS))
        row, col = np.nonzero(d)
        for k in range(WIDTH):
            seen = x[row, where[row, col] * STRIDE + k].astype(np.int64)
            table[k] = np.bincount(seen * FILTERS + col, d[row, col], 256 * FILTERS).reshape(256, FILTERS)
        g["filters"] = table
        return g


def _crop(text: str, rng: np.random.Generator) -> str:
    """A short part of a text, from a word's start: short texts are rare in the sample and hard to tell."""
    start = text.find(" ", int(rng.integers(0, max(len(text), 1)))) + 1
    return text[start : start + int(rng.integers(20, 300))]


def fit(good: list[str], bad: list[str], epochs: int = 16, most_chunks: int = 6, batch: int = 64, seed: int = 7) -> Network | float:
    """A trained network, or the share of good labels if one is missing. Both labels weigh as often as they are given."""
    if not good or not bad:
        return (len(good) / (len(good) + len(bad))) if good or bad else 0.5
    net, rng = Network(seed), np.random.default_rng(seed)
    whole = good + bad
    y = np.array([1.0] * len(good) + [0.0] * len(bad), np.float32)
    size = STEP * CHUNK * STRIDE
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(whole))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            docs, sizes = [], []
            for i in rows:
                text = _crop(whole[i], rng) if rng.random() < CROPPED else whole[i]
                x = as_bytes(text)
                starts = np.arange(0, len(x) - WIDTH - size + 1, STEP * ADVANCE * STRIDE)
                if len(starts) > most_chunks:
                    starts = rng.choice(starts, most_chunks, replace=False)
                docs.append(x[starts[:, None] + np.arange(size + WIDTH)])
                sizes.append(net.size(len(text.encode("utf-8", "surrogatepass"))))
            step += 1
            for k, g in net.gradient(docs, np.array(sizes), y[rows]).items():
                g = g.astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def learn(docs: DataFrame, labels: DataFrame, usable, most: int = MOST) -> Network | float:
    """Fit on labelled rows that are `usable` (a condition on doc_id): at most `most` of each label."""
    labels = labels.filter(usable)
    return fit(*(texts(sample(docs, labels, F.col("quality") == q, most)) for q in (1, 0)))


def score(docs: DataFrame, model: Network | float, cut: float = CUT) -> DataFrame:
    """Add score and predicted to `docs(text, ...)`, dropping the text. The model travels with the tasks: some 200 KB."""
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes)

    def make():
        def work(rows: dict) -> dict:
            found = [model(t) if callable(model) else model for t in rows["text"]]
            return {c: rows[c] for c in names} | {"score": found, "predicted": [int(s >= cut) for s in found]}

        return work

    return map_rows(docs.select(*names, "text"), make, schema(f"{fields}, score double, predicted int"))
