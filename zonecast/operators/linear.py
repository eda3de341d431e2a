"""Penalised count regression with a log link, fitted by Newton steps over distributed sums.

The loss is the mean half deviance of a Poisson (power 1) or Tweedie (power between 1 and 2) response plus `alpha / 2` times the squared
weights; the intercept is not penalised. Inputs are scaled to 0..1 on the training rows. A step needs one pass: each task adds up
the gradient, the weighted products of all pairs of inputs and the loss, and Spark adds up the tasks. What reaches the driver is one
number for each pair of inputs, whatever the number of rows and tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest exponent of the link; a forecast beyond it would not fit a double in the sums.
MOST = 50.0


@dataclass(frozen=True)
class LinearModel:
    low: list[float]
    span: list[float]
    weights: list[float]
    intercept: float
    iterations: int

    def linear(self, x: Column) -> Column:
        """The linear part for an array of inputs."""
        terms = [
            (F.get(x, F.lit(i)) - F.lit(low)) * F.lit(w / span)
            for i, (low, span, w) in enumerate(zip(self.low, self.span, self.weights)) if w
        ]
        return F.least(reduce(lambda a, b: a + b, terms, F.lit(self.intercept)), F.lit(MOST))

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` with `prediction`, from the array or vector column `features`."""
        return rows.withColumn("prediction", F.exp(self.linear(as_array(rows))))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        return cls(**json.loads(spark.read.parquet(path).first().model))


def as_array(rows: DataFrame) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.col("features") if rows.schema["features"].dataType.typeName() == "array" else vector_to_array("features")


def bounds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least value and range of each input; a constant input has range 1, so it scales to 0."""
    n = rows.select(F.size("x").alias("n")).first().n
    cells = [f(F.get("x", F.lit(i))) for i in range(n) for f in (F.min, F.max)]
    found = np.array(rows.agg(F.array(*cells).alias("v")).first().v, dtype=float).reshape(n, 2)
    span = found[:, 1] - found[:, 0]
    return found[:, 0], np.where(span > 0, span, 1.0)


def loss_parts(eta: np.ndarray, y: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half deviance up to a constant, its slope in the linear part, and its expected curvature."""
    mu = np.exp(np.minimum(eta, MOST))
    if power == 1:
        return mu - y * eta, mu - y, mu
    up, down = mu ** (2 - power), mu ** (1 - power)
    return up / (2 - power) - y * down / (1 - power), up - y * down, up


def _sums(rows: DataFrame, low: np.ndarray, span: np.ndarray, w: np.ndarray, power: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature over all rows at the weights `w`, whose last entry is the intercept."""
    size = len(w)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 + size + size * size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size - 1)
            x = np.hstack([(x - low) / span, np.ones((len(x), 1))])
            loss, slope, bend = loss_parts(x @ w, batch.column("label").to_numpy(zero_copy_only=False), power)
            total += np.concatenate([[loss.sum()], x.T @ slope, ((x * bend[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    parts = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(1 + size + size * size)
    for r in parts:
        total[r.at] = r.value
    return total[0], total[1 : 1 + size], total[1 + size :].reshape(size, size)


def fit(train: DataFrame, power: float = 1.0, alpha: float = 0.1, max_iter: int = 500, tol: float = 1e-10) -> LinearModel:
    """Fit `label` on `features` (an array or a vector). Without rows there is nothing to fit: ValueError."""
    rows = train.select(as_array(train).alias("x"), F.col("label").cast("double").alias("label"))
    n, mean = rows.agg(F.count("label"), F.avg("label")).first()
    if not n:
        raise ValueError("no training rows")
    low, span = bounds(rows)
    penalty = np.append(np.full(len(low), alpha), 0.0)
    w = np.append(np.zeros(len(low)), np.log(max(mean, 1e-12)))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = _sums(rows, low, span, w, power)
        return loss / n + (penalty * w * w).sum() / 2, slope / n + penalty * w, bend / n + np.diag(penalty)

    value, slope, bend = at(w)
    steps = 0
    while steps < max_iter and np.abs(slope).max() > tol:
        steps += 1
        # least squares, because inputs may depend on each other when nothing is penalised
        step = np.linalg.lstsq(bend, slope, rcond=None)[0]
        share = 1.0
        while True:
            trial = w - share * step
            found = at(trial)
            if found[0] <= value or share < 1e-6:
                break
            share /= 2
        gain, w = value - found[0], trial
        value, slope, bend = found
        if gain <= 1e-15 * max(1.0, abs(value)):
            break
    return LinearModel(low.tolist(), span.tolist(), w[:-1].tolist(), float(w[-1]), steps)
