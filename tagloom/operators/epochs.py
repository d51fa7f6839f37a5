"""Two-class logistic regression on stored vectors, trained in epochs of mini-batches, with rows held out to choose the epoch.

A row's batch follows from its id and the seed, so batches are the same wherever rows lie. A batch's slope is a sum over its rows: a
row of numbers per task, added up in Spark; the weights, one per vector place and a bias, are on the driver and go with each
step (Adam). After each epoch the held-out rows' loss is taken, and the weights of the epoch with the least are kept, the first
of equals; without held-out rows the last epoch counts. Training rows that fit one block make all steps in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ordering import random_key
from tagloom.session import materialize, new_path

N_BATCHES = 16
RATE = 0.05
ROWS_PER_BLOCK = 8_192
DECAYS, TINY = (0.9, 0.999), 1e-8


def batch_of(id_col: str, seed, n_batches: int = N_BATCHES) -> Column:
    """The batch of a row, by hash."""
    digits = F.conv(F.substring(random_key(id_col, f"{seed}:batch"), 1, 8), 16, 10).cast("bigint")
    return (digits % n_batches).cast("int")


def slope_and_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows; the last weight is the bias."""
    z = x @ w[:-1] + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    gap = p - y
    return np.append(gap @ x, gap.sum()), float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())


class Steps:
    """Weights and what Adam remembers."""

    def __init__(self, n: int):
        self.w, self.m, self.v, self.t = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0

    def step(self, slope: np.ndarray, rows: float) -> None:
        if not rows:
            return  # an empty batch
        g = slope / rows
        self.t += 1
        self.m = DECAYS[0] * self.m + (1 - DECAYS[0]) * g
        self.v = DECAYS[1] * self.v + (1 - DECAYS[1]) * g * g
        m, v = self.m / (1 - DECAYS[0] ** self.t), self.v / (1 - DECAYS[1] ** self.t)
        self.w = self.w - RATE * m / (np.sqrt(v) + TINY)


def train(n: int, n_epochs: int, n_batches: int, sums) -> tuple[np.ndarray, list[float]]:
    """(weights of the best epoch, held-out loss per epoch). `sums(batch, w)` gives slope, loss and rows of a batch; batch -1 is
    the held-out rows."""
    steps, losses, best = Steps(n), [], np.zeros(n + 1)
    for _ in range(n_epochs):
        for batch in range(n_batches):
            slope, _, rows = sums(batch, steps.w)
            steps.step(slope, rows)
        _, loss, rows = sums(-1, steps.w)
        losses.append(loss / rows if rows else float("nan"))
        if not rows or losses[-1] < min(losses[:-1], default=np.inf):
            best = steps.w
    return best, losses


def _arrays(table) -> tuple[np.ndarray, np.ndarray]:
    x = table.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(table.column("y")), -1), table.column("y").to_numpy()


def _whole(n: int, n_epochs: int, n_batches: int):
    def run(table: pa.Table) -> pa.Table:
        # Rows in one order, so that sums are too.
        table = table.sort_by([("batch", "ascending"), ("key", "ascending")])
        batch = table.column("batch").to_numpy()
        x, y = _arrays(table)
        edges = {b: slice(*np.searchsorted(batch, [b, b + 1])) for b in range(-1, n_batches)}

        def sums(b, w):
            part = edges[b]
            return (*slope_and_loss(x[part], y[part], w), part.stop - part.start)

        w, losses = train(n, n_epochs, n_batches, sums)
        return pa.table({"w": pa.array([w], pa.list_(pa.float64())), "losses": pa.array([losses], pa.list_(pa.float64()))})

    return run


def fit_epochs(
    rows: DataFrame, n_epochs: int = 3, n_batches: int = N_BATCHES, rows_per_block: int = ROWS_PER_BLOCK
) -> tuple[np.ndarray, list[float]]:
    """(weights and bias, held-out loss per epoch) for `<key, batch, x, y>`: vectors of one length as arrays, y 0 or 1, batch
    -1 for held-out rows. No rows give no weights."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return np.zeros(1), []
    n = first[0]
    if rows.count() <= rows_per_block:
        one = rows.withColumn("block", F.lit(0)).groupBy("block")
        found = one.applyInArrow(_whole(n, n_epochs, n_batches), "w array<double>, losses array<double>").first()
        return np.array(found["w"]), found["losses"]
    path = new_path(rows.sparkSession, "batches")
    rows.write.partitionBy("batch").parquet(path)
    stored = rows.sparkSession.read.parquet(path)

    def sums(batch, w):
        def run(batches):
            total = np.zeros(n + 3)
            for part in batches:
                if len(part):
                    slope, loss = slope_and_loss(*_arrays(part), w)
                    total += [*slope, loss, len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 3)), pa.array(total)], names=["at", "x"])

        tasks = stored.filter(F.col("batch") == batch).select("x", "y").mapInArrow(run, "at bigint, x double")
        added = {r["at"]: r["x"] for r in tasks.groupBy("at").agg(F.sum("x").alias("x")).collect()}  # one row per weight
        total = np.array([added.get(i, 0.0) for i in range(n + 3)])
        return total[: n + 1], total[-2], total[-1]

    return train(n, n_epochs, n_batches, sums)


class EpochClassifier(Estimator):
    """On `id`, `label`, dense `features` and, where it is there, `is_valid`, which tells the held-out rows."""

    holds_out = True

    def __init__(self, n_epochs: int = 3, seed=0, n_batches: int = N_BATCHES, rows_per_block: int = ROWS_PER_BLOCK):
        super().__init__()
        self.n_epochs, self.seed, self.n_batches, self.rows_per_block = n_epochs, seed, n_batches, rows_per_block

    def _fit(self, dataset):
        batch = batch_of("id", self.seed, self.n_batches)
        if "is_valid" in dataset.columns:
            batch = F.when(F.col("is_valid"), -1).otherwise(batch)
        vector = F.unwrap_udt("features")
        x = F.when(vector["indices"].isNull(), vector["values"]).otherwise(F.raise_error(F.lit("vectors must be dense")))
        rows = dataset.select(
            random_key("id", self.seed).alias("key"), batch.alias("batch"), x.alias("x"), F.col("label").cast("double").alias("y")
        )
        return EpochModel(*fit_epochs(materialize(rows, "epoch-rows"), self.n_epochs, self.n_batches, self.rows_per_block))


@dataclass(eq=False)
class EpochModel(Model):
    """Adds `rawPrediction` and `prediction`; `losses` are those of the held-out rows."""

    weights: np.ndarray
    losses: list[float]

    def __post_init__(self):
        super().__init__()

    def _transform(self, dataset):
        terms = F.zip_with(F.unwrap_udt("features")["values"], F.array(*map(F.lit, self.weights[:-1].tolist())), lambda a, b: a * b)
        z = F.aggregate(terms, F.lit(float(self.weights[-1])), lambda total, term: total + term)
        scored = dataset.withColumn("_z", z)
        raw = array_to_vector(F.array(-F.col("_z"), F.col("_z")))
        return scored.withColumns({"rawPrediction": raw, "prediction": (F.col("_z") > 0).cast("double")}).drop("_z")
