"""Epochs of mini-batches: steps against plain loops, one task against one job per batch, the epoch that is kept."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagloom.operators import epochs


def sample(spark, n=300, seed=2):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 6))
    y = (x[:, 0] - x[:, 1] + 0.5 * draw.normal(size=n) > 0).astype(int)
    rows = [(i, int(label), Vectors.dense(v), i % 10 == 0) for i, (v, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "label", "features", "is_valid"]), x, y


def prepared(rows, seed=0, n_batches=4):
    return rows.select(
        F.md5(F.col("id").cast("string").cast("binary")).alias("key"),
        F.when(F.col("is_valid"), -1).otherwise(epochs.batch_of("id", seed, n_batches)).alias("batch"),
        F.unwrap_udt("features")["values"].alias("x"),
        F.col("label").cast("double").alias("y"),
    )


def test_epochs_against_a_plain_loop(spark):
    rows, x, y = sample(spark)
    given = prepared(rows)
    w, losses = epochs.fit_epochs(given, 5, 4)
    batch = {tuple(r.x): r.batch for r in given.collect()}
    at = np.array([batch[tuple(v)] for v in x])
    full = np.hstack([x, np.ones((len(x), 1))])
    v = m = s = np.zeros(7)
    t, seen = 0, []
    for _ in range(5):
        for b in range(4):
            own = at == b
            g = ((1 / (1 + np.exp(-full[own] @ v)) - y[own])[:, None] * full[own]).mean(axis=0)
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            v = v - epochs.RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + epochs.TINY)
        z = full[at == -1] @ v
        seen.append((np.mean(np.logaddexp(0, np.where(y[at == -1] > 0, -z, z))), v))
    assert losses == pytest.approx([loss for loss, _ in seen])
    assert w == pytest.approx(min(seen, key=lambda e: e[0])[1])


def test_one_task_and_one_job_per_batch_agree(spark):
    rows, _, _ = sample(spark)
    given = prepared(rows).repartition(5)
    one, many = epochs.fit_epochs(given, 2, 4), epochs.fit_epochs(given, 2, 4, rows_per_block=50)
    assert many[0] == pytest.approx(one[0], rel=1e-9) and many[1] == pytest.approx(one[1], rel=1e-9)


def test_best_epoch_is_kept_and_empty_batches_make_no_step():
    losses = iter([3.0, 1.0, 1.0, 2.0])
    calls = []

    def sums(batch, w):
        calls.append(batch)
        if batch == -1:
            return np.zeros(2), next(losses), 1
        return np.ones(2), 0.0, 0 if batch == 1 else 2

    w, seen = epochs.train(1, 4, 2, sums)
    assert seen == [3.0, 1.0, 1.0, 2.0] and calls == [0, 1, -1] * 4
    assert w == pytest.approx([-2 * epochs.RATE] * 2)  # after two steps, the first epoch with the least loss


def test_classifier(spark):
    rows, _, _ = sample(spark)
    model = epochs.EpochClassifier(6).fit(rows)
    scored = model.transform(rows).collect()
    assert len(model.losses) == 6 and np.mean([r.prediction == r.label for r in scored]) > 0.8
    assert all((r.rawPrediction[1] > 0) == (r.prediction == 1.0) for r in scored)
    last = epochs.EpochClassifier(2).fit(rows.drop("is_valid"))
    assert np.isnan(last.losses).all() and np.abs(last.weights).max() > 0
    assert epochs.EpochClassifier().fit(rows.limit(0)).losses == []
    sparse = spark.createDataFrame([(1, 1, Vectors.sparse(3, [1], [1.0]))], ["id", "label", "features"])
    with pytest.raises(Exception, match="dense"):
        epochs.EpochClassifier().fit(sparse)
