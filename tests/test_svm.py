"""The squared-hinge SVM: its minimum, and the same weights from blocks that exchange sums."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagloom.operators import svm


def sample(n=90, m=40, seed=4):
    draw = np.random.default_rng(seed)
    x = np.where(draw.random((n, m)) < 0.2, draw.random((n, m)), 0)
    x[: n // 3, 7] = 1.0  # a term that many rows have
    y = (x[:, :5].sum(axis=1) + 0.2 * draw.normal(size=n) > 0.6).astype(int)
    return x, y


def frame(spark, x, y):
    rows = []
    for i, (v, label) in enumerate(zip(x, y)):
        at = np.flatnonzero(v)
        vector = Vectors.dense(v) if i % 10 == 0 else Vectors.sparse(len(v), at.tolist(), v[at].tolist())
        rows.append((i, int(label), vector))
    return spark.createDataFrame(rows, ["id", "label", "features"])


def slope(w, x, y, cost):
    """Of the objective; the last weight is the bias."""
    full = np.hstack([x, np.ones((len(x), 1))])
    sign = 2 * y - 1
    short = np.maximum(0, 1 - sign * (full @ w))
    return w - 2 * cost * full.T @ (sign * short)


def dense(weights, m):
    found = {r.term: r.weight for r in weights.collect()}
    return np.array([found.get(i, 0.0) for i in [*range(m), svm.BIAS]])


@pytest.mark.parametrize("cost", [0.1, 1.0, 30.0])
def test_slope_is_zero_at_the_minimum(spark, cost):
    x, y = sample()
    weights = svm.fit_weights(frame(spark, x, y), cost)
    assert np.abs(slope(dense(weights, x.shape[1]), x, y, cost)).max() < 1e-6
    assert {r.term: r.n for r in weights.collect()}[svm.BIAS] == len(x)


def test_blocks_that_exchange_sums_reach_the_same_minimum(spark):
    x, y = sample()
    rows = frame(spark, x, y)
    one = dense(svm.fit_weights(rows), x.shape[1])
    many = svm.fit_weights(rows, tol=1e-8, rows_per_block=25)
    assert np.abs(dense(many, x.shape[1]) - one).max() < 1e-5
    assert {r.term: r.n for r in many.collect()} == {r.term: r.n for r in svm.fit_weights(rows).collect()}


def test_rows_stay_where_they_lie(spark):
    """A pass shuffles the numbers of terms, not the rows."""
    x, y = sample()
    seen = []
    space_run = svm.Spread._run

    def run(self, kind, to, value, *sums):
        sent = self.rows.groupBy("block").cogroup(self.state.groupBy("block")).applyInArrow(svm._pass(kind), svm._STATE)
        seen.append(sent._jdf.queryExecution().executedPlan().toString())
        return space_run(self, kind, to, value, *sums)

    try:
        svm.Spread._run = run
        svm.fit_weights(frame(spark, x, y), tol=0.5, rows_per_block=25)
    finally:
        svm.Spread._run = space_run
    assert seen and all(plan.count("Exchange") == 1 and "values" not in plan.split("Exchange")[1] for plan in seen)


def test_margins(spark):
    x, y = sample()
    rows = frame(spark, x, y)
    weights = svm.fit_weights(rows)
    w = dense(weights, x.shape[1])
    want = x @ w[:-1] + w[-1]
    got = {r.id: r.margin for r in svm.margins(weights, rows).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)
    twice = {r.id: r.margin for r in svm.margins(weights, rows.unionByName(rows)).collect()}
    assert np.allclose([twice[i] for i in range(len(x))], want)
    unseen = spark.createDataFrame([(1, Vectors.sparse(100, [90], [2.0])), (2, Vectors.sparse(100, [], []))], ["id", "features"])
    assert {r.id: r.margin for r in svm.margins(weights, unseen).collect()} == pytest.approx({1: w[-1], 2: w[-1]})


def test_estimator(spark):
    x, y = sample()
    rows = frame(spark, x, y)
    scored = svm.SquaredHingeSVM().fit(rows).transform(rows).collect()
    assert len(scored) == len(x)
    assert all((r.rawPrediction[1] > 0) == (r.prediction == 1.0) and r.rawPrediction[0] == -r.rawPrediction[1] for r in scored)
    assert np.mean([r.prediction == r.label for r in scored]) > 0.8


def test_ties_and_no_rows(spark):
    x, y = np.ones((6, 1)), np.array([0, 1, 0, 1, 0, 1])  # equal rows of both classes
    w = dense(svm.fit_weights(frame(spark, x, y)), 1)
    assert np.abs(w).max() < 1e-9
    assert svm.fit_weights(frame(spark, x, y).limit(0)).count() == 0


def test_a_block_is_bounded_by_its_values(spark, monkeypatch):
    """Short rows, however many, are one block; few rows with many values are several."""
    held = []

    def spread(self, rows, cost, start=svm.Spread.__init__):
        held.append(rows.select("block").distinct().count())
        start(self, rows, cost)

    monkeypatch.setattr(svm.Spread, "__init__", spread)
    short = spark.range(9_000).select(
        (F.col("id") % 2).alias("label"), array_to_vector(F.array(F.col("id") % 2 + 0.5, F.lit(1.0))).alias("features")
    )
    w = {r.term: r.weight for r in svm.fit_weights(short).collect()}
    assert not held and w[0] > 0  # 9,000 rows of 2 values
    x, y = sample()
    monkeypatch.setattr(svm, "NUMBERS_PER_BLOCK", 400)
    svm.fit_weights(frame(spark, x, y), tol=0.5)
    assert held and held[0] > 1


def test_sums_that_go_to_the_driver(spark, monkeypatch):
    """More than a block has room for: the same weights without a table per pass, also for terms that one row has."""
    x, y = sample()
    alone = np.zeros((len(x), 30))
    alone[np.arange(30), np.arange(30)] = np.linspace(0.3, 2, 30)  # a row each
    alone[np.arange(15), 29 - np.arange(15)] = 0.7  # two terms of one row, which others have too
    x = np.hstack([x, alone])
    rows = frame(spark, x, y)
    one = {r.term: (r.weight, r.n) for r in svm.fit_weights(rows).collect()}
    for name, value in (("NUMBERS_PER_BLOCK", 400), ("NUMBERS_PER_PART", 60), ("CHUNK", 16)):
        monkeypatch.setattr(svm, name, value)
    monkeypatch.setattr(svm.Spread, "_run", None)
    many = svm.fit_weights(rows).collect()
    assert len(many) == len(one) and {r.term: r.n for r in many} == {term: n for term, (_, n) in one.items()}
    assert np.allclose([r.weight for r in many], [one[r.term][0] for r in many], atol=1e-8)


def test_more_numbers_than_the_driver_holds(spark, monkeypatch):
    x, y = sample()
    passes = []
    run = svm.Spread._run
    monkeypatch.setattr(svm, "NUMBERS_PER_BLOCK", 400)
    monkeypatch.setattr(svm, "HELD", 100)
    monkeypatch.setattr(svm.Spread, "_run", lambda *a: passes.append(a[1]) or run(*a))
    assert svm.fit_weights(frame(spark, x, y), tol=0.5).count() and passes


def test_passes_leave_few_shuffle_files():
    calls = []
    java = SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1)))
    space = SimpleNamespace(shuffled=0, sc=SimpleNamespace(_jvm=java))
    svm.Sums._tidy(space, svm.SHUFFLED)
    assert not calls
    svm.Sums._tidy(space, 1)
    assert calls == [1] and space.shuffled == 0
