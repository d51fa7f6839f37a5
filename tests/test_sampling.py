import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tagloom.operators import ordering
from tagloom.operators import sampling as S


def key(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows, a tenth positive, a few without label."""
    label = F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 10 == 0, 1).otherwise(0)
    return spark.range(600).select("id", label.alias("label"), (F.col("id") % 20 == 0).cast("int").alias("weak_label"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_positions_are_the_md5_order(spark, rows):
    got = {r.id: r.pos for r in ordering.with_position(rows, "id", "s").collect()}
    want = {i: pos for pos, i in enumerate(sorted(range(600), key=lambda i: key(i, "s")))}
    assert got == want
    grouped = ordering.with_position(rows.filter("label is not null"), "id", "s", ["label"]).collect()
    for label in (0, 1):
        part = sorted((r.pos, r.id) for r in grouped if r.label == label)
        assert [p for p, _ in part] == list(range(len(part)))
        assert [i for _, i in part] == sorted((i for _, i in part), key=lambda i: key(i, "s"))


@pytest.mark.parametrize("n", [0, 1, 5, 599, 600, 1000])
def test_flag_first_sizes(rows, n):
    want = sorted(sorted(range(600), key=lambda i: key(i, 3))[:n])
    assert ids(ordering.take_first(rows, "id", 3, n)) == want


def test_flag_first_does_not_depend_on_partitioning(rows):
    a = ids(ordering.take_first(rows.repartition(1), "id", 9, 77))
    b = ids(ordering.take_first(rows.repartition(23, F.rand()), "id", 9, 77))
    assert a == b and len(a) == 77


def test_one_crowded_bucket(spark, monkeypatch):
    """All rows in one bucket still give exact results."""
    monkeypatch.setattr(ordering, "PREFIX_DIGITS", 0)
    rows = spark.range(100)
    assert ids(ordering.take_first(rows, "id", 1, 10)) == sorted(sorted(range(100), key=lambda i: key(i, 1))[:10])


def test_quota_table(spark, rows):
    quotas = spark.createDataFrame([(0, 4), (1, 1000)], "label int, n int")
    got = ordering.take_first(rows, "id", 0, quotas, "label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 4, 1: 60}


@pytest.mark.parametrize("share", S.NEG_SHARES)
def test_budget_sample(rows, share):
    sample = S.budget_sample(rows, 40, share, seed=1).collect()
    assert len(sample) == 40 and sum(r.label == 0 for r in sample) == int(share * 40)
    assert sorted(r.pos for r in sample) == list(range(40))
    assert len({r.id for r in sample}) == 40


def test_samples_drawn_together_are_those_drawn_alone(rows):
    parts = [(40, 0.95), (40, 0.5), (30, 0.9)]
    together = S.budget_samples(rows, parts, seed=1).collect()
    for budget, share in parts:
        alone = {(r.id, r.label, r.pos) for r in S.budget_sample(rows, budget, share, seed=1).collect()}
        pct = str(S.budget_parts(budget, share)[2])
        assert {(r.id, r.label, r.pos) for r in together if (r.sample, r.budget) == (pct, budget)} == alone
    assert len(together) == 110
    with pytest.raises(S.TooFewRows):
        S.budget_samples(rows, [(40, 0.5), (1000, 0.5)])


def test_budget_too_large(rows):
    with pytest.raises(S.TooFewRows):
        S.budget_sample(rows, 1000, 0.5)


def test_budget_parts():
    assert [S.budget_parts(20000, share) for share in S.NEG_SHARES] == [
        (19000, 1000, 5), (18000, 2000, 10), (10000, 10000, 50),
    ]


def test_random_split(rows):
    train, test = S.random_split(rows)
    assert len(ids(test)) == math.ceil(0.101 * 600) and sorted(ids(train) + ids(test)) == list(range(600))


@pytest.mark.parametrize("strategy", ["random", "balanced", "stratified"])
def test_split_data(rows, strategy):
    known = rows.filter("label is not null")
    n = known.count()
    flagged = S.split_data(known, strategy, 0.1, seed=2).collect()
    valid = [r for r in flagged if r.is_valid]
    assert len(flagged) == n and len(valid) == n - int(n * 0.9)
    if strategy == "balanced":
        counts = [sum(r.label == c for r in valid) for c in (0, 1)]
        assert abs(counts[0] - counts[1]) <= 1
    if strategy == "stratified":
        share = sum(r.label for r in flagged) / n
        assert abs(sum(r.label for r in valid) - share * len(valid)) < 1


def test_split_errors(spark, rows):
    with pytest.raises(ValueError):
        S.split_data(rows, "other")
    lopsided = spark.range(100).select("id", (F.col("id") == 0).cast("int").alias("label"))
    with pytest.raises(S.TooFewRows):
        S.split_data(lopsided, "balanced", 0.5)


def test_cold_starts(rows):
    assert S.cold_start(rows, "TrueRandom", 30).filter("label is not null").count() == 30
    balanced = S.cold_start(rows, "BalancedRandom", 30).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in balanced} == {0: 15, 1: 15}
    weak = S.cold_start(rows, "BalancedWeak", 30).groupBy("weak_label").count().collect()
    assert {r.weak_label: r["count"] for r in weak} == {0: 15, 1: 15}
    filled = S.cold_start(rows, "BalancedWeak", 100).groupBy("weak_label").count().collect()
    assert {r.weak_label: r["count"] for r in filled} == {0: 70, 1: 30}
    with pytest.raises(ValueError, match="unknown"):
        S.cold_start(rows, "Other", 10)
    with pytest.raises(S.TooFewRows):
        S.cold_start(rows, "BalancedRandom", 400)
    with pytest.raises(S.TooFewRows):
        S.cold_start(rows, "TrueRandom", 601)


def test_validation_sets(rows):
    initial = S.cold_start(rows, "BalancedRandom", 60)
    valid = S.flag_al_validation(initial, 60).filter("is_valid").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in valid} == {0: 3, 1: 3}
    supervised = S.flag_sl_validation(rows)
    sizes = {r.label: r["count"] for r in rows.filter("label is not null").groupBy("label").count().collect()}
    got = {r.label: r["count"] for r in supervised.filter("is_valid").groupBy("label").count().collect()}
    assert got == {c: int(0.1 * n) for c, n in sizes.items()}


def test_head(rows):
    assert S.head(S.shuffled(rows, 4), 10).count() == 10
