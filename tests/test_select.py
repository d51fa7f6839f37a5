import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import kmeans as K
from tagloom.operators import select as Q


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(120, 4)).round(3)
    points[40:60] = points[40]  # exact copies
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), points.astype("float32").astype("float64")


def greedy(points, labelled, n, normalize):
    if normalize:
        points = points / np.linalg.norm(points, axis=1)[:, None]
    dist = np.full(len(points), np.inf)
    for i in labelled:
        dist = np.minimum(dist, np.linalg.norm(points - points[i], axis=1))
    open_ids = [i for i in range(len(points)) if i not in labelled]
    picks = []
    for _ in range(n):
        best = min((i for i in open_ids if i not in picks), key=lambda i: (-round(dist[i], 9), i), default=None)
        if best is None:
            break
        picks.append(best)
        dist = np.minimum(dist, np.linalg.norm(points - points[best], axis=1))
    return picks


@pytest.mark.parametrize("candidates", [1, 4, 30, None])
@pytest.mark.parametrize("normalize", [True, False])
def test_coreset_is_exact_for_any_list_size(vectors, candidates, normalize):
    df, points = vectors
    labelled = df.filter("id < 3")
    pool = df.filter("id >= 3")
    n = 6 if candidates == 1 else 25
    got = Q.coreset_query(pool, labelled, n, normalize=normalize, candidates=candidates).orderBy("picked_rank")
    assert [r.id for r in got.collect()] == greedy(points, [0, 1, 2], n, normalize)


@pytest.mark.parametrize("cells", [1, 3, 17])
def test_coreset_is_exact_for_any_cells(vectors, cells):
    df, points = vectors
    got = Q.coreset_query(df.filter("id >= 3"), df.filter("id < 3"), 40, candidates=9, block=2, cells=cells)
    assert [r.id for r in got.orderBy("picked_rank").collect()] == greedy(points, [0, 1, 2], 40, True)


def test_coreset_leaves_cells_out_of_reach_alone(spark):
    """Twenty far groups: 500 exact picks with a fraction of the comparisons of all rows with all picks."""
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(20, 8)) * 40)[rng.integers(0, 20, 3_000)] + rng.normal(size=(3_000, 8))
    points = points.astype("float32").astype("float64")
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    arguments = (df.filter("id > 0"), df.filter("id = 0"), 500, "embedding", "id", False, 200, 4_096)
    picks, compared = Q._coreset(*arguments, 40)
    assert picks == greedy(points, [0], 500, False)
    assert compared < 0.3 * 2_999 * 500
    assert Q._coreset(*arguments, 1)[1] > 2 * compared


def test_coreset_takes_the_whole_pool_and_stops(vectors):
    df, _ = vectors
    got = Q.coreset_query(df.filter("id >= 110"), df.filter("id < 2"), 50)
    assert sorted(r.id for r in got.collect()) == list(range(110, 120))


def test_coreset_without_labelled_rows(vectors):
    df, points = vectors
    got = Q.coreset_query(df, df.limit(0), 3, normalize=False).orderBy("picked_rank").collect()
    assert [r.id for r in got] == greedy(points, [], 3, False)


def lloyd(points, centres, rounds):
    """Plain rounds: nearest centre, then means; ends when nothing moves."""
    at = None
    for number in range(rounds + 1):
        gaps = np.linalg.norm(points[:, None] - centres[None], axis=2)
        new = gaps.argmin(axis=1)
        if number == rounds or (at is not None and (new == at).all()):
            return new, centres
        at = new
        centres = np.array([points[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])


@pytest.mark.parametrize("k, rounds", [(1, 3), (7, 2), (12, 50)])
def test_kmeans_with_bounds_is_kmeans(spark, k, rounds):
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(12, 5)) * 6)[rng.integers(0, 12, 900)] + rng.normal(size=(900, 5))
    points[100:140] = points[100]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, point array<double>")
    start = K.start_centres(df, k, 4)
    assert len(start) == k and len({tuple(c) for c in start}) == k
    found = K.cluster(df, k, 4, rounds)
    at, centres = lloyd(points, start, rounds)
    got = {r.id: r.cluster for r in found.rows.collect()}
    assert [got[i] for i in range(900)] == at.tolist()
    assert np.allclose(found.centres, centres)
    if rounds == 50:
        # The first round compares all rows, the last hardly any.
        assert found.compared[0] == 900 and found.compared[-1] < 90 and sum(found.compared[1:]) < 450 * (len(found.compared) - 1)


def test_kmeans_of_few_points_and_none(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(10)], "id long, point array<double>")
    found = K.cluster(df, 5)
    assert len(found.centres) == 2 and len({(r.point[0], r.cluster) for r in found.rows.collect()}) == 2
    assert K.cluster(df.limit(0), 5).rows.count() == 0
    got = Q.kmeans_query(df.withColumnRenamed("point", "embedding"), 5, seed=3)
    assert got.count() == 5  # two nearest rows and three drawn at random


def test_kmeans_returns_n_distinct_rows(vectors):
    df, _ = vectors
    got = [r.id for r in Q.kmeans_query(df, 10, seed=3).select("id").collect()]
    assert len(got) == len(set(got)) == 10


def test_kmeans_fills_up_when_vectors_repeat(spark):
    df = spark.range(30).select("id", F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    got = [r.id for r in Q.kmeans_query(df, 8, seed=1).select("id").collect()]
    assert len(set(got)) == 8


def test_nearest_to_centre(spark):
    df = spark.createDataFrame(
        [(1, 0, [0.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.5, 0.0]), (4, 1, [5.0, 5.0]), (5, 1, [5.0, 5.0])],
        "id long, c int, embedding array<double>",
    )
    centres = Q.mean_vectors(df, "c", "embedding")
    got = Q.nearest_to_centre(df, centres, "c", "embedding").orderBy("c").collect()
    assert [(r.c, r.id) for r in got] == [(0, 3), (1, 4)]


def test_vector_helpers(spark):
    row = spark.range(1).select(
        Q.unit(F.array(F.lit(3.0), F.lit(4.0))), Q.unit(F.array(F.lit(0.0))), Q.dot(F.array(F.lit(2.0)), F.array(F.lit(5)))
    ).first()
    assert [list(row[0]), list(row[1]), row[2]] == [[0.6, 0.8], [0.0], 10.0]


def test_pool_joins(spark):
    pool = spark.range(20)
    labelled = spark.range(5)
    assert sorted(r.id for r in Q.unlabelled(pool, labelled).collect()) == list(range(5, 20))
    assert sorted(r.id for r in Q.rows_by_id(pool, labelled).collect()) == list(range(5))
    assert Q.extend(labelled, spark.range(5, 8)).count() == 8


def test_least_confident_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 0.1), (1, 0.1), (2, 0.0), (4, 9.0)], "id long, confidence double")
    assert sorted(r.id for r in Q.least_confident(df, 2).collect()) == [1, 2]


def test_unit_finds_the_length_of_a_vector_once(spark):
    df = spark.range(3).select(F.array(F.col("id").cast("float"), F.lit(4.0)).alias("v"))
    plan = df.select(Q.unit(F.col("v")))._jdf.queryExecution().analyzed().toString().split(" AS ")[0]
    assert "aggregate(" in plan and "aggregate(" not in plan[plan.index("coalesce(") :]
    odd = spark.sql("SELECT array(1D, NULL) AS v UNION ALL SELECT NULL UNION ALL SELECT array(CAST(3 AS DOUBLE), 4D)")
    assert {str(r[0]) for r in odd.select(Q.unit(F.col("v"))).collect()} == {"[0.0, 0.0]", "None", "[0.6, 0.8]"}


def test_kmeans_compares_a_slice_of_a_batch_at_a_time():
    points = np.arange(6_000.0).reshape(3_000, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(points.tolist())], names=["id", "point"])
    found = list(K._round(points[[10, 2_500]], None)([batch, batch.slice(0, 0)]))
    rows, totals = pa.Table.from_batches(found[:-1]), found[-1].column("total").to_pylist()
    assert max(len(part) for part in found) <= K.SLICE and rows.column("id").to_pylist() == list(range(3_000))
    at = np.linalg.norm(points[:, None] - points[[10, 2_500]], axis=2).argmin(axis=1)
    assert rows.column("cluster").to_pylist() == at.tolist()
    assert totals == [[*points[at == c].sum(axis=0), (at == c).sum()] for c in (0, 1)] + [[3_000, 3_000]]


def test_candidates_are_compared_when_they_come_to_the_top(spark, monkeypatch):
    """And not with every pick: that grew with picks times candidates."""
    points = np.random.default_rng(5).normal(size=(1_500, 6))
    points[700:720] = points[700]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    compared, plain = [], Q._distances
    monkeypatch.setattr(Q, "_distances", lambda rows, centres: compared.append(len(rows) * len(centres)) or plain(rows, centres))
    monkeypatch.setattr(Q, "_AHEAD", 16)
    picks, _ = Q._coreset(df.filter("id > 0"), df.filter("id = 0"), 400, "embedding", "id", False, 1_000, 4_096, 1)
    assert picks == greedy(points, [0], 400, False)
    assert sum(compared) < 0.5 * 400 * 1_000


def test_inner_products_leave_distances_as_they_are():
    draw = np.random.default_rng(2)
    rows = np.vstack([draw.normal(size=(1_100, 7)), 1e4 * draw.normal(size=(20, 7)), np.ones((30, 7))])
    near = rows[::3] + 1e-8 * draw.normal(size=rows[::3].shape)
    centres = np.vstack([near, rows[:9], np.ones((40, 7)), draw.normal(size=(900, 7))])
    want = np.round(np.sqrt([((row - centres) ** 2).sum(axis=1).min() for row in rows]), 9)
    assert (Q._distances(rows, centres) == want).all()
    assert (Q._distances(rows[:1], centres) == want[:1]).all() and np.isinf(Q._distances(rows[:2], centres[:0])).all()
