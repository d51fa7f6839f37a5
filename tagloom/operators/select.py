"""Which rows to label next, and the joins around that choice."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.kmeans import cluster, distances
from tagloom.operators.ordering import random_key, take_first
from tagloom.session import materialize, new_path


def rows_by_id(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def unlabelled(pool: DataFrame, labelled: DataFrame, id_col: str = "id") -> DataFrame:
    """The pool without the rows that are labelled already."""
    return pool.join(labelled.select(id_col), id_col, "left_anti")


def reveal(picked: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    """True labels of the picked rows: the simulated annotator."""
    return picked.join(truth, id_col)


def extend(labelled: DataFrame, picked: DataFrame) -> DataFrame:
    """Newly picked rows together with those labelled before."""
    return picked.unionByName(labelled)


def random_query(pool: DataFrame, n: int, seed=0, id_col: str = "id") -> DataFrame:
    """`n` rows in md5 order."""
    return take_first(pool, id_col, seed, n)


def least_confident(scored: DataFrame, n: int, confidence: str = "confidence", id_col: str = "id") -> DataFrame:
    """The `n` rows with the lowest confidence; a top-n per task, then one merge of ids only."""
    return scored.orderBy(confidence, id_col).limit(n)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def unit(vector: Column) -> Column:
    """The vector scaled to length 1, in double precision; a zero vector stays zero."""
    # The norm is handed over as an array: inside the function it would be computed anew for every place.
    norms = F.array_repeat(F.sqrt(dot(vector, vector)), F.size(vector))
    return F.zip_with(vector, norms, lambda x, norm: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def mean_vectors(df: DataFrame, by: str, vector_col: str) -> DataFrame:
    """`<by, centre>`: the mean vector of each group. Averages are combined before the shuffle."""
    places = df.select(by, F.posexplode(vector_col).alias("at", "value"))
    means = places.groupBy(by, "at").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return means.groupBy(by).agg(ordered.alias("pairs")).select(by, F.col("pairs.value").alias("centre"))


def nearest_to_centre(
    df: DataFrame, centres: DataFrame, cluster_col: str, vector_col: str, id_col: str = "id"
) -> DataFrame:
    """`<cluster, id, distance>` of the row nearest its own centre; ties go to the smaller id.

    An aggregate, not a window: each task keeps one row per cluster, however large a cluster is.
    """
    joined = df.select(id_col, cluster_col, vector_col).join(centres, cluster_col)
    distance = F.sqrt(squared_distance(F.col(vector_col), F.col("centre")))
    best = F.min(F.struct(distance.alias("distance"), F.col(id_col).alias(id_col)))
    return joined.groupBy(cluster_col).agg(best.alias("best")).select(cluster_col, f"best.{id_col}", "best.distance")


def kmeans_query(
    pool: DataFrame, n: int, seed=0, vector_col="embedding", id_col="id", normalize=True, max_iter=20
) -> DataFrame:
    """One row per cluster of `n` clusters: the one nearest the centre; ties go to the smaller id.

    If the pool has fewer than `n` distinct vectors, some clusters are empty; the missing rows are
    then drawn at random from the rest, so the result has `n` rows as long as the pool does.
    """
    vector = F.col(vector_col)
    vector = unit(vector) if normalize else vector.cast("array<double>")
    found = cluster(pool.select(F.col(id_col).alias("id"), vector.alias("point")), n, seed, max_iter)
    centres = [(i, [float(x) for x in centre]) for i, centre in enumerate(found.centres)]
    centres = pool.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")
    picks = nearest_to_centre(found.rows, F.broadcast(centres), "cluster", "point").select("id")  # n rows
    # At most n ids: fixed on the driver so that the pick is made once.
    ids = [row[0] for row in picks.collect()]
    if len(ids) < n:
        rest = take_first(pool.filter(~F.col(id_col).isin(ids)), id_col, seed, n - len(ids))
        ids += [row[0] for row in rest.select(id_col).collect()]
    return pool.filter(F.col(id_col).isin(ids)) if ids else pool.limit(0)


# --- coverage ----------------------------------------------------------------------------------------

REFRESH = 0.9  # cells that may reach so much of the farthest distance are brought up to date together
ROWS_PER_CELL = 4_096
MOST_CELLS = 1_024
_ROOM = 1e-6  # for rounding in what decides whether a cell is left alone
_SLICE = 1_024  # rows and centres whose inner products are held at once
_AHEAD = 256  # candidates brought up to date at once
_PRODUCTS = 1e-11  # more than rounding in inner products can make up, as a share of squared lengths


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row to the nearest centre; differences come first, so near copies keep their digits."""
    best = np.full(len(rows), np.inf)
    for at in range(0, len(rows), _SLICE):
        for first in range(0, len(centres), _SLICE):
            part = slice(at, at + _SLICE)
            best[part] = np.minimum(best[part], _squares(rows[part], centres[first : first + _SLICE]))
    return np.round(np.sqrt(best), 9)


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Least squared distance of each row. Inner products tell which centres may be the nearest; differences are taken for those."""
    if len(rows) == 1 or len(centres) == 1:
        gaps = ((rows - centres) ** 2).sum(axis=1)
        return gaps if len(centres) == 1 else gaps.min(keepdims=True)
    lengths, others = (rows**2).sum(axis=1), (centres**2).sum(axis=1)
    about = rows @ (-2 * centres.T)
    about += (1 - _PRODUCTS) * others
    near = about.argmin(axis=1)
    best = ((rows - centres[near]) ** 2).sum(axis=1)
    # What rounding does not leave clearly farther is compared, and all of it where lengths overflow.
    limit = about[np.arange(len(rows)), near] + 2 * _PRODUCTS * (lengths + others[near])
    row, centre = np.nonzero(~(about > limit[:, None]))
    more = centre != near[row]
    row, centre = row[more], centre[more]
    for at in range(0, len(row), _SLICE):
        i, j = row[at : at + _SLICE], centre[at : at + _SLICE]
        np.minimum.at(best, i, ((rows[i] - centres[j]) ** 2).sum(axis=1))
    return best


class _Cells:
    """The pool cut by pivots. Of a cell the driver knows the pivot, the radius, an upper bound of its rows' distances and how
    many picks they have been compared with; its rows lie in a folder of their own, in the version written last."""

    def __init__(self, points: DataFrame, id_col: str, pivots: np.ndarray, first: np.ndarray):
        self.spark, self.id_col, self.pivots = points.sparkSession, id_col, pivots
        self.compared = 0
        n = len(pivots)
        self.folder: list[str | None] = [None] * n
        self.radius, self.top, self.seen = np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
        self.size = np.zeros(n, np.int64)

        @F.pandas_udf("struct<cell int, gap double, far double>")
        def place(vectors: pd.Series) -> pd.DataFrame:
            if len(vectors) == 0:
                return pd.DataFrame({"cell": [], "gap": [], "far": []}).astype({"cell": "int32"})
            rows = np.stack(vectors.to_numpy()).astype("float64")
            gaps = distances(rows, pivots)
            at = gaps.argmin(axis=1)
            return pd.DataFrame({"cell": at.astype("int32"), "gap": gaps[np.arange(len(at)), at], "far": _distances(rows, first)})

        placed = points.select(id_col, "_point", place("_point").alias("_at")).select(
            id_col, "_point", F.col("_at.cell").alias("_cell"), F.col("_at.gap").alias("_gap"), F.col("_at.far").alias("_distance")
        )
        self.schema = placed.schema
        # Large cells are split into several files.
        self._write(placed.hint("rebalance", "_cell"))

    def _write(self, rows: DataFrame) -> None:
        path = new_path(self.spark, "cells")
        rows.withColumn("cell", F.col("_cell")).write.partitionBy("cell").parquet(path)
        stored = self.spark.read.schema(self.schema).parquet(path)
        stats = stored.groupBy("_cell").agg(F.max("_gap").alias("radius"), F.max("_distance").alias("top"), F.count("*").alias("n"))
        for row in stats.collect():  # one row per cell
            c = row["_cell"]
            self.folder[c], self.radius[c], self.top[c], self.size[c] = f"{path}/cell={c}", row["radius"], row["top"], row["n"]

    def rows(self, cells) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.folder[c] for c in cells])

    def pending(self, picks: np.ndarray) -> np.ndarray:
        """Cells by picks: which picks can still lessen a distance in the cell. A pick farther from the pivot than the radius and
        the cell's largest distance together can't."""
        if not len(picks):
            return np.zeros((len(self.pivots), 0), bool)
        away = distances(self.pivots, picks)
        new = np.arange(len(picks)) >= self.seen[:, None]
        return new & (away - self.radius[:, None] < self.top[:, None] + _ROOM)

    def refresh(self, cells, picks: np.ndarray, mask: np.ndarray) -> None:
        """Compare the cells' rows with the picks that `mask` names for them."""
        if len(cells) == 0:
            return
        names = self.schema.names

        def run(batches):
            for batch in batches:
                cell = batch.column("_cell").to_numpy()
                far = batch.column("_distance").to_numpy().copy()
                points = batch.column("_point")
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    taken = points.take(pa.array(at))
                    rows = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    far[at] = np.minimum(far[at], _distances(rows, picks[mask[c]]))
                columns = [pa.array(far) if name == "_distance" else batch.column(name) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        self.compared += int((self.size[cells] * mask[cells].sum(axis=1)).sum())
        self._write(self.rows(cells).mapInArrow(run, self.schema))
        self.seen[cells] = len(picks)


def coreset_query(
    pool: DataFrame,
    labelled: DataFrame,
    n: int,
    vector_col: str = "embedding",
    id_col: str = "id",
    normalize: bool = True,
    candidates: int | None = None,
    block: int = 4_096,
    cells: int | None = None,
) -> DataFrame:
    """`<id, picked_rank>`: greedy k-centre, `n` times the row farthest from all labelled or picked; ties go to the smaller id.

    Exact, but with few passes and comparisons. The pool is cut into cells around pivots, and distances only ever shrink:

    * a pass takes the `candidates` farthest rows; while one of them is still at least as far as the last of the list, no
      row outside can beat it, so it is picked without looking at the pool again;
    * a cell out of reach of a pick is not compared with it, by the triangle inequality;
    * a cell whose largest distance lies well below the current candidate is left as it is until its turn comes.

    Labelled rows are taken in blocks of `block` vectors. NULL vectors are an error.
    """
    picks, _ = _coreset(pool, labelled, n, vector_col, id_col, normalize, candidates, block, cells)
    kind = T.StructType([pool.schema[id_col], T.StructField("picked_rank", T.IntegerType(), False)])
    return pool.sparkSession.createDataFrame([(i, rank) for rank, i in enumerate(picks)], kind)


def _coreset(pool, labelled, n, vector_col, id_col, normalize, candidates, block, cells) -> tuple[list, int]:
    """(picks in order, comparisons of rows with picks)"""
    spark = pool.sparkSession
    vector = F.col(vector_col)
    vector = unit(vector) if normalize else vector.cast("array<double>")
    points = materialize(pool.select(id_col, vector.alias("_point")), "points")
    known = materialize(labelled.select(vector.alias("_point"), F.xxhash64(id_col).alias("_key")), "labelled-points")
    missing = [F.count_if(F.col("_point").isNull()), F.count("*")]
    (bad, total), (bad_known, total_known) = points.agg(*missing).first(), known.agg(*missing).first()
    if bad + bad_known:
        raise ValueError(f"{bad + bad_known} rows without a vector in {vector_col}")
    if not total or n <= 0:
        return [], 0
    cells = cells or max(1, min(MOST_CELLS, total // ROWS_PER_CELL))
    order = random_key(id_col, "pivots")
    pivots = np.array([r[0] for r in points.orderBy(order, id_col).limit(cells).select("_point").collect()], dtype="float64")

    blocks = max(1, -(-total_known // block))
    held = _Cells(points, id_col, pivots, _block(known, 0, blocks))
    used = np.flatnonzero([f is not None for f in held.folder])  # copies of a pivot leave cells without rows
    for at in range(1, blocks):
        centres = _block(known, at, blocks)
        if len(centres):
            held.seen[:] = 0
            mask = held.pending(centres)
            held.refresh(used[mask[used].any(axis=1)], centres, mask)
    held.seen[:] = 0

    size = candidates or max(256, 2 * n)
    picked: list = []
    chosen = np.zeros((min(n, total), pivots.shape[1]))
    while len(picked) < min(n, total):
        mask = held.pending(chosen[: len(picked)])
        stale = used[mask[used].any(axis=1)]
        due = stale[held.top[stale] >= REFRESH * held.top[used].max()]
        held.refresh(due, chosen[: len(picked)], mask)
        left = np.setdiff1d(stale, due)
        rest_top = held.top[left].max() if len(left) else -np.inf  # what no listed row may fall to
        fresh = np.setdiff1d(used, left)
        fresh = fresh[held.top[fresh] > rest_top]
        if not len(fresh):
            continue
        # Ids and distances first: vectors are fetched only for the rows of the list.
        rows = held.rows(fresh).filter(F.col("_distance") > float(rest_top)) if len(left) else held.rows(fresh)
        rows = rows.filter(~F.col(id_col).isin(picked)) if picked else rows
        listed = rows.select(id_col, "_distance", "_cell").orderBy(F.desc("_distance"), id_col).limit(size).collect()
        if not listed:
            if len(left):
                continue
            break
        whole = len(listed) < size
        ids = spark.createDataFrame([(row[0],) for row in listed], T.StructType([held.schema[id_col]]))
        near = sorted({row[2] for row in listed})
        found = held.rows(near).select(id_col, "_point").join(F.broadcast(ids), id_col, "left_semi").collect()
        found = {row[0]: row[1] for row in found}
        vectors = np.array([found[row[0]] for row in listed], dtype="float64")
        far = np.array([row[1] for row in listed])
        # Positions in the list are in (distance desc, id asc) order, so they also break ties.
        by_id = {i: at for at, i in enumerate(sorted(row[0] for row in listed))}
        id_rank = np.array([by_id[row[0]] for row in listed])
        bound, bound_rank = far[-1], id_rank[-1]
        # Distances only shrink: the farthest row is brought up to date, against what was picked since, until it is on top as it is.
        fresh_to = np.full(len(listed), len(picked))
        while len(picked) < min(n, total):
            top = _farthest(far, id_rank)
            if far[top] < 0:
                break  # all are picked
            if fresh_to[top] < len(picked):
                # Rows that are next and as old are brought up to date along with it.
                ahead = np.argpartition(-far, _AHEAD)[:_AHEAD] if len(far) > _AHEAD else np.flatnonzero(far >= 0)
                old = np.union1d(ahead[(fresh_to[ahead] == fresh_to[top]) & (far[ahead] >= 0)], [top])
                since = chosen[fresh_to[top] : len(picked)]
                far[old] = np.minimum(far[old], _distances(vectors[old], since))
                fresh_to[old] = len(picked)
                continue
            safe = whole or far[top] > bound or (far[top] == bound and id_rank[top] <= bound_rank)
            if not (safe and far[top] > rest_top):
                break
            chosen[len(picked)] = vectors[top]
            picked.append(listed[top][0])
            far[top] = -1.0
    return picked, held.compared


def _farthest(far: np.ndarray, id_rank: np.ndarray) -> int:
    """Place of the largest distance, of equals that with the smallest id."""
    ties = np.flatnonzero(far == far.max())
    return int(ties[id_rank[ties].argmin()])


def _block(known: DataFrame, at: int, blocks: int) -> np.ndarray:
    """One of about equal parts of the labelled vectors."""
    rows = known.filter(F.pmod("_key", F.lit(blocks)) == at).select("_point").collect()
    return np.array([row[0] for row in rows], dtype="float64")
