"""k-means with a seeded oversampled start and distance bounds per row.

Vectors lie in a table bucketed by id. Beside it lies a small table, bucketed alike, with every row's cluster, an upper bound of the
distance to its centre and a lower bound of the distance to any other. A round moves the bounds by as much as the centres have
moved; by the triangle inequality a row whose upper bound stays below its lower one, or below half the way from its centre to the next
centre, keeps its cluster without a comparison. A round reads both tables where they lie, and writes the small one along with
the sums per task and cluster. Centres are `k` vectors, on the driver and in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ordering import random_key
from tagloom.session import bucketed, buckets_for

START_ROUNDS = 3
OVERSAMPLING = 2  # candidates per round and cluster
SLACK = 1e-9  # bounds closer than this decide nothing
SLICE = 1_024  # rows a task compares at once, whatever the size of the batches it is handed


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows by centres. Differences come first, so near copies keep their digits; one centre at a time bounds the memory."""
    out = np.empty((len(rows), len(centres)))
    for j, centre in enumerate(centres):
        out[:, j] = np.sqrt(((rows - centre) ** 2).sum(axis=1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def draw(id_col: str, seed) -> Column:
    """A number in (0, 1] that follows from id and seed."""
    digits = F.conv(F.substring(random_key(id_col, seed), 1, 13), 16, 10).cast("double")
    return (digits + 1) / float(1 << 52)


# --- start -------------------------------------------------------------------------------------------


def _nearest_of(centres: np.ndarray):
    @F.pandas_udf("struct<at int, gap double>")
    def nearest(points):
        import pandas as pd

        if len(points) == 0:
            return pd.DataFrame({"at": pd.Series([], dtype="int32"), "gap": pd.Series([], dtype="float64")})
        at, gap = np.empty(len(points), "int32"), np.empty(len(points))
        for first in range(0, len(points), SLICE):
            found = distances(np.stack(points.iloc[first : first + SLICE].to_numpy()), centres)
            at[first : first + SLICE] = found.argmin(axis=1)
            gap[first : first + SLICE] = found.min(axis=1)
        return pd.DataFrame({"at": at, "gap": gap})

    # A filter on what it returns must not be pushed below it and make it run twice, in two Python processes.
    return nearest.asNondeterministic()


def spread_out(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Places of `k` candidates: the heaviest, then each time the one with the most weight times squared distance to those
    taken. Fewer if the rest coincides with them. Ties go to the first."""
    taken = [int(np.argmax(weights))]
    gap = ((points - points[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < k:
        gain = np.round(weights * gap, 9)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        taken.append(best)
        gap = np.minimum(gap, ((points - points[best]) ** 2).sum(axis=1))
    return np.array(taken)


def start_centres(vectors: DataFrame, k: int, seed) -> np.ndarray:
    """Centres to start from, for `<id, point>`: the row that comes first by hash, then in each round `OVERSAMPLING * k` rows,
    drawn without replacement by their squared distance to all before; every row counts for its nearest candidate, and the
    weighted candidates are thinned out to `k`."""
    first = vectors.orderBy(random_key("id", seed), "id").limit(1)
    rows = first.select("id", "point").collect()
    if not rows:
        return np.zeros((0, 0))
    for number in range(START_ROUNDS):
        nearest = _nearest_of(np.array([r["point"] for r in rows]))
        gap = vectors.select("id", "point", nearest("point")["gap"].alias("gap")).filter(f"gap > {SLACK}")
        # Of the keys log(u) / weight the largest make a weighted sample without replacement.
        order = F.log(draw("id", f"{seed}:{number}")) / (F.col("gap") * F.col("gap"))
        more = gap.orderBy(F.desc(order), "id").limit(OVERSAMPLING * k).select("id", "point").collect()
        if not more:
            break
        rows += more
    rows.sort(key=lambda r: r["id"])
    points = np.array([r["point"] for r in rows])
    counted = vectors.select(_nearest_of(points)("point")["at"].alias("at")).groupBy("at").count().collect()  # a row per candidate
    weights = np.zeros(len(rows))
    for r in counted:
        weights[r["at"]] = r["count"]
    return points[spread_out(points, weights, k)]


# --- rounds ------------------------------------------------------------------------------------------


_NAMES = ["id", "cluster", "upper", "lower", "compared", "moved", "total"]


@dataclass
class Clusters:
    """`rows` is `<id, point, cluster>`, `centres` the means."""

    rows: DataFrame
    centres: np.ndarray
    compared: list[int]  # rows per round that were compared with all centres


def _round(centres: np.ndarray, shifts: np.ndarray | None):
    """Function of batches `<id, point, cluster, upper, lower>`: new bounds, then a row per cluster with its sum and size."""
    k = len(centres)
    apart = distances(centres, centres)
    np.fill_diagonal(apart, np.inf)
    half = apart.min(axis=1) / 2
    if shifts is not None and k > 1:
        largest = np.argsort(shifts)[::-1][:2]
        # Other centres have come nearer by the largest shift among them at most.
        others = np.where(np.arange(k) == largest[0], shifts[largest[1]], shifts[largest[0]])
    elif shifts is not None:
        others = np.zeros(k)

    def run(batches):
        # Per cluster its sum and size; in one more row, how many rows moved and were compared.
        sums, counts = np.zeros((k + 1, centres.shape[1] + 1)), np.zeros(2, np.int64)
        kind = None
        for batch in (batch.slice(at, SLICE) for batch in batches for at in range(0, len(batch), SLICE)):
            kind = batch.schema.field("id").type
            points = _matrix(batch.column("point"))
            if shifts is None:
                old = np.full(len(points), -1)
                cluster, upper, lower = old.copy(), np.zeros(len(points)), np.zeros(len(points))
                open_rows = np.arange(len(points))
            else:
                old = batch.column("cluster").to_numpy()
                cluster = old.copy()
                upper = batch.column("upper").to_numpy() + shifts[old]
                lower = batch.column("lower").to_numpy() - others[old]
                bound = np.maximum(lower, half[old])
                open_rows = np.flatnonzero(upper + SLACK >= bound)
                # The true distance to the own centre may settle it.
                upper[open_rows] = np.sqrt(((points[open_rows] - centres[old[open_rows]]) ** 2).sum(axis=1))
                open_rows = open_rows[upper[open_rows] + SLACK >= bound[open_rows]]
            if len(open_rows):
                found = distances(points[open_rows], centres)
                best = found.argmin(axis=1)
                cluster[open_rows] = best
                upper[open_rows] = found[np.arange(len(best)), best]
                found[np.arange(len(best)), best] = np.inf
                lower[open_rows] = found.min(axis=1)
            compared = np.zeros(len(points), bool)
            compared[open_rows] = True
            np.add.at(sums[:, :-1], cluster, points)
            sums[:k, -1] += np.bincount(cluster, minlength=k)
            counts += [np.count_nonzero(cluster != old), len(open_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(cluster.astype(np.int32)),
                    pa.array(upper),
                    pa.array(lower),
                    pa.array(compared),
                    pa.array(cluster != old),
                    pa.nulls(len(points), pa.list_(pa.float64())),
                ],
                names=_NAMES,
            )
        if kind is not None:
            used = np.append(np.flatnonzero(sums[:, -1]), k)
            none = [pa.nulls(len(used), t) for t in (kind, pa.float64(), pa.float64(), pa.bool_(), pa.bool_())]
            total = pa.array([*sums[used[:-1]], counts.astype(float)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([none[0], pa.array(used.astype(np.int32)), *none[1:], total], names=_NAMES)

    return run


def cluster(vectors: DataFrame, k: int, seed=0, max_iter: int = 20) -> Clusters:
    """Clusters of `<id, point>` in at most `k` groups; ids are unique and not null, points have one length.

    Rounds end when no row moves, after `max_iter` at most; rows then belong to the nearest of the last means. A row as near to two
    centres belongs to the first. A centre that loses all rows stays where it is.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    n = buckets_for(vectors)
    vectors = bucketed(vectors.select("id", "point").repartition(n, "id"), "points", n, "id")
    centres = start_centres(vectors, k, seed)
    schema = f"id {kind}, cluster int, upper double, lower double, compared boolean, moved boolean, total array<double>"
    state, shifts, seen = None, None, []
    if len(centres) == 0:
        return Clusters(vectors.withColumn("cluster", F.lit(None).cast("int")), centres, seen)
    for number in range(max_iter + 1):
        given = vectors if state is None else vectors.join(state.select("id", "cluster", "upper", "lower"), "id")
        written = bucketed(given.mapInArrow(_round(centres, shifts), schema), "bounds", n, "id")
        state = written.filter("id IS NOT NULL")
        # A row per task and cluster, added up by place.
        places = written.filter("id IS NULL").select("cluster", F.posexplode("total").alias("at", "x"))
        totals = places.groupBy("cluster", "at").agg(F.sum("x").alias("x"))
        ordered = F.array_sort(F.collect_list(F.struct("at", "x")))["x"]
        sums = {r["cluster"]: r["total"] for r in totals.groupBy("cluster").agg(ordered.alias("total")).collect()}
        moved, compared = sums.pop(len(centres), (0, 0))
        seen.append(int(compared))
        if number == max_iter or not moved:
            break
        new = centres.copy()
        for c, total in sums.items():
            new[c] = np.array(total[:-1]) / total[-1]
        shifts = np.sqrt(((new - centres) ** 2).sum(axis=1))
        centres = new
    return Clusters(vectors.join(state.select("id", "cluster"), "id"), centres, seen)
