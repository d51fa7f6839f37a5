"""Linear SVM with squared hinge loss: Newton steps with conjugate gradients over stored sparse vectors.

Minimizes `|w|^2 / 2 + cost * sum(max(0, 1 - y * (w, x))^2)` over rows with labels -1 and 1. The bias is the weight of a term that
every row has, so it is kept small like the others. The minimum is unique, whatever the order and the blocks of the rows.

Training rows that fit one block need no exchange, so all steps run in that block's task. More rows lie in blocks of bounded size,
packed once as arrays and kept by the executors; a pass multiplies each block with a vector, and the driver gets the sums and makes
the steps. A term that only one row has needs no number of its own: all such terms of a row act as one, so the vectors
have a number per term of several rows and one per row. Only if these are more than HELD do the vectors lie in a stored table:
there sums are exchanged as one number per block and term, and no task and no driver holds a weight for every term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.joins import lookup_join
from tagloom.session import bucketed, materialize

BIAS = -1
NUMBERS_PER_BLOCK = 1 << 23  # values in the vectors of a block: at 24 bytes each in a task, and twice that while they are read
NUMBERS_PER_PART = 1 << 20  # values in the vectors of a block whose sums go to the driver
HELD = 1 << 23  # numbers in a vector on the driver, which has eight of them: 64 MB each
SHUFFLED = 1 << 29  # bytes of shuffle files that passes may leave behind
CHUNK = 1 << 16  # numbers of a vector that are summed up in one go
STEPS = [0.5**k for k in range(12)]
WEIGHTS = "term int, weight double, n bigint"


# --- one block ---------------------------------------------------------------------------------------


class Block:
    """Rows as three flat arrays, terms numbered within the block."""

    def __init__(self, labels, lengths, indices, values):
        n = len(lengths)
        self.y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
        self.row = np.concatenate([np.repeat(np.arange(n), lengths), np.arange(n)])
        self.value = np.concatenate([values, np.ones(n)])
        self.terms, self.at = np.unique(np.concatenate([indices, np.full(n, BIAS, np.int32)]), return_inverse=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.at], len(self.y))

    def gathered(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * by_row[self.row], len(self.terms))

    def short(self, w: np.ndarray) -> np.ndarray:
        """How far rows stay below a margin of one."""
        return np.maximum(0, 1 - self.y * self.times(w))

    def slope(self, w) -> tuple[np.ndarray, float]:
        short = self.short(w)
        return -2 * self.gathered(self.y * short), float(short @ short)

    def curving(self, w):
        """Function of a direction. Only rows below the margin count, so only their values are gone through."""
        kept = (self.short(w) > 0)[self.row]
        row, at, value = self.row[kept], self.at[kept], self.value[kept]

        def curve(d: np.ndarray) -> np.ndarray:
            by_row = np.bincount(row, value * d[at], len(self.y))
            return 2 * np.bincount(at, value * by_row[row], len(self.terms))

        return curve

    def losses(self, w, p) -> list[float]:
        z, zp = self.y * self.times(w), self.y * self.times(p)
        return [float((np.maximum(0, 1 - z - t * zp) ** 2).sum()) for t in STEPS]


# --- Newton steps, over vectors that are held here or in a table -----------------------------------------


def minimize(space, cost: float, tol: float, most: int = 100) -> None:
    """Move `space` to the minimum: until the slope is `tol` of what it was at zero."""
    first = None
    for _ in range(most):
        loss, ww, gg = space.slope()
        first = gg if first is None else first
        if gg <= tol * tol * first or gg == 0:
            return
        rr, goal = gg, 0.01 * gg  # a closer solution is lost as soon as other rows fall short
        for _ in range(most):
            dhd, rhd, hdhd = space.curve()
            alpha = rr / dhd
            left = max(0.0, rr - 2 * alpha * rhd + alpha * alpha * hdhd)
            space.advance(alpha, left / rr)
            rr = left
            if rr <= goal or rr <= 1e-4 * tol * tol * first:
                break
        losses, wp, pp, gp = space.line()
        now = ww / 2 + cost * loss
        for t, loss_t in zip(STEPS, losses, strict=True):
            if ww / 2 + t * wp + t * t * pp / 2 + cost * loss_t <= now + 1e-4 * t * gp + 1e-12 * abs(now):
                break
        space.move(t)


class Held:
    """Vectors of one block as arrays."""

    def __init__(self, block: Block, cost: float):
        self.block, self.cost = block, cost
        self.w = np.zeros(len(block.terms))

    def slope(self):
        s, loss = self.block.slope(self.w)
        self.along = self.block.curving(self.w)
        self.g = self.w + self.cost * s
        self.p, self.r = np.zeros_like(self.w), -self.g
        self.d = self.r
        return loss, self.w @ self.w, self.g @ self.g

    def curve(self):
        self.h = self.d + self.cost * self.along(self.d)
        return self.d @ self.h, self.r @ self.h, self.h @ self.h

    def advance(self, alpha, beta):
        self.p = self.p + alpha * self.d
        self.r = self.r - alpha * self.h
        self.d = self.r + beta * self.d

    def line(self):
        return self.block.losses(self.w, self.p), self.w @ self.p, self.p @ self.p, self.g @ self.p

    def move(self, t):
        self.w = self.w + t * self.p


_NUMBERS = ["w", "g", "p", "r", "d", "h"]
_STATE = "block int, term int, n bigint, share double, " + ", ".join(f"{x} double" for x in _NUMBERS) + ", s double"


def _arrow_state(block, terms, n, share, numbers, s) -> pa.Table:
    arrays = [pa.array(np.full(len(terms), block, np.int32)), pa.array(terms.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(share)]
    arrays += [pa.array(numbers[x]) for x in _NUMBERS] + [pa.array(s)]
    return pa.table(arrays, names=["block", "term", "n", "share", *_NUMBERS, "s"])


def _read_block(table: pa.Table) -> Block:
    lists = [pa.concat_arrays(table.column(c).chunks) if len(table) else pa.array([], pa.list_(t)) for c, t in (("indices", pa.int32()), ("values", pa.float64()))]
    lengths, found = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), [x.flatten() for x in lists]
    return Block(table.column("label").to_numpy(), lengths, *(x.to_numpy(zero_copy_only=False) for x in found))


def _opened(table: pa.Table) -> pa.Table:
    block = _read_block(table)
    n = np.bincount(block.at, minlength=len(block.terms))
    zero = np.zeros(len(block.terms))
    return _arrow_state(table.column("block")[0].as_py(), block.terms, n, zero, dict.fromkeys(_NUMBERS, zero), zero)


def _pass(kind: str):
    """Function of a block's rows and state: the state with the block's part of the sums, and its losses below BIAS."""

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        block, number = _read_block(rows), rows.column("block")[0].as_py()
        order = np.argsort(state.column("term").to_numpy())
        n, share = state.column("n").to_numpy()[order], state.column("share").to_numpy()[order]
        v = {x: state.column(x).to_numpy()[order] for x in _NUMBERS}
        s, losses = np.zeros(len(order)), []
        if kind == "slope":
            s, loss = block.slope(v["w"])
            losses = [loss]
        elif kind == "curve":
            s = block.curving(v["w"])(v["d"])
        else:
            losses = block.losses(v["w"], v["p"])
        extra = np.zeros(len(losses))
        return _arrow_state(
            number,
            np.concatenate([block.terms, BIAS - 1 - np.arange(len(losses))]),
            np.concatenate([n, extra]),
            np.concatenate([share, extra]),
            {x: np.concatenate([v[x], extra]) for x in _NUMBERS},
            np.concatenate([s, losses]),
        )

    return run


class Spread:
    """Vectors as a stored table `<block, term, ..>`, rewritten per pass; each pass reads the rows once, where they lie."""

    def __init__(self, rows: DataFrame, cost: float):
        self.rows, self.cost = rows, cost

    @cached_property
    def state(self) -> DataFrame:
        opened = self.rows.groupBy("block").applyInArrow(_opened, _STATE)
        by_term = Window.partitionBy("term")
        share = 1 / F.count("*").over(by_term)  # numbers of a term count once, however many blocks have it
        return materialize(opened.withColumns({"share": share, "n": F.sum("n").over(by_term)}), "svm-state")

    def _run(self, kind: str, to: str | None, value: Column | None, *sums: tuple[str, str]) -> tuple[list, list[float]]:
        """One pass; `to` becomes `value`, in which `s` is the sum over all blocks. Returns inner products and losses."""
        sent = self.rows.groupBy("block").cogroup(self.state.groupBy("block")).applyInArrow(_pass(kind), _STATE)
        total = sent.withColumn("s", F.sum("s").over(Window.partitionBy("term")))
        if to is not None:
            total = total.withColumn(to, F.when(F.col("term") >= BIAS, value).otherwise(0.0))
        stored = materialize(total, "svm-state")
        products = [F.sum(F.col("share") * F.col(a) * F.col(b)) for a, b in sums]
        n_losses = {"slope": 1, "curve": 0, "line": len(STEPS)}[kind]
        losses = [F.max(F.when(F.col("term") == BIAS - 1 - k, F.col("s"))) for k in range(n_losses)]
        found = list(stored.agg(*[x.alias(f"x{i}") for i, x in enumerate([*products, *losses])]).first())
        self.state = stored.filter(F.col("term") >= BIAS)
        return found[: len(sums)], found[len(sums) :]

    def _set(self, **columns: Column) -> None:
        self.state = self.state.withColumns(columns)

    def slope(self):
        (ww, gg), (loss,) = self._run("slope", "g", F.col("w") + self.cost * F.col("s"), ("w", "w"), ("g", "g"))
        self._set(p=F.lit(0.0), r=-F.col("g"), d=-F.col("g"))
        return loss, ww, gg

    def curve(self):
        return self._run("curve", "h", F.col("d") + self.cost * F.col("s"), ("d", "h"), ("r", "h"), ("h", "h"))[0]

    def advance(self, alpha, beta):
        r = F.col("r") - alpha * F.col("h")
        self._set(p=F.col("p") + alpha * F.col("d"), r=r, d=r + beta * F.col("d"))

    def line(self):
        products, losses = self._run("line", None, None, ("w", "p"), ("p", "p"), ("g", "p"))
        return losses, *products

    def move(self, t):
        self._set(w=F.col("w") + t * F.col("p"))

    def weights(self) -> DataFrame:
        return self.state.groupBy("term").agg(F.max("w").alias("weight"), F.max("n").alias("n"))


# --- blocks whose sums go to the driver ------------------------------------------------------------------

_PACKED = "rows int, y binary, lengths binary, places binary, at binary, value binary, alone binary, term binary, of_row binary, term_value binary"
_KINDS = {"y": np.float64, "lengths": np.int32, "places": np.int32, "at": np.int32, "value": np.float64, "alone": np.float64, "term": np.int32, "of_row": np.int32, "term_value": np.float64}


def _pack(shared):
    """Function of rows that makes blocks of them. `places` are those of a block's terms in the broadcast list `shared`; the terms that
    only one row has are left out of its values, whose length is `alone`."""

    def packed(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        lists = [pa.concat_arrays(table.column(c).chunks) for c in ("indices", "values")]
        lengths = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        indices, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        n, row = len(lengths), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        terms, at = np.unique(indices, return_inverse=True)
        known = shared.value
        places = np.searchsorted(known, terms)
        several = known[np.minimum(places, len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
        kept = several[at]
        number = (np.cumsum(several) - 1).astype(np.int32)  # of the terms that stay
        found = {
            "y": np.where(np.asarray(table.column("label").to_numpy()) > 0, 1.0, -1.0),
            "lengths": np.bincount(row[kept], minlength=n),
            "places": places[several],
            "at": number[at[kept]],
            "value": value[kept],
            "alone": np.sqrt(np.bincount(row[~kept], value[~kept] ** 2, n)),
            "term": indices[~kept],
            "of_row": row[~kept],
            "term_value": value[~kept],
        }
        arrays = [pa.array([n], pa.int32())] + [pa.array([found[name].astype(kind).tobytes()], pa.binary()) for name, kind in _KINDS.items()]
        return pa.RecordBatch.from_arrays(arrays, names=["rows", *_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows, size = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + 1)
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + NUMBERS_PER_PART - size, side="right")))
                open_rows.append(pa.Table.from_batches([batch.slice(start, stop - start)]))
                size += int(ends[stop - 1] - before)
                start = stop
                if size >= NUMBERS_PER_PART or start < len(ends):
                    yield packed(open_rows)
                    open_rows, size = [], 0
        if open_rows:
            yield packed(open_rows)

    return run


class Part:
    """A packed block, to be multiplied with vectors that have a number per shared term, then the bias, then one per row."""

    def __init__(self, found: tuple, shared: int, first: dict):
        self.block, self.n, *arrays = found
        self.y, lengths, self.places, self.at, self.value, self.alone = (np.frombuffer(a, k) for a, k in zip(arrays, _KINDS.values()))
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        self.bias, self.first = shared, first[self.block]

    def times(self, w: np.ndarray) -> np.ndarray:
        own = w[self.first : self.first + self.n]
        return np.bincount(self.row, self.value * w[self.places][self.at], self.n) + w[self.bias] + self.alone * own

    def add_gathered(self, by_row: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Add the sums of shared terms and of the bias; return those of the rows' own terms."""
        to[self.places] += np.bincount(self.at, self.value * by_row[self.row], len(self.places))
        to[self.bias] += by_row.sum()
        return self.alone * by_row


class Sums:
    """What a Block does, for packed blocks on the executors and vectors on the driver."""

    def __init__(self, parts: DataFrame, shared: int):
        spark = parts.sparkSession
        self.sc, self.shared = spark.sparkContext, shared
        self.rows = {r["block"]: r["rows"] for r in parts.select("block", "rows").collect()}  # one number per block
        ends = np.cumsum(list(self.rows.values()))
        self.first = {b: shared + 1 + int(end) - n for (b, n), end in zip(self.rows.items(), ends)}
        self.terms = np.arange(shared + 1 + int(ends[-1]))
        self.slots = min(len(self.rows), self.sc.defaultParallelism)
        self.shuffled = 0
        columns = ["block", "rows", *list(_KINDS)[:6]]
        self.parts = parts.select(columns).repartition(self.slots).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def _run(self, kind: str, *sent) -> tuple[np.ndarray, np.ndarray, dict]:
        """One pass: sums by number, losses, and what rows are short by block."""
        shared, first = self.shared, self.first
        chunks = shared // CHUNK + 1  # the bias is the last number
        numbers = {b: chunks + 1 + 2 * at for at, b in enumerate(self.rows)}
        held = self.sc.broadcast((first, numbers, sent))

        def run(found):
            first, numbers, sent = held.value
            total, losses = np.zeros(shared + 1), 0.0
            for x in found:
                part = Part(x, shared, first)
                if kind == "slope":
                    short = np.maximum(0, 1 - part.y * part.times(sent[0]))
                    losses, by_row = losses + np.array([short @ short]), -2 * part.y * short
                    yield numbers[part.block] + 1, np.packbits(short > 0)
                elif kind == "curve":
                    d, short = sent
                    by_row = 2 * np.unpackbits(short[part.block], count=part.n) * part.times(d)
                else:
                    z, zp = (part.y * part.times(v) for v in sent)
                    losses = losses + np.array([(np.maximum(0, 1 - z - t * zp) ** 2).sum() for t in STEPS])
                    continue
                yield numbers[part.block], part.add_gathered(by_row, total)
            yield chunks, np.atleast_1d(losses)
            if kind != "line":
                for k in range(chunks):
                    yield k, total[k * CHUNK : (k + 1) * CHUNK]

        try:
            got = dict(self.parts.mapPartitions(run).reduceByKey(np.add, self.slots).collect())  # one vector
        finally:
            held.destroy()
            self._tidy(0 if kind == "line" else self.slots * 8 * (shared + 1))
        if kind == "line":
            return np.zeros(0), got[chunks], {}
        sums = np.concatenate([got[k] for k in range(chunks)] + [got[numbers[b]] for b in self.rows])
        return sums, got[chunks], {b: got[numbers[b] + 1] for b in self.rows} if kind == "slope" else {}

    def _tidy(self, shuffled: int) -> None:
        """Spark deletes shuffle files once the driver's garbage is collected; left alone that may be after hundreds of passes."""
        self.shuffled += shuffled
        if self.shuffled > SHUFFLED:
            self.sc._jvm.System.gc()
            self.shuffled = 0

    def slope(self, w) -> tuple[np.ndarray, float]:
        sums, losses, self.short = self._run("slope", w)
        return sums, float(losses[0])

    def curving(self, w):
        """Function of a direction, for the `w` that the slope was taken at."""
        return lambda d: self._run("curve", d, self.short)[0]

    def losses(self, w, p) -> list[float]:
        return self._run("line", w, p)[1].tolist()


class Gathered(Held, Spread):
    """Vectors on the driver, for blocks packed with the terms that several rows have, `<term, n>` in the order of `term`."""

    def __init__(self, parts: DataFrame, cost: float, counts: DataFrame, shared: np.ndarray):
        Spread.__init__(self, parts, cost)
        self.counts, self.shared = counts, shared
        self.sums = Sums(parts, len(shared))
        Held.__init__(self, self.sums, cost)

    def weights(self) -> DataFrame:
        spark, n = self.rows.sparkSession, len(self.shared)
        held = spark.sparkContext.broadcast((self.shared, self.sums.first, self.w))

        def several(batches):
            shared, _, w = held.value
            for batch in batches:
                found = w[np.searchsorted(shared, batch.column("term").to_numpy())]
                yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(found), batch.column("n")], names=["term", "weight", "n"])

        def alone(batches):
            _, first, w = held.value
            for batch in batches:
                for r in batch.to_pylist():  # blocks
                    length, term, row, value = (np.frombuffer(r[name], _KINDS[name]) for name in ("alone", "term", "of_row", "term_value"))
                    own = w[first[r["block"]] :][: r["rows"]]
                    by_row = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
                    arrays = [pa.array(term), pa.array(value * by_row[row]), pa.array(np.ones(len(term), np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["term", "weight", "n"])

        singles = self.rows.select("block", "rows", "alone", "term", "of_row", "term_value").mapInArrow(alone, WEIGHTS)
        bias = spark.createDataFrame([(BIAS, float(self.w[n]), sum(self.sums.rows.values()))], WEIGHTS)
        stored = materialize(self.counts.filter("n > 1").mapInArrow(several, WEIGHTS).unionByName(singles).unionByName(bias), "svm-weights")
        held.destroy()
        return stored

    def close(self) -> None:
        self.sums.parts.unpersist()


def _gathered(plain: DataFrame, cost: float) -> Gathered | None:
    """The rows packed into blocks where they lie; None if the driver would hold too many numbers."""
    found = plain.select(F.explode("indices").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = materialize(found, "svm-counts")
    if counts.filter("n > 1").count() + plain.count() >= HELD:
        return None
    shared = np.sort(counts.filter("n > 1").select("term").toArrow().column("term").to_numpy())
    held = plain.sparkSession.sparkContext.broadcast(shared)
    parts = plain.mapInArrow(_pack(held), _PACKED).withColumn("block", F.monotonically_increasing_id())
    stored = materialize(parts, "svm-parts")
    held.destroy()
    return Gathered(stored, cost, counts, shared)


# --- rows and models ------------------------------------------------------------------------------------


def sparse(vector: str) -> tuple[Column, Column]:
    """Places and values of a vector column, dense or sparse."""
    plain = F.unwrap_udt(F.col(vector))
    size = F.size(plain["values"])
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(plain["indices"], every), plain["values"]


def _whole(cost: float, tol: float):
    def run(table: pa.Table) -> pa.Table:
        block = _read_block(table)
        space = Held(block, cost)
        minimize(space, cost, tol)
        n = np.bincount(block.at, minlength=len(block.terms)).astype(np.int64)
        return pa.table([pa.array(block.terms), pa.array(space.w), pa.array(n)], names=["term", "weight", "n"])

    return run


def fit_weights(rows: DataFrame, cost: float = 1.0, tol: float = 1e-10, rows_per_block: int | None = None) -> DataFrame:
    """`<term, weight, n>`, stored, for `<label, features>`: the weight of each term and the rows that have it.

    Labels above 0 are one class. Both classes must occur for the weights to mean anything; no rows give no weights. Blocks are
    as many as the values of all vectors ask for. If `rows_per_block` says how many rows a block has, blocks exchange sums as tables.
    """
    indices, values = sparse("features")
    plain = rows.select(F.col("label").cast("double").alias("label"), indices.alias("indices"), values.alias("values"))
    if rows_per_block is None:
        size = plain.agg(F.sum(F.size("values") + 1)).first()[0] or 0
        blocks = -(-size // NUMBERS_PER_BLOCK)
    else:
        blocks = -(-rows.count() // rows_per_block)
    if blocks <= 1:
        one = plain.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(_whole(cost, tol), WEIGHTS)
        return materialize(one, "svm-weights")
    if rows_per_block is None and (space := _gathered(plain, cost)) is not None:
        try:
            minimize(space, cost, tol)
            return space.weights()
        finally:
            space.close()
    # Bucketed by block, so that no pass shuffles the rows.
    block = F.pmod(F.xxhash64("label", "indices", "values"), F.lit(blocks)).cast("int")
    placed = plain.withColumn("block", block).repartition(blocks, "block")
    space = Spread(bucketed(placed, "svm-rows", blocks, "block"), cost)
    minimize(space, cost, tol)
    return materialize(space.weights(), "svm-weights")


def margins(weights: DataFrame, rows: DataFrame, id_col: str = "id", vector: str = "features") -> DataFrame:
    """`<id, margin>`. Rows that share an id have one vector."""
    indices, values = sparse(vector)
    pairs = F.arrays_zip(
        F.concat(indices, F.array(F.lit(BIAS))).alias("term"), F.concat(values, F.array(F.lit(1.0))).alias("value")
    )
    long = rows.select(id_col, F.inline(pairs))
    # Terms that no training row has weigh nothing.
    joined = lookup_join(long, weights, "term", counts="n", spread_by=id_col)
    copies = F.sum(F.when(F.col("term") == BIAS, F.col("value")))  # of an id's vector, whose parts are added up
    return joined.groupBy(id_col).agg((F.sum(F.col("value") * F.col("weight")) / copies).alias("margin"))


class SquaredHingeSVM(Estimator):
    """The SVM as an estimator on `label` and `features`."""

    def __init__(self, cost: float = 1.0, tol: float = 1e-10, id_col: str = "id", rows_per_block: int | None = None):
        super().__init__()
        self.cost, self.tol, self.id_col, self.rows_per_block = cost, tol, id_col, rows_per_block

    def _fit(self, dataset):
        return SquaredHingeModel(fit_weights(dataset, self.cost, self.tol, self.rows_per_block), self.id_col)


@dataclass(eq=False)
class SquaredHingeModel(Model):
    """Adds `rawPrediction` and `prediction` to rows with an id."""

    weights: DataFrame
    id_col: str = "id"

    def __post_init__(self):
        super().__init__()

    def _transform(self, dataset):
        joined = dataset.join(margins(self.weights, dataset, self.id_col), self.id_col, "left")
        raw = array_to_vector(F.array(-F.col("margin"), F.col("margin")))
        prediction = (F.col("margin") > 0).cast("double")
        return joined.withColumns({"rawPrediction": raw, "prediction": prediction}).drop("margin")
