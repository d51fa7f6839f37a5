"""Quality by ordinal regression with cumulative links.

A graded rating 0 .. K - 1 has the chance of being above grade k of sigmoid(w . x - t_k), with one weight vector for all
grades and ordered thresholds t_0 < t_1 < ... . Features x are hashed: shares of word hashes and of the words'
last bytes among `BUCKETS` weights, plus six measures of the whole text (word pairs only count in that of repetition). The fit minimizes the likelihood by full
gradients over a bounded sample of rated rows, in one task; thresholds are kept in order by fitting their steps.

Every document then gets its expected grade (the sum of its tail chances) and the chance of the highest grade, by which
it is selected. Scoring is one pass without a shuffle.

Defined cases: null and empty texts have features of zero and so the chance of their thresholds; without rated rows, or
with one grade only, every chance is one half and nothing is selected; repeated ratings of a document count as their
smallest; null ratings are left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from llm.words import SPACED, blocks, mix, run_hashes, split, word_hashes
from tagloom.session import materialize, spread

FIT_ROWS = 20_000  # rated rows used to fit, at most: those with the smallest hash of their id
BUCKETS = 1 << 14
MEASURES = 6
ROUNDS = 300
RIDGE = 1e-4
SELECT_FROM = 0.5

_KINDS = np.zeros(256, np.uint8)  # byte kinds for shapes: lower, upper, digit, beyond ASCII, other
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 4


def _sparse(texts):
    """(first row, row after the last, row of each feature, its bucket, its value) by block of texts."""
    for a, b, data, offsets in blocks(texts):
        found = split(data, offsets, SPACED)
        rows = b - a
        n = np.diff(found.first)
        per_word = 1.0 / np.maximum(n, 1)
        hashes = word_hashes(found)
        pairs = run_hashes(hashes, 2)
        inside = found.row[: len(pairs)] == found.row[1 : 1 + len(pairs)] if len(pairs) else np.zeros(0, bool)
        sizes = np.diff(offsets)
        kinds = _KINDS[data]
        of_byte = np.repeat(np.arange(rows), sizes)
        shares = [np.bincount(of_byte, kinds == kind, minlength=rows) / np.maximum(sizes, 1) for kind in range(5)]
        again = np.zeros(rows)
        if len(pairs):
            seen = np.stack([found.row[: len(pairs)][inside].astype(np.uint64), pairs[inside]])
            distinct = np.unique(seen, axis=1)[0].astype(np.int64)
            total = np.bincount(seen[0].astype(np.int64), minlength=rows)
            again = 1 - np.bincount(distinct, minlength=rows) / np.maximum(total, 1)
            again[total == 0] = 0
        measures = np.stack([shares[2], shares[3], shares[0], again, np.log1p(n) / 10, (n < 50) * (n > 0)], axis=1)
        words = (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)
        ends = found.data[found.end - 1] if len(found.end) else np.zeros(0, np.uint8)
        tails = (mix(ends.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(BUCKETS)).astype(np.int64)
        row = np.concatenate([found.row, found.row, np.repeat(np.arange(rows), MEASURES)])
        bucket = np.concatenate([words, tails, BUCKETS + np.tile(np.arange(MEASURES), rows)])
        value = np.concatenate([per_word[found.row] * 5, per_word[found.row] * 5, measures.ravel()])
        yield a, b, row, bucket, value


def _features(batches):
    """`<grade, buckets, values>` of each row, for the fit."""
    for batch in batches:
        for a, b, row, bucket, value in _sparse(batch.column("text")):
            key, at = np.unique(row * (BUCKETS + MEASURES) + bucket, return_inverse=True)
            total = np.bincount(at, value)
            cut = np.searchsorted(key // (BUCKETS + MEASURES), np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grade").slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key % (BUCKETS + MEASURES), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(total.astype(np.float32))),
                ],
                names=["grade", "buckets", "values"],
            )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(grade, row, bucket, value, grades: int):
    """Weights and thresholds by accelerated gradients (Adam) on the mean log-likelihood."""
    size, n = BUCKETS + MEASURES, len(grade)
    above = grade[:, None] > np.arange(grades - 1)[None, :]
    share = np.clip(above.mean(0), 0.01, 0.99)
    first = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        w, steps = theta[:size], theta[size:]
        cuts = np.concatenate([steps[:1], steps[:1] + np.cumsum(np.exp(steps[1:]))])
        x = np.bincount(row, value * w[bucket], minlength=n)
        tail = _sigmoid(x[:, None] - cuts[None, :])
        # P(grade = g) is the difference of neighbouring tails.
        edges = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-9)
        slope = tail * (1 - tail)
        padded = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
        high, low = padded[np.arange(n), grade] / p, padded[np.arange(n), grade + 1] / p
        dx = -(high - low) / n
        dcut = np.zeros(grades - 1)
        for k in range(grades - 1):
            dcut[k] = (high[grade == k + 1].sum() - low[grade == k].sum()) / n
        dsteps = np.concatenate([[dcut.sum()], np.exp(steps[1:]) * np.cumsum(dcut[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(bucket, value * dx[row], minlength=size) + RIDGE * w, dsteps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    steps = theta[size:]
    return theta[:size], np.concatenate([steps[:1], steps[:1] + np.cumsum(np.exp(steps[1:]))])


def _fit(frame, grades: int):
    import pandas as pd

    sizes = frame["buckets"].map(len).to_numpy()
    weights, cuts = fit_ordinal(
        frame["grade"].to_numpy().astype(np.int64),
        np.repeat(np.arange(len(frame)), sizes),
        np.concatenate(frame["buckets"].to_list()).astype(np.int64),
        np.concatenate(frame["values"].to_list()).astype(np.float64),
        grades,
    )
    return pd.DataFrame({"weights": [weights], "cuts": [cuts]})


def fit(documents: DataFrame, ratings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from `<doc_id, text>` and `<doc_id, grade>`, of at most FIT_ROWS rated rows."""
    sample = (
        ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
    )
    sample = materialize(sample, "rated")
    top = sample.agg(F.max("grade").alias("top"), F.countDistinct("grade").alias("n")).first()
    if (top["n"] or 0) < 2:
        return np.zeros(BUCKETS + MEASURES), np.zeros(1)
    grades = top["top"] + 1
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("grade", "text")
    features = rows.mapInArrow(_features, "grade int, buckets array<int>, values array<float>")
    fitted = (
        features.groupBy(F.lit(0).alias("all"))  # bounded by FIT_ROWS
        .applyInPandas(lambda frame: _fit(frame, grades), "weights array<double>, cuts array<double>")
        .first()
    )
    if fitted is None:
        return np.zeros(BUCKETS + MEASURES), np.zeros(1)
    return np.asarray(fitted["weights"]), np.asarray(fitted["cuts"])


def graded(documents: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """`<doc_id, expected_grade, tails>` per row of `<doc_id, text>`; tails are the chances of being above each grade."""

    def run(batches):
        for batch in batches:
            for a, b, row, bucket, value in _sparse(batch.column("text")):
                x = np.bincount(row, value * weights[bucket], minlength=b - a)
                tail = _sigmoid(x[:, None] - cuts[None, :])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(tail.sum(1)),
                        pa.array(list(tail), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "expected_grade", "tails"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, expected_grade double, tails array<double>"
    )


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from the two labels: 0 poor, 1 good but toxic, 2 good. Rows without a quality have no grade, whatever
    their other label says; good rows whose other label is null count as good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, F.when(F.col(toxic) == 1, 1).otherwise(2))


@query("op1_grades")
def op1_grades(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    labels = table(spark, folder, "labels", "doc_id", "quality", "toxic")
    model = fit(documents, labels.select("doc_id", rating().alias("grade")))
    top = F.element_at("tails", -1)
    good = F.get("tails", 0)
    return graded(documents, *model).select(
        "doc_id",
        "expected_grade",
        good.alias("p_above_poor"),
        top.alias("p_top"),
        (good > SELECT_FROM).alias("kept"),
    )
