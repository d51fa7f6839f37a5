"""Toxicity by maximum-scoring segments of token log-odds.

Fit: on a bounded sample of labelled rows, one per distinct text, documents with a token are counted per class.
A token's log-odds between the classes have a Dirichlet prior with the token's share in both classes together
(`PRIOR` times as heavy as the counts); tokens that stand `MIN_Z` standard errors above or below zero keep theirs, all others
cost `GAP` (README has what a scan over all log-odds finds instead). A word that was not kept falls back on its first `STEM`
bytes, which are counted in the same way.

Score: one scan over the words of a text finds all maximal segments (every passage whose score can't be raised by
growing or shrinking it) in linear time; a word right behind itself counts like one without a score. The best segment,
the sum of all and the number of words go into a Gumbel distribution function, whose parameters are fitted to the labels
of the sample: the chance that no ordinary text of this length reaches such a score.

Only the sample's labels and its bounded model are gathered; all texts are scored in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the score of an empty text; without labelled rows, or with
one class only, every score is 0; rows without doc_id are never used to fit and are not held out; repeated labels of a
document count as the largest; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.registry import query, table
from llm.rows import text_key
from llm.words import LETTERS, Words, blocks, split, word_hashes
from tagloom.session import materialize, spread

FIT_ROWS = 100_000  # labelled rows used to fit, at most: those with the smallest hash of their id
PRIOR = 0.1
MIN_Z = 2.3
GAP = 0.15
STEM = 8
TOXIC_FROM = 0.7
RIDGE = 1e-6
NOISE = 0.02  # share of wrong labels that the calibration expects


def _tokens(texts: pa.Array):
    """(first row, row after the last, words, hash of each word, hash of its stem) by block."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for a, b, data, offsets in blocks(pc.utf8_lower(texts.fill_null(""))):
        found = split(data, offsets, LETTERS)
        if len(found.start):
            stems = Words(found.data, found.start, np.minimum(found.end, found.start + STEM), found.row, found.first)
            yield a, b, found, word_hashes(found), word_hashes(stems)
        else:
            yield a, b, found, np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _count(batches):
    """Texts of each class that have a token: `<kind, token, toxic, clean>`, kind 0 for words and 1 for stems."""
    for batch in batches:
        labels = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
        for a, b, found, words, stems in _tokens(batch.column("text")):
            toxic = labels[a:b]
            for kind, hashes in ((0, words), (1, stems)):
                pairs = np.unique(np.stack([hashes, found.row.astype(np.uint64)]), axis=1)
                token, at = np.unique(pairs[0], return_inverse=True)
                weight = toxic[pairs[1].astype(np.int64)]
                high = np.bincount(at, weights=weight, minlength=len(token)).astype(np.int64)
                low = np.bincount(at, minlength=len(token)) - high
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(token), kind, np.int8)),
                        pa.array(token.view(np.int64)),
                        pa.array(high),
                        pa.array(low),
                    ],
                    names=["kind", "token", "toxic", "clean"],
                )


def segments(places: list[int], scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, last word, score); words without a score cost GAP each."""
    found: list[tuple[int, int, float, float]] = []
    total, before = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= GAP * (place - before - 1)
        low, total, before = total, total + score, place
        if score <= 0:
            continue  # no segment begins or ends with it
        start, end, high = place, place, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


class Model:
    """Sorted token hashes with their scores, and the calibration."""

    def __init__(self, words, word_scores, stems, stem_scores, calibration=None):
        self.words, self.word_scores = words, word_scores
        self.stems, self.stem_scores = stems, stem_scores
        self.calibration = calibration

    def scores(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Score of each word, 0 where the model has none."""
        out = np.zeros(len(words))
        for known, values, hashes in (
            (self.stems, self.stem_scores, stems),
            (self.words, self.word_scores, words),
        ):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = values[at[hit]]
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(features))
        return gumbel(_design(features) @ self.calibration)


def gumbel(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.exp(-np.clip(x, -6.0, 30.0)))


def _design(features: np.ndarray) -> np.ndarray:
    """Best segment, sum of segments and number of words as the distribution's terms."""
    best, total, n = features.T
    return np.stack([np.ones(len(best)), best, np.log1p(total), np.log1p(n)], axis=1)


def calibrate(features: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Maximum likelihood for P(toxic) = exp(-exp(-x)) where NOISE of the labels are wrong; rows have weights."""
    design = _design(features)
    beta = np.array([-1.0, 0.3, 0.0, 0.0])
    weight = count / count.sum()

    def chance(b):
        return NOISE + (1 - 2 * NOISE) * gumbel(design @ b)

    def loss(b):
        p = chance(b)
        return -(weight * (toxic * np.log(p) + (1 - toxic) * np.log1p(-p))).sum() + RIDGE * (b[1:] ** 2).sum()

    step = 1.0
    for _ in range(400):
        x = np.clip(design @ beta, -6.0, 30.0)
        p = chance(beta)
        slope = (1 - 2 * NOISE) * np.exp(-np.exp(-x) - x)
        gradient = design.T @ (weight * (toxic / p - (1 - toxic) / (1 - p)) * slope) - 2 * RIDGE * np.r_[0.0, beta[1:]]
        curve = weight * slope * slope / (p * (1 - p))
        move = np.linalg.solve((design * curve[:, None]).T @ design + 2 * RIDGE * np.eye(4), gradient)
        now, step = loss(beta), min(1.0, step * 4)
        while step > 1e-6 and loss(beta + step * move) > now:
            step /= 2
        beta = beta + step * move
        if step <= 1e-6 or np.abs(step * move).max() < 1e-6:
            break
    return beta


def _score(batches, model: Model, extra: list[str], passages: bool):
    """Features of every text, with the columns `extra` passed on."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        for a, b, found, words, stems in _tokens(batch.column("text")):
            n = np.diff(found.first)
            scores = model.scores(words, stems)
            if len(words):  # a word right behind itself says nothing new
                scores[1:][(words[1:] == words[:-1]) & (found.row[1:] == found.row[:-1])] = 0
            hits = np.flatnonzero(scores)
            borders = np.searchsorted(hits, found.first)
            features, spans = np.zeros((b - a, 3)), []
            features[:, 2] = n
            for row in range(b - a):
                own = hits[borders[row] : borders[row + 1]]
                found_here = segments((own - found.first[row]).tolist(), scores[own].tolist()) if len(own) else []
                if found_here:
                    values = [s for _, _, s in found_here]
                    features[row, :2] = max(values), sum(values)
                spans.append(found_here)
            part = batch.slice(a, b - a)
            columns = {name: part.column(name) for name in extra}
            columns |= {"best": features[:, 0], "total": features[:, 1], "n": features[:, 2]}
            if passages:
                # A passage is significant if it alone would make a text of this length toxic.
                listed = []
                for row, here in enumerate(spans):
                    alone = np.array([[s, s, n[row]] for _, _, s in here]).reshape(-1, 3)
                    good = model.probability(alone) >= TOXIC_FROM
                    listed.append(
                        [{"start": x, "end": y + 1, "score": s} for (x, y, s), g in zip(here, good, strict=True) if g]
                    )
                columns |= {"score": model.probability(features), "passages": pa.array(listed, pa.list_(span))}
            arrays = [pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(columns))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from `<doc_id, text>` and `<doc_id, toxic>`, of at most FIT_ROWS labelled rows that are not held out."""
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
    )
    # Copies of one text teach nothing new: the smallest id of each text and label stays.
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kept = materialize(
        rows.groupBy(text_key().alias("key"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"),
        "fit-rows",
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    counts = rows.mapInArrow(_count, "kind tinyint, token bigint, toxic bigint, clean bigint")
    counts = materialize(
        counts.groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tokens"
    )
    totals = counts.groupBy("kind").agg(F.sum("toxic").alias("all_toxic"), F.sum("clean").alias("all_clean"))
    t, c = F.col("toxic"), F.col("clean")
    prior = PRIOR * (t + c)
    weight = PRIOR * (F.col("all_toxic") + F.col("all_clean"))
    odds = F.log((t + prior) / (F.col("all_toxic") + weight - t - prior)) - F.log(
        (c + prior) / (F.col("all_clean") + weight - c - prior)
    )
    error = F.sqrt(1 / (t + prior) + 1 / (c + prior))
    scored = counts.join(F.broadcast(totals), "kind").filter((F.col("all_toxic") > 0) & (F.col("all_clean") > 0))
    chosen = (
        scored.select("kind", "token", odds.alias("odds"), error.alias("error"))
        .filter(F.abs("odds") >= MIN_Z * F.col("error"))
        .select("kind", "token", "odds")
        .collect()
    )  # bounded by the sample: tokens whose share in one of the classes stands out

    def side(kind):
        rows = sorted((r["token"], r["odds"]) for r in chosen if r["kind"] == kind)
        hashes = np.array([token for token, _ in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], np.array([odds for _, odds in rows], np.float64)[order]

    model = Model(*side(0), *side(1))
    features = rows.mapInArrow(
        lambda batches: _score(batches, model, ["toxic"], False), "toxic int, best double, total double, n double"
    )
    grid = features.groupBy(
        "toxic",
        F.round("best", 1).alias("best"),
        F.round("total", 0).alias("total"),
        F.round(F.exp(F.round(F.log1p("n"), 1)) - 1, 1).alias("n"),
    ).count()
    table = np.array([tuple(r) for r in grid.collect()], np.float64).reshape(-1, 5)
    if len(np.unique(table[:, 0] > 0)) == 2:
        model.calibration = calibrate(table[:, 1:4], (table[:, 0] > 0).astype(float), table[:, 4])
    return model


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """`<doc_id, score, best, total, n, passages>` for every row of `<doc_id, text>`; passages in words."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: _score(batches, model, ["doc_id"], True),
        f"doc_id {kind}, best double, total double, n double, score double, "
        "passages array<struct<start:bigint,end:bigint,score:double>>",
    )


def with_scores(documents: DataFrame, model: Model) -> DataFrame:
    """The columns of `documents`, which has a `text`, and its `score`; columns named like a result are left out."""
    documents = documents.drop("best", "total", "n", "score", "passages")
    columns = documents.columns

    def run(batches):
        for scored in _score(batches, model, columns, True):
            yield scored.select([*columns, "score"])

    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(run, schema)


@query("op10_toxicity")
def op10_toxicity(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    model = fit(documents, table(spark, folder, "labels", "doc_id", "toxic"))
    return toxicity(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
