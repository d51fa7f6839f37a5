"""Removal of repeated passages with prefix-partitioned suffix trees.

A window is 50 consecutive words. A word goes if a window that covers it also starts in a document with a
smaller id.

* Sync points: the smallest hash among a window's runs of `RUN` words is its anchor. Equal windows have equal
  anchors at equal places, so the words from a suffix's start through its anchor are a variable-length prefix
  that splits suffixes: only suffixes with the same anchor can share 50 words. Anchors are about one in 22
  words, and only they are counted and shuffled for the whole corpus.
* Suffixes whose anchor occurs in one document only have no deep node and are finished. For the others, the
  stretch of text whose windows have the anchor travels to the anchor's group; groups are packed into memory-sized
  parts.
* A part's suffix tree is held as its sorted suffixes: ranks of prefixes of 1, 2, 4 .. 32 words by doubling and
  of 50 words from two of 32. Suffixes of equal rank hang below one node of depth 50 or more, an internal node if
  there are several; its smallest document keeps the words, and repeats elsewhere are maximal runs of removed
  windows.
* An anchor in more than `GROUP` documents (boilerplate) is not gathered anywhere: its windows are counted under
  a 128-bit digest of their words, combined before the shuffle, and meet the smallest document by a join.

Exact copies of a whole text are settled by the digest of their words and never enter the trees.

Defined cases: null and empty texts have no words; texts of fewer than 50 words are never touched; repeats within
one document stay; rows with one doc_id never remove each other's words; a null doc_id counts as larger than every
other and is given back as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from llm.words import SPACED, blocks, run_hashes, sliding_min, split, word_hashes
from tagloom.session import materialize, spread

WINDOW = 50
RUN = 8  # words in an anchor
GROUP = 1_000  # documents of an anchor that are gathered into one tree
PART_ROWS = 500  # stretches in one part, about 72 words each

_LAST = (1 << 63) - 1


def _window_anchors(hashes: np.ndarray) -> np.ndarray:
    """Anchor of the window that starts at each word."""
    return sliding_min(run_hashes(hashes, RUN), WINDOW - RUN + 1)


def _scan(batches):
    """Per document: its words counted and digested, and the distinct anchors of its windows."""
    for batch in batches:
        at = 0
        for a, b, data, offsets in blocks(batch.column("text")):
            found = split(data, offsets, SPACED)
            anchors = _window_anchors(word_hashes(found)).view(np.int64) if len(found.start) else np.zeros(0, np.int64)
            starts, lists = found.first, []
            raw = data.tobytes()
            digests, shas = [], []
            for row in range(b - a):
                lo, hi = int(starts[row]), int(starts[row + 1])
                lists.append(np.unique(anchors[lo : hi - WINDOW + 1]) if hi - lo >= WINDOW else anchors[:0])
                words = b" ".join(raw[offsets[row] : offsets[row + 1]].split())
                shas.append(hashlib.sha256(words).hexdigest())
            sizes = np.cumsum([0, *map(len, lists)])
            part = batch.slice(at, b - a)
            at += b - a
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*lists, anchors[:0]]))),
                ],
                names=["doc_id", "n_words", "words_sha256", "anchors"],
            )


def _stretches(batches):
    """For each document with repeated anchors: the text around each run of windows that have one of them."""
    for batch in batches:
        at = 0
        for a, b, data, offsets in blocks(batch.column("text")):
            found = split(data, offsets, SPACED)
            part = batch.slice(at, b - a)
            at += b - a
            if not len(found.start):
                continue
            anchors = _window_anchors(word_hashes(found)).view(np.int64)
            raw = data.tobytes()
            docs, keys = part.column("doc").to_pylist(), part.column("words_sha256").to_pylist()
            wanted = part.column("repeated")
            out: dict[str, list] = {"doc": [], "words_sha256": [], "anchor": [], "start": [], "count": [], "words": []}
            for row in range(b - a):
                lo, hi = int(found.first[row]), int(found.first[row + 1])
                if hi - lo < WINDOW:
                    continue
                own = anchors[lo : hi - WINDOW + 1]
                cuts = np.flatnonzero(np.diff(own)) + 1
                firsts = np.concatenate([[0], cuts])
                sizes = np.diff(np.concatenate([firsts, [len(own)]]))
                listed = np.asarray(wanted[row].values.to_numpy(zero_copy_only=False))
                for f, n in zip(*(x[np.isin(own[firsts], listed)].tolist() for x in (firsts, sizes)), strict=True):
                    text = raw[found.start[lo + f] : found.end[lo + f + n + WINDOW - 2]]
                    out["doc"].append(docs[row])
                    out["words_sha256"].append(keys[row])
                    out["anchor"].append(int(own[f]))
                    out["start"].append(f)
                    out["count"].append(n)
                    out["words"].append(b" ".join(text.split()).decode("utf-8", "replace"))
            if out["doc"]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["doc"], pa.int64()),
                        pa.array(out["words_sha256"], pa.string()),
                        pa.array(out["anchor"], pa.int64()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["count"], pa.int32()),
                        pa.array(out["words"], pa.string()),
                    ],
                    names=list(out),
                )


def deep_nodes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each suffix start, the number of its node at depth WINDOW; `codes` are word numbers of all texts in a row."""
    ranks, size = codes.astype(np.int64), 1
    while size * 2 <= WINDOW:
        n = len(ranks) - size
        if n <= 0:
            break
        ranks = np.unique(ranks[:n] * (int(ranks.max()) + 1) + ranks[size : size + n], return_inverse=True)[1]
        size *= 2
    tail = starts + WINDOW - size
    return np.unique(ranks[starts] * (int(ranks.max()) + 1) + ranks[tail], return_inverse=True)[1]


def _runs(row: np.ndarray, start: np.ndarray):
    """Borders of runs of consecutive starts in one row; both are sorted by row and start."""
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]])


def _trees(frame):
    """Removed spans `<doc, words_sha256, a, b>` (words a to b, exclusive) of one part of anchor groups."""
    import pandas as pd

    none = np.zeros(0, np.int64)
    empty = pd.DataFrame({"doc": none, "words_sha256": none.astype(object), "a": none, "b": none})
    texts = pa.array(frame["words"], pa.string())
    out = []
    kept = ("doc", "words_sha256", "start", "count")
    doc, key, first, count = (frame[c].to_numpy() for c in kept)
    codes, sizes = [], []
    for _, _, data, offsets in blocks(texts, 4 << 20):
        found = split(data, offsets, SPACED)
        codes.append(word_hashes(found))
        sizes.append(np.diff(found.first))
    if not codes:
        return empty
    codes = np.unique(np.concatenate(codes), return_inverse=True)[1]
    base = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[:-1]
    row = np.repeat(np.arange(len(frame)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    node = deep_nodes(codes, base[row] + within)
    least = np.full(node.max() + 1, _LAST, np.int64)
    np.minimum.at(least, node, doc[row])
    gone = np.flatnonzero(least[node] < doc[row])
    if not len(gone):
        return empty
    row, start = row[gone], first[row[gone]] + within[gone]
    lo, hi = _runs(row, start)
    return pd.DataFrame(
        {
            "doc": doc[row[lo]],
            "words_sha256": key[row[lo]],
            "a": start[lo],
            "b": start[hi - 1] + WINDOW,
        }
    )


def _digests(batches):
    """One row for each distinct window of a crowded stretch, with its places: `<doc, words_sha256, at, window>`."""
    for batch in batches:
        out: dict[str, list] = {"doc": [], "words_sha256": [], "at": [], "window": []}
        columns = (batch.column(c).to_pylist() for c in ("doc", "words_sha256", "start", "count", "words"))
        for doc, key, start, count, words in zip(*columns, strict=True):
            words = words.encode().split()
            places: dict[bytes, list[int]] = {}
            for i in range(count):
                window = hashlib.md5(b" ".join(words[i : i + WINDOW])).digest()
                places.setdefault(window, []).append(start + i)
            for window, at in places.items():
                out["doc"].append(doc)
                out["words_sha256"].append(key)
                out["at"].append(at)
                out["window"].append(window)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["doc"], pa.int64()),
                pa.array(out["words_sha256"], pa.string()),
                pa.array(out["at"], pa.list_(pa.int64())),
                pa.array(out["window"], pa.binary()),
            ],
            names=list(out),
        )


def _cut(batches):
    """Texts without their removed spans: `<doc, words_sha256, n_removed, kept>`."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            removed, kept = [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                stay = np.ones(len(words), bool)
                for span in spans:
                    stay[span["a"] : span["b"]] = False
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(stay)).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    part.column("words_sha256"),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc", "words_sha256", "n_removed", "kept"],
            )


_SPAN = "doc bigint, words_sha256 string, a bigint, b bigint"


def _analyze(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`<doc_id, doc, n_words, words_sha256, copy>` per document,
    `<doc, words_sha256, text, spans>` for documents that lose part of their words)."""
    doc = F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc")
    kind = documents.schema["doc_id"].dataType.simpleString()
    scanned = documents.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, n_words bigint, words_sha256 string, anchors array<bigint>"
    )
    scanned = materialize(scanned.select("*", doc), "anchors")
    # The first of exact copies stands for all; it has the smallest id.
    first = scanned.groupBy("words_sha256").agg(F.min("doc").alias("least"))
    base = scanned.select("doc_id", "doc", "n_words", "words_sha256").join(first, "words_sha256")
    base = base.select(
        "doc_id", "doc", "n_words", "words_sha256", ((F.col("doc") > F.col("least"))).alias("copy")
    )
    alone = scanned.filter(F.col("n_words") >= WINDOW).join(
        first.select("words_sha256", F.col("least").alias("doc")), ["words_sha256", "doc"], "left_semi"
    )
    listed = materialize(
        alone.dropDuplicates(["doc", "words_sha256"]).select("doc", "words_sha256", F.explode("anchors").alias("anchor")),
        "listed",
    )
    shared = (
        listed.groupBy("anchor")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
        .filter("lo < hi")
        .select("anchor", (F.col("n") > GROUP).alias("crowded"))
    )
    shared = materialize(shared, "shared-anchors")
    repeated = (
        listed.join(shared, "anchor")
        .groupBy("doc", "words_sha256")
        .agg(F.collect_list("anchor").alias("repeated"))
    )
    texts = documents.select(doc, F.coalesce("text", F.lit("")).alias("text"))
    candidates = texts.join(repeated, "doc")
    if _has_repeats(base):
        # Several rows with one id: the digest of the words tells texts apart, and one row of each is enough.
        candidates = candidates.mapInArrow(
            _matching, "doc bigint, text string, words_sha256 string, repeated array<bigint>"
        ).dropDuplicates(["doc", "words_sha256"])
    candidates = materialize(candidates, "candidates")
    stretches = candidates.mapInArrow(
        _stretches, "doc bigint, words_sha256 string, anchor bigint, start bigint, count int, words string"
    )
    stretches = materialize(stretches.join(shared, "anchor"), "stretches")
    plain = stretches.filter("NOT crowded")
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, plain.count() // PART_ROWS)
    trees = (
        plain.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
        .select("part", "doc", "words_sha256", "start", "count", "words")
        .groupBy("part")
        .applyInPandas(lambda frame: _trees(frame), _SPAN)
    )
    windows = stretches.filter("crowded").mapInArrow(
        _digests, "doc bigint, words_sha256 string, at array<bigint>, window binary"
    )
    least = windows.groupBy("window").agg(F.min("doc").alias("least"))
    hot = (
        windows.join(least, "window")
        .filter("least < doc")
        .select("doc", "words_sha256", F.explode("at").alias("a"))
        .withColumn("b", F.col("a") + WINDOW)
    )
    spans = (
        trees.unionByName(hot)
        .groupBy("doc", "words_sha256")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    return base, candidates.select("doc", "words_sha256", "text").join(spans, ["doc", "words_sha256"])


def _matching(batches):
    """Rows whose text has the digest it was joined to."""
    for batch in batches:
        good = [
            hashlib.sha256(b" ".join(text.encode().split())).hexdigest() == key
            for text, key in zip(batch.column("text").to_pylist(), batch.column("words_sha256").to_pylist())
        ]
        yield batch.filter(pa.array(good, pa.bool_()))


def _has_repeats(base: DataFrame) -> bool:
    return base.groupBy("doc").count().filter("count > 1").limit(1).count() > 0


def without_repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`<doc_id, n_words, n_removed, kept_sha256>` for every row of `<doc_id, text>`,
    `<doc, kept>`: texts of those that lose a part; a full copy loses all)."""
    base, losing = _analyze(documents)
    cut = materialize(
        losing.mapInArrow(_cut, "doc bigint, words_sha256 string, n_removed bigint, kept string"), "cut"
    )
    small = cut.select("doc", "words_sha256", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    out = base.join(small, ["doc", "words_sha256"], "left").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
    return out, cut.select("doc", "kept")


@query("op4_repeats")
def op4_repeats(spark, folder):
    return without_repeats(spread(table(spark, folder, "documents", "doc_id", "text")))[0]
