"""SimHash near-duplicates with pivot distance tables.

The fingerprint of a text has a bit set if more than half of its word runs' hashes have it. Two fingerprints
are linked if they differ in at most `BITS` bits.

Every distinct fingerprint gets a table of Hamming distances to reference fingerprints (pivots). By the
triangle inequality, linked fingerprints differ by at most `BITS` in every coordinate of the table.

* Structured pivots: four families, one per 16-bit segment, each the zero word and the 16 words with a single
  bit of the segment. The differences of distances within a family depend on that segment alone (they are its
  bits), and two changed bits leave at least two of the four segments as they were. So linked fingerprints
  agree in all coordinates of two families: six cell keys each.
* Random pivots: within a cell, pairs are discarded by the maximum coordinate difference to 16 random
  references, and what survives is verified by counting differing bits.

A cell of more than `CELL` distinct fingerprints is not compared pairwise. There, each fingerprint is listed
under every word at distance 0 or 1 from it: two fingerprints meet under a common word exactly if they differ
in at most two bits, all that meet under one word are within two bits of each other, and no word can have more
than 65. That costs 65 rows per fingerprint and is exact, so crowded cells lose no link.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
run are one run; exact copies share a fingerprint and are never expanded into pairs; a null doc_id gets the
component of its fingerprint and never names one while there is another id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.registry import query, table
from llm.rows import text_key
from tagloom.session import materialize, spread

BITS = 2
SEED = 42
CELL = 64
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, 16, dtype=np.uint64)

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, run: int = 3) -> int:
    """Majority bits of the hashes of all word runs, repeats included, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < run:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*[words[i:] for i in range(run)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in runs], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(documents: DataFrame, run: int = 3) -> DataFrame:
    """`<doc_id, text_key, print bigint>` for every row of `<doc_id, text>`."""

    def scan(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                prints = [fingerprint(text, run) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(prints, pa.int64())],
                    names=["doc_id", "text_key", "print"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(
        scan, f"doc_id {kind}, text_key string, print bigint"
    )


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every random pivot."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :])


def _cells() -> F.Column:
    """Six keys: the coordinates of two families of structured pivots, with the number of the pair."""
    part = [F.shiftrightunsigned(F.col("print"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(
        *[
            F.lit(n).cast("bigint") * (1 << 32) + F.shiftleft(part[i], 16) + part[j]
            for n, (i, j) in enumerate(pairs)
        ]
    )


def _linked_in_cells(frame):
    """Links inside the cells of a group, as `<a, b>` with b the smallest fingerprint reached in the group."""
    import pandas as pd

    frame = frame.sort_values(["cell", "print"], kind="stable")
    cell = frame["cell"].to_numpy()
    prints, place = np.unique(frame["print"].to_numpy(), return_inverse=True)
    words = prints.view(np.uint64)
    pivots = distance_table(words).astype(np.int16)
    left, right = [], []
    for step in range(1, CELL):
        same = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(same):
            break
        a, b = place[same], place[same + step]
        near = np.abs(pivots[a] - pivots[b]).max(axis=1) <= BITS
        a, b = a[near], b[near]
        near = np.bitwise_count(words[a] ^ words[b]) <= BITS
        left.append(a[near])
        right.append(b[near])
    root = np.arange(len(prints))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return pd.DataFrame({"a": prints[moved], "b": prints[root[moved]]})


def links(distinct: DataFrame) -> DataFrame:
    """`<a, b>` pairs of distinct fingerprints `<print>` whose components are those of all links."""
    listed = distinct.select("print", F.explode(_cells()).alias("cell"))
    crowded = listed.groupBy("cell").count().filter(F.col("count") > CELL).select("cell", F.lit(True).alias("crowded"))
    listed = materialize(listed.join(crowded, "cell", "left"), "cells")
    spark = distinct.sparkSession
    # Groups of about 1,000 rows; a cell of at most CELL rows is never cut.
    groups = max(spark.sparkContext.defaultParallelism, listed.count() // 1_000)
    inside = (
        listed.filter(F.col("crowded").isNull())
        .select("print", "cell", F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("g"))
        .groupBy("g")
        .applyInPandas(lambda frame: _linked_in_cells(frame), "a bigint, b bigint")
    )
    near = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
    meeting = (
        listed.filter("crowded").select("print").distinct().select("print", F.explode(near).alias("word"))
        .groupBy("word")
        .agg(F.min("print").alias("least"), F.collect_list("print").alias("prints"))
        .filter(F.size("prints") > 1)
        .select(F.explode("prints").alias("a"), F.col("least").alias("b"))
        .filter("a != b")
        .distinct()
    )
    return inside.unionByName(meeting)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def near_duplicates(documents: DataFrame, run: int = 3, key: bool = False) -> DataFrame:
    """`<doc_id, fingerprint, component_id>` for every row of `<doc_id, text>`, with `key` also `<text_key, root>`.

    `fingerprint` has 16 hex digits; `component_id` is the smallest doc_id that links reach, itself included; `root` is
    the smallest fingerprint of the component and names it even where no row has an id.
    """
    prints = fingerprints(documents, run)
    prints = materialize(prints if key else prints.drop("text_key"), "fingerprints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct)).select(F.col("node").alias("print"), "root")
    placed = distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "root").select("print", "component_id", "root")
    return prints.join(placed, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        *(["text_key", "root"] if key else []),
    )


@query("op3_simhash")
def op3_simhash(spark, folder):
    return near_duplicates(spread(table(spark, folder, "documents", "doc_id", "text")))
