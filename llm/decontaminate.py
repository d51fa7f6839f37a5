"""Benchmark decontamination by winnowing.

A window is ten consecutive words. Of the hashes of its runs of `k` words the smallest is its fingerprint,
so two windows with equal words have equal fingerprints, and every shared span of ten words or more shares
at least one. Benchmark fingerprints go into a bitmap of fixed size. Documents are read once and keep the
windows whose fingerprint may be in it; these meet the benchmark's windows on the fingerprint and are
extended to the whole window by comparing its words, so hash collisions never count.

Defined cases: null and empty texts have no words; an item of fewer than ten words is one window of its own
length; repeated windows count once; rows with the same id and text give equal results; a null doc_id stays
null and a null item_id is left out of the list of items; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from llm.rows import join_rows, text_key
from llm.words import LETTERS, blocks, run_hashes, sliding_min, split, word_hashes
from tagloom.session import materialize, spread

WINDOW = 10
RUN = 6  # words in a fingerprint's run; a window has WINDOW - RUN + 1 of them
BITMAP_BITS = 24

_SPAN = pa.struct([("start", pa.int64()), ("len", pa.int32()), ("print", pa.int64()), ("words", pa.string())])


def _prints(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the window of `length` words at each place."""
    run = min(RUN, length)
    return sliding_min(run_hashes(hashes, run), length - run + 1)


def _windows(batch_texts, lengths, known):
    """Per text: number of words and its windows, all of them or those whose fingerprint is in `known`.

    `lengths` None: windows of an item, that is WINDOW words or the whole item if it has fewer.
    """
    for a, b, data, offsets in blocks(batch_texts):
        found = split(data, offsets, LETTERS)
        counts = np.diff(found.first)
        spans: list[list] = [[] for _ in range(b - a)]
        if len(found.start):
            hashes = word_hashes(found)
            own = lengths or sorted({WINDOW, *(int(n) for n in counts if 0 < n < WINDOW)})
            for length in own:
                prints = _prints(hashes, length)
                n = len(prints)
                keep = found.row[:n] == found.row[length - 1 : length - 1 + n]
                if lengths is None and length < WINDOW:
                    keep &= counts[found.row[:n]] == length
                if known is not None:
                    low = (prints & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                    keep &= (known[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                for i in np.flatnonzero(keep).tolist():
                    row = int(found.row[i])
                    spans[row].append(
                        {
                            "start": i - int(found.first[row]),
                            "len": length,
                            "print": int(prints[i : i + 1].view(np.int64)[0]),
                            "words": found.text(i, i + length).decode("utf-8", "replace"),
                        }
                    )
        yield counts, spans


def _scan(df: DataFrame, id_column: str, lengths, known) -> DataFrame:
    """`<id, text_key, n_words, spans>`"""

    def run(batches):
        for batch in batches:
            at = 0
            for counts, spans in _windows(batch.column("text"), lengths, known):
                part = batch.slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_column),
                        part.column("text_key"),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(_SPAN)),
                    ],
                    names=[id_column, "text_key", "n_words", "spans"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    schema = (
        f"{id_column} {kind}, text_key string, n_words bigint, "
        "spans array<struct<start:bigint,len:int,print:bigint,words:string>>"
    )
    return df.select(id_column, "text", text_key().alias("text_key")).mapInArrow(run, schema)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """`<item_id, print, len, words>`: distinct windows of `<item_id, text>`."""
    return (
        _scan(benchmark, "item_id", None, None)
        .select("item_id", F.explode("spans").alias("s"))
        .select("item_id", "s.print", "s.len", "s.words")
        .distinct()
    )


def bitmap(windows: DataFrame) -> np.ndarray:
    """2 ** BITMAP_BITS bits, set for the low bits of every fingerprint: 2 MB for a benchmark of any size."""
    place = F.col("print").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1
    rows = (
        windows.select(place.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << BITMAP_BITS) >> 3, np.uint8)
    for row in rows:
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["part"] - 1) * 4096 :][: len(bits)] = bits
    return out


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of `<doc_id, text>` inside windows of `<item_id, text>`.

    Gives `<doc_id, text_key, n_words, n_hit, n_items, items, contaminated, spans>`; `items` are the sorted
    ids as strings, `spans` the hit windows as `<start, len>` in words.
    """
    windows = materialize(benchmark_windows(benchmark), "benchmark-windows")
    lengths = sorted({WINDOW, *(row["len"] for row in windows.select("len").distinct().collect())})
    scanned = materialize(_scan(documents, "doc_id", lengths, bitmap(windows)), "document-windows")
    return _hits(scanned, windows)


def _hits(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    key = ["doc_id", "text_key"]
    found = (
        scanned.select(*key, F.explode("spans").alias("s"))
        .select(*key, "s.start", "s.len", "s.print", "s.words")
        .join(windows.select("print", "words").distinct(), ["print", "words"], "left_semi")
        .distinct()
    )
    found = materialize(found, "hits")
    spans = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("hit_spans"))
    # Sorted by start; the part of each window beyond everything before it is new.
    new = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, s: F.struct(
            (
                acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["to"], s["start"]))
            ).cast("bigint").alias("n"),
            F.greatest(acc["to"], s["start"] + s["len"]).cast("bigint").alias("to"),
        ),
        lambda acc: acc["n"],
    )
    spans = spans.withColumn("n_hit", new)
    items = (
        found.select(*key, "print", "words").distinct()
        .join(windows.select("print", "words", "item_id"), ["print", "words"])
        .filter(F.col("item_id").isNotNull())
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    joined = join_rows(join_rows(scanned.drop("spans"), spans, key), items, key)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        *key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        items.alias("items"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start:bigint,len:int>>")).alias("spans"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len, list_slice(w, i, i + len - 1) AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (
  SELECT doc_id, i, len, list_slice(w, i, i + len - 1) AS win
  FROM (SELECT doc_id, w, lens.len AS len, unnest(range(1, len(w) - lens.len + 2)) AS i
        FROM d JOIN lens ON len(w) >= lens.len)),
hit AS (SELECT dw.doc_id, dw.i, dw.len, bw.item_id FROM dw JOIN bw USING (len, win)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_decontaminate", SQL)
def op9_decontaminate(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    out = contamination(documents, table(spark, folder, "benchmark", "item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
