r"""Interpolated modified Kneser-Ney n-gram model in sorted hash arrays.

Tokens are words after folding A-Z, then one end per text; `order - 1` begin marks stand in front of a text. The corpus is read twice:
first for the words, which are numbered in the order of their hashes, then for its n-grams as tuples of numbers. Tasks count
their own part in arrays and send blocks of them by shard, the upper bits of a hash, so a shard has its share of all n-grams and a
frequent n-gram is one entry per task. A shard's task adds the counts up, stores them as arrays sorted by hash, and sends on

* for the next lower order, how many different words stand in front of each shorter n-gram (its occurrences instead if it
  begins with a begin mark, since nothing stands there),
* for each context, the sum of its counts and how many of them are one, two and more.

Arrays lie in the shared folder as one file per shard and column. Workers map them into memory and look up the sorted queries of a
block of texts, so a worker holds no part of the model, only pages that the system may drop. Nothing is pruned.

An n-gram's probability is its count less a discount over its context's sum, plus the weight that the discounts free times the
probability in the next lower order; below the words lies the same share for each of them and one for all unknown words.
Discounts follow from the numbers of n-grams with counts 1 to 4, per order; where those give none (few or odd counts), 0.5, 1 and 1.5
are taken.

Defined cases: null and empty texts have the end alone; without any text to learn from all tokens are unknown and have
probability 1; rows with one id are judged by their own text, repeated rows count as often as they occur; rows without an id
are learned from and not held out; other columns are ignored. Words are told apart by 64 bits (any two of n words
are mistaken with a chance below n ** 2 / 2 ** 65), n-grams of three and more words likewise, pairs exactly.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from llm.words import BLANKS, blocks, byte_classes, mix, split, word_hashes
from tagloom.session import materialize, new_path, spread

# Pairs of words: a third word takes the stored arrays beyond the disk that the check tool allows; see README.
ORDER = 2
HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 1"

FOLDED = byte_classes(BLANKS, fold=True)
FOLDED[0] = 0xFF
END = np.uint64(0xE4D0F7E87EED0001)  # stands for the end of a text among the hashes of words
BLOCK_BYTES = 1 << 21
STEP = np.uint64(0xD6E8FEB86659FD93)
HELD = 1 << 20  # entries that a task counts before it sends them; merging takes some 80 bytes for each
PIECE = 1 << 17  # entries in one row
SHARD_TOKENS = 1 << 21  # tokens of the corpus per shard of n-grams; adding up takes some 120 bytes for each


# --- keys and arrays ---------------------------------------------------------------------------------


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits per tuple of word numbers below 2 ** 32; one to one up to two words."""
    if len(columns) == 1:
        return mix(columns[0].astype(np.uint64) + np.uint64(1))
    key = mix((columns[0].astype(np.uint64) << np.uint64(32)) | columns[1].astype(np.uint64))
    for column in columns[2:]:
        key = mix(key * STEP + column.astype(np.uint64))
    return key


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the keys, first place of each distinct key in it)"""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _added(key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]):
    """Entries with one key added up: (keys ascending, columns, sums)"""
    order, first = _runs(key)
    if len(first) == 0:
        return key, columns, values
    return key[order[first]], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) for v in values]


def _planes(arrays: list[np.ndarray]) -> bytes:
    """Bytes of equal weight side by side, so that the upper, mostly zero ones take next to no room once compressed."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def _unplaned(data: bytes, n: int, kind) -> list[np.ndarray]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(-1, width, n)
    return [np.ascontiguousarray(p.T).view(kind).reshape(n) for p in planes]


_BLOCK = "kind string, shard int, n int, tuples binary, vals binary"
_BLOCK_ARROW = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("n", pa.int32()), ("tuples", pa.binary()), ("vals", pa.binary())]
)


def _shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _pieces(kind: str, key: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], bits: int):
    """Rows of entries by shard; `key` is ascending. Inside a piece entries are sorted by their first number."""
    edges = np.searchsorted(_shard_of(key, bits), np.arange((1 << bits) + 1))
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        for at in range(edges[shard], edges[shard + 1], PIECE):
            part = slice(at, min(at + PIECE, edges[shard + 1]))
            order = np.argsort(columns[0][part], kind="stable")
            tuples = _planes([c[part][order] for c in columns])
            yield (kind, shard, len(order), tuples, _planes([v[part][order].astype(np.uint64) for v in values]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_BLOCK_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)


def _read_pieces(table: pa.Table, tuple_kind) -> tuple[list[np.ndarray], list[np.ndarray]]:
    tuples, values = [], []
    for n, t, v in zip(*(table.column(c).to_pylist() for c in ("n", "tuples", "vals")), strict=True):
        tuples.append(_unplaned(t, n, tuple_kind))
        values.append(_unplaned(v, n, np.uint64))
    return [np.concatenate(c) for c in zip(*tuples, strict=True)], [np.concatenate(c) for c in zip(*values, strict=True)]


def _store(folder: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """One file per array. A task that runs again puts the same files in place of the first ones."""
    os.makedirs(folder, exist_ok=True)
    for name, array in arrays.items():
        if array.dtype == np.uint64 and name != "key":
            array = array.astype(np.min_scalar_type(int(array.max(initial=0))))
        path = f"{folder}/{name}-{shard}.npy"
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            np.save(file, array)
        os.replace(own, path)


@dataclass
class Arrays:
    """Sorted keys and columns beside them, in one file per shard each, mapped into memory where they are looked up."""

    folder: str
    bits: int
    sizes: list[int]  # per shard; 0 where there are no files
    open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def part(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self.open:
            self.open[name, shard] = np.load(f"{self.folder}/{name}-{shard}.npy", mmap_mode="r")
        return self.open[name, shard]

    def lookup(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """For ascending keys: their places over all shards, -1 for unknown ones, and the named columns, 0 for unknown ones."""
        places = np.full(len(keys), -1, np.int64)
        out = [np.zeros(len(keys), np.int64) for _ in names]
        edges = np.searchsorted(_shard_of(keys, self.bits), np.arange((1 << self.bits) + 1))
        base = np.cumsum([0, *self.sizes])
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            if not self.sizes[shard]:
                continue
            part = slice(edges[shard], edges[shard + 1])
            stored = self.part("key", shard)
            at = np.minimum(np.searchsorted(stored, keys[part]), len(stored) - 1)
            found = stored[at] == keys[part]
            places[part] = np.where(found, at + base[shard], -1)
            for column, name in zip(out, names, strict=True):
                column[part] = np.where(found, self.part(name, shard)[at], 0)
        return [places, *out]


# --- counting ----------------------------------------------------------------------------------------


def _tokens(data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens of a block, the text of each, its place in the text)"""
    found = split(data, offsets, FOLDED)
    hashes = word_hashes(found) if len(found.start) else np.zeros(0, np.uint64)
    hashes = np.insert(hashes, found.first[1:], END)
    counts = np.diff(found.first) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    return hashes, row, np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Counter:
    """Entries counted in arrays, sent when there are many."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, key, columns, values):
        """Rows to send, if any."""
        self.held.append(_added(key, columns, values))
        self.size += len(self.held[-1][0])
        if self.size < HELD:
            return
        self._merge()
        if self.size >= HELD // 2:
            yield from self.flush()

    def _merge(self):
        keys, columns, values = zip(*self.held, strict=True)
        merged = _added(
            np.concatenate(keys),
            [np.concatenate(c) for c in zip(*columns, strict=True)],
            [np.concatenate(v) for v in zip(*values, strict=True)],
        )
        self.held, self.size = [merged], len(merged[0])

    def flush(self):
        if self.held:
            self._merge()
            yield from _pieces("gram", *self.held[0], self.bits)
        self.held, self.size = [], 0


def _count(batches, bits, entries):
    """Blocks of rows for what `entries` (of a block of texts) returns: keys, columns, values."""
    counter = _Counter(bits)
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
            rows = list(counter.add(*entries(data, offsets)))
            if rows:
                yield _batch(rows)
    for row in counter.flush():
        yield _batch([row])


def _word_entries(data, offsets):
    hashes, _, _ = _tokens(data, offsets)
    return hashes, [hashes], [np.ones(len(hashes), np.uint64)]


def numbered(words: Arrays, hashes: np.ndarray, *names: str) -> list[np.ndarray]:
    """Number of each token and the named columns; unknown words have the number behind the begin mark's."""
    distinct, at = np.unique(hashes, return_inverse=True)
    places, *columns = words.lookup(distinct, *names)
    places = np.where(places < 0, sum(words.sizes) + 1, places)
    return [x[at] for x in (places, *columns)]


def tuples_of(numbers: np.ndarray, place: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, as one array per word."""
    columns = []
    for back in range(order - 1, 0, -1):
        shifted = np.concatenate([np.full(min(back, len(numbers)), begin), numbers[: max(0, len(numbers) - back)]])
        columns.append(np.where(place >= back, shifted, begin).astype(np.uint32))
    return [*columns, numbers.astype(np.uint32)]


def _gram_entries(words: Arrays, order: int):
    begin = sum(words.sizes)

    def entries(data, offsets):
        hashes, _, place = _tokens(data, offsets)
        columns = tuples_of(numbered(words, hashes)[0], place, order, begin)
        return key_of(columns), columns, [np.ones(len(hashes), np.uint64)]

    return entries


def _meta(shard: int, n: int, counts: np.ndarray) -> tuple:
    """A row for the driver: entries, sum, and how many have the counts 1 to 4."""
    few = [int((counts == k).sum()) for k in range(1, 5)]
    return ("meta", shard, n, b"", np.array([n, int(counts.sum()), *few], np.uint64).tobytes())


def _store_grams(folder: str, begin: int | None, bits: int, kind):
    """Function of a shard's rows: add them up, store them, send what the next lower order and the contexts need."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        columns, (counts,) = _read_pieces(table, kind)
        key = columns[0] if begin is None else key_of(columns)
        key, columns, (counts,) = _added(key, columns, [counts])
        _store(folder, shard, {"key": key, "count": counts})
        rows = [_meta(shard, len(key), counts)]
        if len(columns) > 1:
            in_front = np.where(columns[1] == begin, counts, np.uint64(1))
            rows += _pieces("gram", *_added(key_of(columns[1:]), columns[1:], [in_front]), bits)
            few = [(counts == 1), (counts == 2), (counts > 2)]
            parts = _added(key_of(columns[:-1]), columns[:-1], [counts, *[x.astype(np.uint64) for x in few]])
            rows += _pieces("context", *parts, bits)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _store_contexts(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        columns, values = _read_pieces(table, np.uint32)
        key, _, values = _added(key_of(columns), columns, values)
        _store(folder, shard, dict(zip(("key", "total", "one", "two", "more"), (key, *values), strict=True)))
        return pa.Table.from_batches([_batch([_meta(shard, len(key), values[0])])])

    return run


def _gathered(rows: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """Entries per shard, and the sum of what the shards say: (entries, sum, ones, twos, threes, fours)."""
    sizes, total = {}, np.zeros(6, np.int64)
    for row in rows.filter("kind = 'meta'").select("shard", "n", "vals").collect():  # one small row per shard
        sizes[row["shard"]] = row["n"]
        total += np.frombuffer(row["vals"], np.uint64).astype(np.int64)
    return sizes, total


def _arrays(folder: str, bits: int, sizes: dict[int, int]) -> Arrays:
    return Arrays(folder, bits, [sizes.get(shard, 0) for shard in range(1 << bits)])


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """What counts of 0, 1, 2 and more lose."""
    if min(ones, twos, threes, fours) > 0:
        y = ones / (ones + 2 * twos)
        found = [0.0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes]
        if all(0 <= found[k] <= k for k in (1, 2, 3)):
            return found
    return [0.0, 0.5, 1.0, 1.5]


@dataclass
class Model:
    """What is small of a fitted model; the arrays lie in the shared folder."""

    order: int
    tokens: int
    words: Arrays
    grams: list[Arrays]  # by order, from 1 on
    contexts: list[Arrays | None]  # of the n-grams of each order; those of order 1 are below
    discounts: list[list[float]]
    total: int  # of the counts of order 1
    few: list[int]  # how many of them are 1, 2 and more

    @property
    def n_words(self) -> int:
        return sum(self.words.sizes)


def _bits(parts: int) -> int:
    return max(0, (max(1, parts) - 1).bit_length())


def mapped_folder(spark, name: str) -> str:
    """A new folder below the shared one, by the path under which tasks see it."""
    path = urlparse(new_path(spark, name))
    if path.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory, {path.scheme}: can't be; give a folder that all executors have mounted")
    return path.path


def fit(texts: DataFrame, order: int = ORDER, folder: str | None = None) -> Model:
    """Model of the `text` column. `folder` (default: a new one in the shared folder) must be mounted by every executor."""
    if order < 2:
        raise ValueError("the model needs n-grams of two words at least")
    spark = texts.sparkSession
    folder = folder or mapped_folder(spark, "ngrams")
    texts = texts.select("text")

    bits = _bits(2 * texts.rdd.getNumPartitions())
    counted = texts.mapInArrow(lambda batches: _count(batches, bits, _word_entries), _BLOCK)
    stored = counted.groupBy("shard").applyInArrow(_store_grams(f"{folder}/words", None, 0, np.uint64), _BLOCK)
    sizes, (_, tokens, *_) = _gathered(materialize(stored, "ngrams-meta"))
    words = _arrays(f"{folder}/words", bits, sizes)
    begin = sum(words.sizes)
    if begin >= 1 << 32:
        raise ValueError(f"{begin} different words; their numbers have 32 bits")

    bits = _bits(-(-int(tokens) // SHARD_TOKENS))
    rows = texts.mapInArrow(lambda batches: _count(batches, bits, _gram_entries(words, order)), _BLOCK)
    grams, contexts, lost = [], [], []
    for level in range(order, 0, -1):
        own = f"{folder}/grams-{level}"
        stored = rows.filter("kind = 'gram'").groupBy("shard").applyInArrow(_store_grams(own, begin, bits, np.uint32), _BLOCK)
        rows = materialize(stored, f"ngrams-{level}")
        sizes, (_, total, *few) = _gathered(rows)
        grams.insert(0, _arrays(own, bits, sizes))
        lost.insert(0, discounts(*map(int, few)))
        if level > 1:
            own = f"{folder}/contexts-{level}"
            stored = rows.filter("kind = 'context'").groupBy("shard").applyInArrow(_store_contexts(own), _BLOCK)
            sizes, _ = _gathered(materialize(stored, "ngrams-meta"))
            contexts.insert(0, _arrays(own, bits, sizes))
    n = sum(grams[0].sizes)
    return Model(order, int(tokens), words, grams, [None, *contexts], lost, int(total), [int(few[0]), int(few[1]), n - int(few[0]) - int(few[1])])


# --- scoring -----------------------------------------------------------------------------------------


def _discounted(counts: np.ndarray, lost: list[float]) -> np.ndarray:
    return counts - np.array(lost)[np.minimum(counts, 3)]


def _looked_up(arrays: Arrays, key: np.ndarray, *names: str) -> list[np.ndarray]:
    distinct, at = np.unique(key, return_inverse=True)
    return [x[at] for x in arrays.lookup(distinct, *names)[1:]]


def probabilities(model: Model, numbers: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Probability of each token after those in front of it."""
    columns = tuples_of(numbers, place, model.order, model.n_words)
    lost = model.discounts[0]
    even = 1.0 / (model.n_words + 1)
    if model.total == 0:
        return np.full(len(numbers), even)
    (counts,) = _looked_up(model.grams[0], key_of(columns[-1:]), "count")
    p = _discounted(counts, lost) / model.total + np.dot(lost[1:], model.few) / model.total * even
    for level in range(2, model.order + 1):
        own, lost = columns[-level:], model.discounts[level - 1]
        (counts,) = _looked_up(model.grams[level - 1], key_of(own), "count")
        total, *few = _looked_up(model.contexts[level - 1], key_of(own[:-1]), "total", "one", "two", "more")
        freed = sum(a * b for a, b in zip(lost[1:], few, strict=True))
        known = np.maximum(total, 1)
        p = np.where(total > 0, _discounted(counts, lost) / known + freed / known * p, p)
    return p


def _score(batches, model: Model):
    scale = model.tokens + 0.5 * (model.n_words + 1)
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
            hashes, row, place = _tokens(data, offsets)
            numbers, counts = numbered(model.words, hashes, "count")
            known = np.bincount(row, counts > 0, b - a).astype(np.int64)
            base = np.bincount(row, np.log10((counts + 0.5) / scale), b - a)
            score = np.bincount(row, np.log10(probabilities(model, numbers, place)), b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(np.bincount(row, minlength=b - a).astype(np.int64)),
                    pa.array(known),
                    pa.array(base),
                    pa.array(score),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """`<doc_id, n_tokens, n_known, base_score, score>`: log10 probabilities of each text, by single words and by the model.

    Perplexity is `10 ** (-score / n_tokens)`.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _score(batches, model), schema)


def is_held_out() -> Column:
    return F.coalesce(F.expr(HELD_OUT), F.lit(False))


@query("op11_kneser_ney")
def op11_kneser_ney(spark, folder):
    documents = spread(table(spark, folder, "documents", "doc_id", "text"))
    model = fit(documents.filter(~is_held_out()))
    return scored(documents, model).select(
        "doc_id",
        is_held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
