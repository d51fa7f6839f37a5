r"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node stands for the sequence of turns that leads to it. A sequence's digest combines 128 bits per (place, role, text) by
exclusive or, so all prefixes of all conversations get theirs from one ordered pass, however long a conversation is. Rows with
one digest are members of one node; their counts are combined before they are shuffled.

Subtrees with at most `SHARD_ROWS` member rows become shards. A shard gives each of its digests a slot by a minimal perfect hash:
in rounds, every digest that is alone at its place in a sparse array keeps it, the rest go on with another seed, and
kept places are numbered through. A lookup compares the digest in the slot, so a digest of another shard is never taken for
one of this shard. Counts are scattered into flat arrays by slot, a parent-slot array links them, and sums run from the
deepest nodes up. Nodes above all shards are few and go the same way, in bands of `BAND` depths, the lowest band first, with the sums
of the shards below as what they start from.

Defined cases: rows without a conv_id belong to no conversation; null role and text are empty; turns without a number come
first; rows with one turn number are ordered by role, then by a digest of the text; repeated rows are repeated turns; a
table without conversations has no nodes, not even a root; other columns are ignored. Different sequences share a
digest with a chance of about the square of their number in 2 ** 129.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.merkle import SQL_CRC32
from llm.ordered import running
from llm.registry import query, table
from llm.words import mix
from tagloom.session import materialize, spread

EVERY = 20  # conversations that share the first turns of one
HEADS = 4  # how many first turns: fewer than this
WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = 1 << 14
BAND = 1 << 12
PIECE = 4_096  # conversation numbers per hashed piece


# --- slots -----------------------------------------------------------------------------------------


class Slots:
    """Minimal perfect hash of distinct 128-bit digests, given as two columns of 64 bits."""

    SPARSE = 2  # places per digest in a round

    def __init__(self, digests: np.ndarray):
        self.digests = digests
        self.rounds: list[tuple[np.ndarray, int]] = []  # slot by place, -1 if none, and the first free slot behind
        left, slot = np.arange(len(digests)), 0
        self.order = np.empty(len(digests), np.int64)  # digest in each slot
        while len(left):
            if len(self.rounds) == 64:
                raise ValueError("digests are not distinct")
            size = self.SPARSE * len(left) + 1
            at = self._place(digests[left], len(self.rounds), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            slots = np.full(size, -1, np.int64)
            kept = np.flatnonzero(alone)
            slots[at[kept]] = slot + np.arange(len(kept))
            self.order[slot : slot + len(kept)] = left[kept]
            self.rounds.append((slots, slot + len(kept)))
            left, slot = left[~alone], slot + len(kept)

    @staticmethod
    def _place(digests: np.ndarray, number: int, size: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) & (2**64 - 1))
        return (mix(mix(digests[:, 0] ^ seed) + digests[:, 1]) % np.uint64(size)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for those that have none."""
        out = np.full(len(digests), -1, np.int64)
        open_rows = np.arange(len(digests))
        for number, (slots, _) in enumerate(self.rounds):
            at = slots[self._place(digests[open_rows], number, len(slots))]
            found = at >= 0
            same = (self.digests[self.order[at[found]]] == digests[open_rows[found]]).all(axis=1)
            out[open_rows[found][same]] = at[found][same]
            going_on = np.ones(len(open_rows), bool)
            going_on[np.flatnonzero(found)[same]] = False
            open_rows = open_rows[going_on]
        return out


def accumulate(shard: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over subtrees of the nodes of a shard, in slot order.

    Takes `node` and `parent` (digests), `depth`, `conv_id`, `n_convs`, `words`, and `below_children`, `below_leaves`,
    `below_saved`: what children outside the shard bring.
    """
    slots = Slots(shard["node"])
    n = len(slots.order)
    at = np.empty(n, np.int64)
    at[slots.order] = np.arange(n)  # the nodes' slots

    def scattered(name: str, kind=np.int64) -> np.ndarray:
        flat = np.zeros(n, kind)
        flat[at] = shard[name]
        return flat

    parents = np.empty_like(shard["parent"])
    parents[at] = shard["parent"]
    depth, conv, n_convs = scattered("depth"), scattered("conv_id"), scattered("n_convs")
    parent = np.where(depth > 0, slots.lookup(parents), -1)
    children, leaves, saved = (scattered(f"below_{x}") for x in ("children", "leaves", "saved"))
    saved = saved + (n_convs - 1) * scattered("words")
    inner = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[inner], 1)
    leaves = leaves + (children == 0)
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges):  # deepest first
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    own = np.empty_like(shard["node"])
    own[at] = shard["node"]
    return {
        "node": own,
        "parent": parents,
        "inner": parent >= 0,
        "depth": depth,
        "conv_id": conv,
        "parent_conv_id": np.where(parent >= 0, conv[np.maximum(parent, 0)], 0),
        "n_convs": n_convs,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
    }


# --- rows of conversations ---------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """`<conv_id, place, a, b, words>` per turn: its place from 0 on, its digest and the words of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role tells where it ends.
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    placed = running(materialize(rows, "turns"), "conv_id", ["turn", "role", "key"])
    a, b = _halves(F.col("key"))
    return placed.select("conv_id", "place", a.alias("a"), b.alias("b"), "words")


def _halves(key: Column) -> tuple[Column, Column]:
    """128 bits in hex as two integers of 64."""
    # Eight digits at a time fit an integer; the upper ones may wrap into the sign.
    words = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    return tuple(F.shiftleft(words[i], 32).bitwiseOR(words[i + 1]) for i in (0, 2))


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """`<conv_id, depth, a, b, words>`: every conversation's shared first turns, then its own; depth 0 is the root."""
    conv, h = F.col("conv_id"), head_length(F.col("conv_id"))
    zero = F.lit(0).cast("bigint")
    heads = turns.filter((conv % EVERY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("length"))
    convs = turns.filter("place = 0").select("conv_id", (conv - conv % EVERY).alias("base"), h.alias("h"))
    convs = convs.join(lengths, "base", "left").withColumn("length", F.coalesce("length", zero))
    shared = convs.filter("h > 0").join(heads, "base").filter(F.col("place") < F.col("h"))
    # Own turns move up where the shared conversation has fewer turns than its place is.
    short = convs.filter(F.col("length") < F.col("h")).select("conv_id", (F.col("h") - F.col("length")).alias("missing"))
    own = turns.filter(F.col("place") >= h).join(short, "conv_id", "left")
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "words")])
    return reduce(
        DataFrame.unionByName,
        [
            roots,
            shared.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words"),
            own.select("conv_id", (F.col("place") + 1 - F.coalesce("missing", zero)).alias("depth"), "a", "b", "words"),
        ],
    )


def paths(conversations: DataFrame) -> DataFrame:
    """`<conv_id, depth, a, b, pa, pb, words>`, stored: the nodes that each rebuilt conversation passes, with the digests of
    the nodes above them."""
    turns = materialize(numbered_turns(conversations), "numbered-turns")
    # A turn counts with its place, so the same turns in another order are another sequence.
    own = {x: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(x), "depth", "a", "b")).cast("bigint") for x in "ab"}
    rows = materialize(rebuilt(turns).withColumns(own), "rebuilt")
    placed = running(rows, "conv_id", ["depth"], ["a", "b"])
    return materialize(
        placed.select(
            "conv_id",
            "depth",
            F.col("a_running").alias("a"),
            F.col("b_running").alias("b"),
            F.col("a_running").bitwiseXOR(F.col("a")).alias("pa"),
            F.col("b_running").bitwiseXOR(F.col("b")).alias("pb"),
            "words",
        ),
        "paths",
    )


# --- nodes -------------------------------------------------------------------------------------------

_KINDS = (
    "a bigint, b bigint, pa bigint, pb bigint, inner boolean, depth bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
)
_BELOW = ["children", "leaves", "saved"]


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of one shard with the sums of their subtrees."""
    columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("bucket", "heavy")}
    done = accumulate(
        {
            "node": np.stack([columns["a"], columns["b"]], axis=1).view(np.uint64),
            "parent": np.stack([columns["pa"], columns["pb"]], axis=1).view(np.uint64),
            **{c: columns[c] for c in ("depth", "conv_id", "n_convs", "words", *[f"below_{x}" for x in _BELOW])},
        }
    )
    node, parent = done.pop("node").view(np.int64), done.pop("parent").view(np.int64)
    return pa.table({"a": node[:, 0], "b": node[:, 1], "pa": parent[:, 0], "pb": parent[:, 1], **done})


def _sums(nodes: DataFrame) -> DataFrame:
    """`<a, b, below_..>`: what nodes whose parent is in no shard of theirs bring to that parent."""
    tops = nodes.filter("NOT inner AND depth > 0")
    return tops.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved")
    )


def _with_sums(nodes: DataFrame, below: DataFrame) -> DataFrame:
    joined = nodes.drop(*[f"below_{x}" for x in _BELOW]).join(below, ["a", "b"], "left")
    return joined.fillna(0, [f"below_{x}" for x in _BELOW])


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """`<a, b, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256>` per node of the trie of
    rebuilt conversations; a and b are its digest."""
    rows = paths(conversations)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    ends = materialize(ends.select("conv_id", F.col("end.depth").alias("length"), "end.a", "end.b"), "ends")
    left = F.sum(F.col("length") - F.col("depth") + 1).alias("rows")  # member rows of the subtree
    nodes = rows.join(ends.select("conv_id", "length"), "conv_id").groupBy("a", "b").agg(
        F.min("depth").alias("depth"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        left,
    )
    zero = F.lit(0).cast("bigint")
    nodes = nodes.select("*", (F.col("rows") > shard_rows).alias("heavy"), *[zero.alias(f"below_{x}") for x in _BELOW])
    nodes = materialize(nodes, "nodes")
    size = nodes.agg(F.sum("n_convs").alias("rows"), F.max(F.when(F.col("heavy"), F.col("depth"))).alias("deepest")).first()
    heavy = nodes.filter("heavy").drop("rows", "heavy")

    # A conversation's first node that is not heavy names the shard of all its lower ones.
    flagged = rows.select("conv_id", "depth", "a", "b").join(heavy.select("a", "b", F.lit(True).alias("heavy")), ["a", "b"], "left")
    first = F.min(F.when(F.col("heavy").isNull(), F.struct("depth", "a", "b")))
    homes = flagged.groupBy("conv_id").agg(first.alias("home")).filter("home IS NOT NULL")
    buckets = max(1, -(-(size["rows"] or 0) // shard_rows))
    bucket = F.pmod(F.xxhash64("home.a", "home.b"), F.lit(buckets)).alias("bucket")
    light = nodes.filter("NOT heavy").drop("rows", "heavy").join(homes.select("conv_id", bucket), "conv_id")
    light = materialize(light.groupBy("bucket").applyInArrow(_shard, _KINDS), "light-nodes")

    done, carried = [], _sums(light)
    lowest = -1 if size["deepest"] is None else size["deepest"] // band
    for number in range(lowest, -1, -1):
        # Only shards and the band below have tops whose parents are in this band.
        own = _with_sums(heavy.filter(F.floor(F.col("depth") / band) == number), carried)
        own = materialize(own.withColumn("bucket", F.lit(0)).groupBy("bucket").applyInArrow(_shard, _KINDS), "heavy-nodes")
        done.append(own)
        carried = _sums(light.unionByName(own))
    out = reduce(DataFrame.unionByName, [light, *done])
    # Parents that lie in another shard are heavy.
    above = heavy.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    tops = out.filter("NOT inner").join(above, ["pa", "pb"], "left")
    tops = tops.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("above"))).drop("above")
    out = out.filter("inner").unionByName(tops)
    hashed = out.join(ends_hashes(ends), ["a", "b"], "left")
    return hashed.select(
        "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


# --- conversations that end at a node ------------------------------------------------------------------


def _groups(batch, keys: list[str]):
    """(first row, row after the last) of runs with equal keys."""
    values = [batch.column(c).to_numpy() for c in keys]
    differ = reduce(np.logical_or, [v[1:] != v[:-1] for v in values]) if len(batch) else np.zeros(0, bool)
    edges = [0, *(np.flatnonzero(differ) + 1).tolist(), len(batch)]
    return zip(edges[:-1], edges[1:], strict=True) if len(batch) else ()


def _pieces(batches):
    """Numbers of a node joined by commas, at most PIECE of them in one piece."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        out = []
        for start, stop in _groups(batch, ["a", "b"]):
            a, b = batch.column("a")[start].as_py(), batch.column("b")[start].as_py()
            for at in range(start, stop, PIECE):
                out.append((a, b, ids[at], ",".join(map(str, ids[at : min(stop, at + PIECE)]))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            if out
            else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())],
            names=["a", "b", "first", "ids"],
        )


def _hashed(batches):
    """Digest of the pieces of a node, one after the other; memory holds one piece."""
    key, state = None, None
    out: list[tuple] = []

    def batch_of(rows):
        a, b, shas = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shas)], names=["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if (a, b) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield batch_of(out)
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch_of(out)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """`<a, b, ends_sha256>` for nodes at which conversations end: their numbers, ascending and joined by commas."""
    order = ["a", "b", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "a bigint, b bigint, first bigint, ids string"
    )
    order = ["a", "b", "first"]
    return pieces.repartition("a", "b").sortWithinPartitions(*order).mapInArrow(_hashed, "a bigint, b bigint, ends_sha256 string")


# --- query -----------------------------------------------------------------------------------------

SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(concat(strlen(coalesce(role, '')), ':', role, text))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {SQL_CRC32.format('conv_id::VARCHAR')} % {HEADS} AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {EVERY} AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
n AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS path,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
m AS (SELECT conv_id, depth, path, substr(path, 1, (depth - 1) * 64) AS above, words FROM n
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
l AS (SELECT conv_id, max(depth) AS length FROM m GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY path),
kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT substr(path, 1, d * 64) AS path, sum(saved) AS saved_tokens,
    count(*) FILTER (WHERE path NOT IN (SELECT path FROM kids)) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) GROUP BY substr(path, 1, d * 64))
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.path = v.above LEFT JOIN kids k ON k.path = v.path JOIN below b ON b.path = v.path
"""


@query("op12_trie", SQL)
def op12_trie(spark, folder):
    return trie(spread(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))).drop("a", "b")
