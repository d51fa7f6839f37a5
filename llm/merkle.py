"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, rows of a language are a tree of runs of eight, and the roots of the languages are a tree again. A node's
label is (end of the leaves below it, height), so children come before parents in label order. Two sweeps go along the
labels:

* forward, a priority queue ordered by label delivers digests to parents: a node takes the messages under its label,
  hashes them and sends the result on;
* backward, a queue in reversed order delivers to every child the digests beside it, followed by what its parent got: the
  end of its proof. What arrives at a leaf is its whole proof.

The queue is external: Spark cuts a tree into blocks of `8 ** HEIGHT` neighbours, sorts their messages by block and label on
disk, and a task streams one block after the other through a heap, which in label order holds at most seven messages
per height. Tops of blocks are the entries of the next round, so a table takes one round per factor of 4,096. Proofs are used
where they arrive: they are only moved if asked for.

Defined cases: a null language is a tree of its own, before all others; null ids come first; rows with one id are ordered by
their digest, and equal rows have equal results; null fields count as `-`; a lone leaf is its subroot and a lone
subroot the root, both with no siblings; a table without rows has no result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.ordered import running
from llm.registry import query, table
from tagloom.session import materialize, spread

RUN = 8  # nodes in a run; shifts by 3 below go with it
HEIGHT = 4
BLOCK = RUN**HEIGHT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Steps from an entry to the root in a tree of n entries."""
    h = 0
    while n > 1:
        n, h = -(-n // RUN), h + 1
    return h


def forward(entries: list[str], first: int, n: int) -> list[dict[int, str]]:
    """Digests by height and number, for neighbours from number `first` on in a tree of `n` entries."""
    top = min(HEIGHT, height(n))
    levels: list[dict[int, str]] = [{} for _ in range(top + 1)]
    queue: list[tuple[int, int, int, str]] = []  # (end, height) of the receiver, slot, digest

    def send(level: int, i: int, value: str) -> None:
        levels[level][i] = value
        if level < top:
            heappush(queue, (((i >> 3) + 1) << 3 * (level + 1), level + 1, i & 7, value))

    def receive() -> None:
        end, level = queue[0][:2]
        parts = []
        while queue and queue[0][:2] == (end, level):
            parts.append(heappop(queue)[3])
        send(level, (end >> 3 * level) - 1, digest(parts))

    for i, value in enumerate(entries, first):
        while queue and queue[0][0] <= i:
            receive()
        send(0, i, value)
    while queue:
        receive()
    return levels


def backward(levels: list[dict[int, str]], link) -> Iterator[tuple[int, tuple]]:
    """(number, link) of every entry, last first. A link is (digests left, digests right, link of the parent); `link` is
    that of the block's top, None at a root."""
    top = len(levels) - 1
    queue = [(-((i + 1) << 3 * top), -top, i, link) for i in levels[top]]
    while queue:
        _, level, i, link = heappop(queue)
        if level == 0:
            yield i, link
            continue
        below = levels[-level - 1]
        run = [below[c] for c in range(i << 3, (i + 1) << 3) if c in below]
        for slot in range(len(run)):
            own = ("".join(run[:slot]), "".join(run[slot + 1 :]), link)
            c = (i << 3) + slot
            heappush(queue, (-((c + 1) << 3 * (-level - 1)), level + 1, c, own))


def unlinked(link) -> list[tuple[str, str]]:
    """Digests left and right of a node and of all nodes above it, lowest first."""
    path = []
    while link is not None:
        path.append(link[:2])
        link = link[2]
    return path


def linked(path: list[dict] | None):
    return reduce(lambda up, step: (step["left"], step["right"], up), reversed(path or []), None)


def fold(value: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from an entry's digest and its siblings."""
    return reduce(lambda x, step: digest((step[0], x, step[1])), path, value)


# --- blocks in Spark -------------------------------------------------------------------------------


def _blocks(batches, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of one block after the other, from sorted rows whose first two columns name the block."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if rows and rows[0][:2] != row[:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _by_block(rows: DataFrame) -> DataFrame:
    """Messages of a block together and in label order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _tops(batches):
    columns = ["tree", "block", "place", "n", "digest"]
    for rows in _blocks(batches, columns):
        tree, block, first, n, _ = rows[0]
        levels = forward([row[4] for row in rows], first, n)
        yield pa.RecordBatch.from_pydict(
            {"tree": [tree], "place": [block], "n": [-(-n // BLOCK)], "digest": [levels[-1][block if len(levels) > HEIGHT else 0]]},
            schema=pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]),
        )


def _block() -> Column:
    return F.floor(F.col("place") / BLOCK).cast("bigint").alias("block")


def rise(entries: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweep over `<tree, place, n, digest>`, n entries per tree: the entries of every round, and
    `<tree, digest>` of the roots."""
    rounds, roots = [entries], []
    while True:
        rows = rounds[-1].select("tree", _block(), "place", "n", "digest")
        tops = _by_block(rows).mapInArrow(_tops, "tree string, place bigint, n bigint, digest string")
        tops = materialize(tops, "tops")
        roots.append(tops.filter("n = 1").select("tree", "digest"))
        rest = tops.filter("n > 1")
        if rest.limit(1).count() == 0:
            return rounds, reduce(DataFrame.unionByName, roots)
        rounds.append(rest)


def _deliver(batches, columns, finish):
    """Streams blocks whose first row has the link of the top; `finish` makes a batch of the entries' links."""
    for rows in _blocks(batches, columns):
        top, entries = rows[0], rows[1:]
        first, n = entries[0][2], entries[0][3]
        levels = forward([row[4] for row in entries], first, n)
        links = sorted(backward(levels, linked(top[5])))
        yield finish(top, entries, [link for _, link in links])


def _paths(top, entries, links):
    path = [[{"left": a, "right": b} for a, b in unlinked(link)] for link in links]
    columns = [[row[0] for row in entries], [row[2] for row in entries], path]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(path, _PATH)],
        names=["tree", "place", "path"],
    )


def fall(rounds: list[DataFrame], root_paths: DataFrame, finish=_paths, schema=f"tree string, place bigint, path {PATH}", extra=()):
    """Backward sweep: what `finish` makes of the proofs of the first round's entries.

    `root_paths` is `<tree, path, ..>`, what stands above each root, along with the columns in `extra`, which every round
    hands on. Further columns of the first round's entries are handed to `finish` behind the sixth.
    """
    base = {"tree": "string", "block": "bigint", "place": "bigint", "n": "bigint", "digest": "string", "path": PATH}
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        entries = rounds[i]
        own = [c for c in entries.columns if c not in base] if i == 0 else []
        # Trees that end in this round's block get what stands above their root, others what the round above made.
        ending = entries.filter(F.col("n") <= BLOCK).select("tree").distinct()
        tops = root_paths.join(ending, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "path", *extra)
        if above is not None:
            tops = tops.unionByName(above.select("tree", F.col("place").alias("block"), "path", *extra))
        none = {c: F.lit(None).cast(kind) for c, kind in base.items()}
        messages = tops.select(
            "tree", "block", F.lit(-1).cast("bigint").alias("place"), none["n"].alias("n"), none["digest"].alias("digest"),
            "path", *extra, *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in own],
        )
        rows = entries.select(
            "tree", _block(), "place", "n", "digest", none["path"].alias("path"),
            *[F.lit(None).cast("string").alias(c) for c in extra], *own,
        )
        sent = _by_block(rows.unionByName(messages))
        columns = sent.columns
        if i > 0:
            kinds = f"tree string, place bigint, path {PATH}" + "".join(f", {c} string" for c in extra)
            out = sent.mapInArrow(lambda batches, c=columns: _deliver(batches, c, _with_extra(extra)), kinds)
            above = materialize(out, "paths")
        else:
            return sent.mapInArrow(lambda batches, c=columns: _deliver(batches, c, finish), schema)


def _with_extra(extra):
    def finish(top, entries, links):
        batch = _paths(top, entries, links)
        for k, name in enumerate(extra):
            batch = batch.append_column(name, pa.array([top[6 + k]] * len(entries), pa.string()))
        return batch

    return finish


# --- documents -------------------------------------------------------------------------------------


def leaf_of(text: Column | None = None) -> Column:
    """Digest of a row's fields, each `-` or its length in bytes, a colon and the value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """`<tree, place, n, digest, doc_id, changed>`, stored: the rows of each tree in order. `changed` is the text that
    a row is found with later; the digest it gives is null where it gives the same."""
    # Languages as strings without null that keep the order.
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang"))).alias("tree")
    own = leaf_of()
    other = F.lit(None).cast("string") if changed is None else leaf_of(changed)
    rows = documents.select(tree, "doc_id", own.alias("digest"), other.alias("changed"))
    rows = materialize(rows.withColumn("changed", F.nullif("changed", "digest")), "leaves")
    placed = running(rows, "tree", ["doc_id", "digest"])
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"))
    return materialize(placed.join(sizes, "tree").select("tree", "place", "n", "digest", "doc_id", "changed"), "placed")


def manifest(placed: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of the trees in `leaves`, and `<tree, path, subroot, root>`: what stands above each subroot."""
    rounds, subroots = rise(placed.select("tree", "place", "n", "digest", "doc_id", "changed"))
    subroots = materialize(subroots.select(F.lit("").alias("all"), "tree", "digest"), "subroots")
    n = F.lit(subroots.count()).cast("bigint")
    entries = running(subroots, "all", ["tree"]).select(F.lit("").alias("tree"), "place", n.alias("n"), "digest", F.col("tree").alias("lang"))
    entries = materialize(entries, "subroots-placed")
    upper, root = rise(entries)
    start = root.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    paths = materialize(fall(upper, start.select("tree", "path", "root"), _subroot_paths,
                             f"tree string, path {PATH}, subroot string, root string", ("root",)), "subroot-paths")
    return rounds, paths


def _subroot_paths(top, entries, links):
    batch = _paths(top, entries, links)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[7] for row in entries], pa.string()),
            batch.column("path"),
            pa.array([row[4] for row in entries], pa.string()),
            pa.array([top[6]] * len(entries), pa.string()),
        ],
        names=["tree", "path", "subroot", "root"],
    )


def proofs(documents: DataFrame) -> DataFrame:
    """`<doc_id, leaf, subroot, root, path>`: the siblings left and right of each leaf and of the nodes above it."""
    placed = leaves(documents)
    kind = placed.schema["doc_id"].dataType.simpleString()

    def finish(top, entries, links):
        batch = _paths(top, entries, links)
        n = len(entries)
        columns = [[row[8] for row in entries], [row[4] for row in entries], [top[6]] * n, [top[7]] * n]
        kinds = [_arrow(kind), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, batch.column("path")], names=["doc_id", "leaf", "subroot", "root", "path"])

    rounds, tops = manifest(placed)
    return fall(rounds, tops, finish, f"doc_id {kind}, leaf string, subroot string, root string, path {PATH}", ("subroot", "root"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def audited(documents: DataFrame, changed: Column) -> DataFrame:
    """`<doc_id, leaf, subroot, root, proof_sha256, folded_root, verified>`: every row as it is found with the text
    `changed`, folded with the proof of its original. Proofs stay in the task that they reach."""
    placed = leaves(documents, changed)
    kind = placed.schema["doc_id"].dataType.simpleString()

    def finish(top, entries, links):
        subroot, root = top[6], top[7]
        paths = [unlinked(link) for link in links]
        folded = [fold(row[9] or row[4], path) for row, path in zip(entries, paths, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row[8] for row in entries], _arrow(kind)),
                pa.array([row[4] for row in entries], pa.string()),
                pa.array([subroot] * len(entries), pa.string()),
                pa.array([root] * len(entries), pa.string()),
                pa.array([digest(x for step in path for x in step) for path in paths], pa.string()),
                pa.array(folded, pa.string()),
                pa.array([x == root for x in folded]),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    rounds, tops = manifest(placed)
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return fall(rounds, tops, finish, schema, ("subroot", "root"))


# --- query -----------------------------------------------------------------------------------------

# CRC-32 of a decimal number in SQL: a list of its bytes, eight shifts (-1) behind each.
SQL_CRC32 = """xor(list_reduce(flatten([[4294967295]::BIGINT[], flatten(list_transform(string_split({0}, ''),
  lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))]),
  lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"""


def _sql() -> str:
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    changed = f"CASE WHEN {SQL_CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    steps = [f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f'({changed})')} AS found FROM documents)",
             "e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)"]

    def tree(name: str, start: str, levels: int, rows: str, keep: str) -> str:
        """Levels of a forest, then every row folded up along them; returns the last relation."""
        steps.append(f"{name}0 AS ({start})")
        last = rows
        for j in range(levels):
            own, runs = f"{name}{j}", f"{name}r{j}"
            steps.append(f"{runs} AS (SELECT tree, i // 8 AS i, list(x ORDER BY i) AS run, any_value(n) AS n FROM {own} GROUP BY tree, i // 8)")
            steps.append(f"""{name}{j + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS x,
              (n + 7) // 8 AS n FROM {runs})""")
            left, right = "array_to_string(run[1:s.i % 8], '')", "array_to_string(run[s.i % 8 + 2:], '')"
            steps.append(f"""{name}f{j} AS (SELECT {keep}, s.tree, s.i // 8 AS i,
              proof || CASE WHEN n = 1 THEN '' ELSE {left} || {right} END AS proof,
              CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded
              FROM {last} s JOIN {runs} r ON s.tree = r.tree AND s.i // 8 = r.i)""")
            last = f"{name}f{j}"
        return last

    steps.append("s AS (SELECT doc_id, leaf, tree, i, '' AS proof, found AS folded FROM e)")
    up = tree("a", "SELECT tree, i, leaf AS x, count(*) OVER (PARTITION BY tree) AS n FROM e", 6, "s", "doc_id, leaf")
    steps.append("b AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, x, count(*) OVER () AS n FROM a6)")
    steps.append(f"""t AS (SELECT f.doc_id, f.leaf, b.x AS subroot, '' AS tree, b.i, f.proof, f.folded FROM {up} f JOIN b ON f.tree = b.tree)""")
    up = tree("c", "SELECT '' AS tree, i, x, n FROM b", 3, "t", "doc_id, leaf, subroot")
    return f"""WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT x FROM c3) AS root, sha256(proof) AS proof_sha256,
      folded AS folded_root, folded = (SELECT x FROM c3) AS verified FROM {up}"""


@query("op13_merkle", _sql())
def op13_merkle(spark, folder):
    documents = spread(table(spark, folder, "documents", *FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return audited(documents, F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
