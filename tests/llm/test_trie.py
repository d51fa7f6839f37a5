"""The prefix trie against a walk in plain Python, its slots, and awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm import ordered, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def slow_trie(rows):
    """Rows of the result from turns as tuples."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            given[conv].append((turn is not None, turn or 0, role, key, text))
    turns = {conv: [(t[2], t[4]) for t in sorted(own)] for conv, own in given.items()}
    members = defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        path = turns.get(conv - conv % 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((conv, d == len(path)))
    out = []
    for node, own in members.items():
        subtree = [x for x in members if x[: len(node)] == node]
        children = [x for x in subtree if len(x) == len(node) + 1]
        leaves = [x for x in subtree if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in subtree)]
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in subtree if x)
        ends = ",".join(str(c) for c in sorted(c for c, last in own if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(own)[0], len(node), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(given, *parameters):
    return sorted((tuple(r) for r in trie.trie(given, *parameters).select(*COLUMNS).collect()), key=str)


def sample():
    """Shared first turns, copies, a conversation without turns of its own, absent and short ones, odd rows."""
    rows = []
    for conv in range(70):
        if conv in (20, 61):
            continue  # 21 to 39 have nothing to share
        for turn in range(1 if conv == 40 else 2 + conv % 5):
            same = f"a turn number {turn}" if conv % 3 == 0 else f"turn {turn} of {conv}"
            rows.append((conv, turn, ("user", "assistant")[turn % 2], same))
    rows += [(None, 0, "user", "nobody"), (5, None, None, None), (5, 0, "user", "a turn number 0"), (5, 0, "user", "a turn number 0")]
    rows += [(80, turn, "user", f"long {turn % 3}") for turn in range(300)]
    rows += [(84, 2, "user", f"tie {i}") for i in range(5)] + [(85, 2, "user", f"tie {i}") for i in range(4, -1, -1)]
    rows += [(81, 7, "ab", "c"), (82, 7, "a", "bc"), (83, 3, "", "abc")]
    return rows


def test_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from tools.compare import compare

    spark.createDataFrame(sample(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(spark, connection, str(tmp_path), "op12_trie")[0] == "same"


@pytest.mark.parametrize("shard_rows, band", [(1 << 14, 1 << 12), (40, 64), (3, 5)])
def test_trie(spark, shard_rows, band):
    """One shard, some heavy nodes, nearly all nodes heavy and in many bands."""
    given = spark.createDataFrame(sample(), SCHEMA).repartition(5)
    assert result(given, shard_rows, band) == slow_trie(sample())


def test_trie_of_copies_in_one_group(spark):
    """Most conversations are one, and the digests of their numbers come from several pieces."""
    rows = [(i, t, "user", f"x{t}") for i in range(9_000) for t in range(2)]
    given = spark.range(9_000).selectExpr("id AS conv_id", "explode(array(0L, 1L)) AS turn").selectExpr(
        "*", "'user' AS role", "concat('x', turn) AS text"
    )
    ends = hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert len(rows) == given.count()
    assert result(given) == [(0, 0, None, 9_000, 1, 1, 17_998, none), (0, 1, 0, 9_000, 1, 1, 17_998, none), (0, 2, 0, 9_000, 0, 1, 8_999, ends)]


def test_empty_and_clashing(spark):
    names = "a b pa pb node depth place place_running heavy bucket h base length n_convs words home pid at head salt".split()
    given = spark.createDataFrame(sample()[:40], SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in names])
    assert result(given) == slow_trie(sample()[:40])
    assert result(given.limit(0)) == []


def test_slots():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 1_000):
        keys = draw.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        slots = trie.Slots(keys)
        assert sorted(slots.lookup(keys).tolist()) == list(range(n))  # minimal and perfect
        others = draw.integers(0, 1 << 63, (2_000, 2)).astype(np.uint64)
        assert (slots.lookup(others) == -1).all()  # whatever place they fall on
        if n:
            half = keys.copy()
            half[:, 1] ^= np.uint64(1)
            assert (slots.lookup(half) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.zeros((2, 2), np.uint64))


def test_running_over_many_tasks(spark):
    """Groups that lie on one task, on many, and behind one another; null is a group, equal rows are apart."""
    rows = [(g, i, (g or 0) * 1_000_003 + i) for g, n in ((None, 5), (1, 3_000), (2, 1), (3, 400)) for i in range(n)]
    rows += [(4, 0, 17)] * 500
    given = spark.createDataFrame(rows, "g bigint, i bigint, v bigint").repartition(7)
    placed = ordered.running(given, "g", ["i"], ["v"]).collect()
    seen = defaultdict(list)
    for r in placed:
        seen[r.g].append((r.place, r.i, r.v, r.v_running))
    assert len(placed) == len(rows)
    for g, own in seen.items():
        total = 0
        for k, (place, i, v, run) in enumerate(sorted(own)):
            total ^= v
            assert (place, run) == (k, total) and (g == 4 or i == k)
    assert ordered.running(given.limit(0), "g", ["i"], ["v"]).count() == 0
