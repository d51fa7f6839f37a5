"""The manifest against trees built from lists, over several rounds of blocks, and awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, text):
    return sha(*map(field, (*doc[:4], text)))


def slow_tree(digests):
    """(root, proof as (left, right) of each entry)"""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k in range(len(digests)):
            run, slot = runs[at[k] // 8], at[k] % 8
            proofs[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] //= 8
        level = [sha(*run) for run in runs]
    return level[0], proofs


def slow_manifest(docs):
    trees = {}
    for doc in docs:
        trees.setdefault((doc[2] is not None, (doc[2] or "").encode()), []).append(doc)
    order = lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4]))
    built = [slow_tree([leaf(d, d[4]) for d in sorted(trees[k], key=order)]) for k in sorted(trees)]
    root, tops = slow_tree([subroot for subroot, _ in built])
    out = []
    for k, (subroot, proofs), top in zip(sorted(trees), built, tops, strict=True):
        for d, proof in zip(sorted(trees[k], key=order), proofs, strict=True):
            text = d[4]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                text = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            x = leaf(d, text)
            for left, right in proof + top:
                x = sha(left, x, right)
            siblings = sha(*[s for step in proof + top for s in step])
            out.append((d[0], leaf(d, d[4]), subroot, root, siblings, x, x == root))
    return sorted(out, key=str)


def result(given):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.audited(given, text).collect()), key=str)


def test_manifest_over_several_rounds(spark):
    """A tree of two rounds of blocks with a last block of one entry, full runs, and lone leaves."""
    sizes = {"de": merkle.BLOCK + 1, "en": 64, "": 1, None: 9, "é": 2, "z": 8}
    docs, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 7
            docs.append((i % 99_991, f"s{i % 3}", lang, i, f"Text {i} É"))
    assert result(spark.createDataFrame(docs, SCHEMA).repartition(6)) == slow_manifest(docs)


def test_odd_documents(spark, odd_documents):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_documents.collect()]
    assert result(odd_documents) == slow_manifest(docs)
    assert result(odd_documents.limit(0)) == []
    one = odd_documents.filter("doc_id = 1")
    (row,) = merkle.proofs(one).collect()
    assert row.leaf == row.subroot == row.root and row.path == []


def test_proofs_lead_to_the_root_and_no_other_leaf_does(spark, documents):
    rows = merkle.proofs(documents).collect()
    assert len(rows) == documents.count() and len({r.root for r in rows}) == 1
    for r in rows:
        path = [(s.left, s.right) for s in r.path]
        assert merkle.fold(r.leaf, path) == r.root
        assert merkle.fold(sha(r.leaf), path) != r.root


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 600])
def test_sweeps(n):
    entries = [sha(str(i)) for i in range(n)]
    root, proofs = slow_tree(entries)
    levels = merkle.forward(entries, 0, n)
    assert levels[-1] == {0: root}
    links = sorted(merkle.backward(levels, None))
    assert [merkle.unlinked(link) for _, link in links] == proofs
    assert merkle.unlinked(merkle.linked([{"left": a, "right": b} for a, b in proofs[-1]])) == proofs[-1]
