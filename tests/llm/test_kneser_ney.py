"""The n-gram model against dictionaries, on documents and awkward rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import kneser_ney as kn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN, END = "<begin> ", "<end> "  # no words, since they hold a blank


def tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), END]


def slow_scores(learned, judged, n):
    """(tokens, known, base, score) of each text."""
    sets = [tokens(t) for t in learned]
    c = Counter(w for t in sets for w in t)
    size, vocabulary = sum(c.values()), len(c)
    grams = {n: Counter()}
    for t in sets:
        s = [BEGIN] * (n - 1) + t
        grams[n].update(tuple(s[k - n + 1 : k + 1]) for k in range(n - 1, len(s)))
    for k in range(n - 1, 0, -1):
        grams[k] = Counter()
        for g, count in grams[k + 1].items():
            grams[k][g[1:]] += count if g[1] == BEGIN else 1
    lost, contexts = {}, {}
    for k, counted in grams.items():
        lost[k] = kn.discounts(*[sum(v == j for v in counted.values()) for j in (1, 2, 3, 4)])
        contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, v in counted.items():
            contexts[k][g[:-1]][0] += v
            contexts[k][g[:-1]][min(v, 3)] += 1

    def p(gram):
        if not gram:
            return 1 / (vocabulary + 1)
        k = len(gram)
        if gram[:-1] not in contexts[k]:
            return p(gram[1:])
        total, *few = contexts[k][gram[:-1]]
        v = grams[k][gram]
        return (v - lost[k][min(v, 3)]) / total + sum(a * b for a, b in zip(lost[k][1:], few)) / total * p(gram[1:])

    out = []
    for text in judged:
        t = tokens(text)
        s = [BEGIN] * (n - 1) + t
        score = sum(math.log10(p(tuple(s[k - n + 1 : k + 1]))) for k in range(n - 1, len(s)))
        base = sum(math.log10((c[w] + 0.5) / (size + 0.5 * (vocabulary + 1))) for w in t)
        out.append((len(t), sum(c[w] > 0 for w in t), base, score))
    return out, p, c


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, documents, texts, order):
    ids = sorted(texts)
    learned = [i for i in ids if zlib.crc32(str(i).encode()) % 5 != 1]
    want, p, c = slow_scores([texts[i] for i in learned], [texts[i] for i in ids], order)
    model = kn.fit(documents.filter(~kn.is_held_out()), order)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in kn.scored(documents, model).collect()}
    assert model.tokens == sum(c.values()) and model.n_words == len(c)
    for i, row in zip(ids, want, strict=True):
        assert got[i] == pytest.approx(row, rel=1e-9)
    # What may follow two words adds up to one, unknown words included.
    followers = [*c, "unknown word"]
    for context in ((BEGIN,) * (order - 1), tuple(tokens(texts[ids[0]])[: order - 1]), ("un known",) * (order - 1)):
        assert sum(p((*context, w)) for w in followers) == pytest.approx(1)


def test_model_beats_single_words_on_held_out_texts(spark, documents):
    model = kn.fit(documents.filter(~kn.is_held_out()))
    row = kn.scored(documents.filter(kn.is_held_out()), model).selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert 10 ** (-row.s / row.n) < 0.5 * 10 ** (-row.b / row.n)


def test_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    learned = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    want, _, _ = slow_scores(learned, [t for _, t in rows], kn.ORDER)
    model = kn.fit(odd_documents.filter(~kn.is_held_out()))
    got = [(r.n_tokens, r.n_known, r.base_score, r.score) for r in kn.scored(odd_documents, model).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a == pytest.approx(b, rel=1e-9)
    assert kn.scored(odd_documents.limit(0), model).count() == 0
    nothing = kn.fit(odd_documents.limit(0))
    assert {(r.n_known, r.base_score, r.score) for r in kn.scored(odd_documents, nothing).collect()} == {(0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        kn.fit(odd_documents, 1)


def test_counts_are_whole_whatever_is_sent_when(monkeypatch):
    """Many small shards and pieces give the same entries as one."""
    draw = np.random.default_rng(3)
    numbers = [draw.integers(0, 50, 4_000).astype(np.uint32) for _ in range(2)]
    want = Counter(zip(*map(np.ndarray.tolist, numbers)))
    monkeypatch.setattr(kn, "HELD", 300)
    monkeypatch.setattr(kn, "PIECE", 7)
    for bits in (0, 3):
        counter, rows = kn._Counter(bits), []
        for at in range(0, 4_000, 250):
            own = [c[at : at + 250] for c in numbers]
            rows += counter.add(kn.key_of(own), own, [np.ones(len(own[0]), np.uint64)])
        rows += counter.flush()
        got = Counter()
        for _, shard, n, tuples, values in rows:
            columns, (counts,) = kn._unplaned(tuples, n, np.uint32), kn._unplaned(values, n, np.uint64)
            assert n <= 7 and (kn._shard_of(kn.key_of(columns), bits) == shard).all()
            for pair, count in zip(zip(*map(np.ndarray.tolist, columns)), counts.tolist()):
                got[pair] += count
        assert got == want


def test_discounts():
    assert kn.discounts(0, 0, 0, 0) == kn.discounts(5, 0, 1, 1) == [0.0, 0.5, 1.0, 1.5]
    y = 100 / 180
    assert kn.discounts(100, 40, 20, 12) == pytest.approx([0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])
    assert kn.discounts(100, 10, 1, 50) == [0.0, 0.5, 1.0, 1.5]  # the last would be below zero


def test_a_task_holds_few_entries():
    """Counting takes bounded memory, however many different n-grams a task has."""
    draw = np.random.default_rng(1)
    n = 1 << 18

    def entries(data, offsets):
        columns = [draw.integers(0, 1 << 32, n, np.uint32) for _ in range(2)]
        return kn.key_of(columns), columns, [np.ones(n, np.uint64)]

    batches = (pa.RecordBatch.from_pydict({"text": ["x"]}) for _ in range(24))
    tracemalloc.start()
    sent = sum(sum(b.column("n").to_pylist()) for b in kn._count(batches, 2, entries))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 24 * n and peak < 160 << 20
