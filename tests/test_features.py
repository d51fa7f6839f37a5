import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import features as X
from tagloom.operators import joins
from tagloom.operators.joins import lookup_join

DOCS = [
    (1, "The cat_1 sat on the MAT, the mat!"),
    (2, "A dog sat; a dog ran. été ÉTÉ"),
    (3, "the of and"),
    (4, ""),
    (5, "cat dog cat x y z"),
]
NEW = [(10, "mat unseen dog"), (11, "unseen only")]


def brute(train, rows):
    def terms(text):
        return [t for t in re.findall(r"\b\w\w+\b", text.lower()) if t not in X.STOP_WORDS]

    df = Counter(t for _, text in train for t in set(terms(text)))
    idf = {t: math.log((1 + len(train)) / (1 + n)) + 1 for t, n in df.items()}
    out = {}
    for i, text in rows:
        raw = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, t): v / norm for t, v in raw.items()}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string")


def as_dict(weights):
    return {(r.id, r.term): r.weight for r in weights.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_tfidf_against_brute_force(spark, docs):
    model = X.fit_tfidf(docs)
    close(as_dict(X.transform_tfidf(model, docs)), brute(DOCS, DOCS))
    new = spark.createDataFrame(NEW, "id long, text string")
    close(as_dict(X.transform_tfidf(model, new)), brute(DOCS, NEW))


def test_tfidf_with_a_vocabulary_too_large_to_broadcast(docs, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    close(as_dict(X.transform_tfidf(X.fit_tfidf(docs), docs)), brute(DOCS, DOCS))
    model, weights = X.fit_transform_tfidf(docs)
    close(as_dict(weights), brute(DOCS, DOCS))
    close(as_dict(X.transform_tfidf(model, docs)), brute(DOCS, DOCS))


def test_vectors_have_the_same_weights(spark, docs):
    vectors = X.fit_tfidf_vectors(docs)
    vocabulary = {row.term_id: row.term for row in vectors.terms.collect()}
    assert sorted(vocabulary) == list(range(vectors.n_terms))
    got, rows = {}, vectors.transform(docs).collect()
    for row in rows:
        assert row.features.size == vectors.n_terms
        got |= {(row.id, vocabulary[i]): v for i, v in zip(row.features.indices, row.features.values)}
    close(got, brute(DOCS, DOCS))
    assert sorted(row.id for row in rows) == [1, 2, 3, 4, 5]
    again = {row.term: row.term_id for row in X.fit_tfidf_vectors(docs.repartition(7)).terms.collect()}
    assert again == {term: i for i, term in vocabulary.items()}


def test_vectors_with_a_term_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(joins, "HEAD", 50)
    rows = [(i, f"common common word{i} word{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    close(as_dict(X.transform_tfidf(X.fit_tfidf(df), df)), brute(rows, rows))


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_paths_agree(spark, monkeypatch, fits, how):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: fits)
    big = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    lookup = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    counted = lookup.join(big.groupBy("k").count(), "k", "left").fillna(0)
    got = lookup_join(big, counted, "k", how, counts="count", spread_by="id")
    want = big.join(lookup, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_encode_fixed(spark):
    rows = [(1, "[URL] Dog dog [USER]x"), (2, ""), (3, " ".join(["dog"] * 20)), (4, "dog [EMOJI] new")]
    df = spark.createDataFrame(rows, "id long, text string")
    lists = X.word_lists(df)
    ids = X.fit_word_ids(lists.filter("id < 4"))
    table = {r.word: r.word_id for r in ids.table.collect()}
    assert set(table) == {"Dog", "dog", "x"} and sorted(table.values()) == [7, 8, 9]
    got = {r.id: (list(r.input_ids), list(r.attention_mask)) for r in X.encode_fixed(ids, lists, max_length=8).collect()}
    dog = table["dog"]
    assert got[1] == ([2, 5, table["Dog"], dog, 4, table["x"], 3, 0], [1] * 7 + [0])
    assert got[2] == ([2, 3] + [0] * 6, [1, 1] + [0] * 6)
    assert got[3] == ([2] + [dog] * 6 + [3], [1] * 8)
    assert got[4] == ([2, dog, 6, 1, 3, 0, 0, 0], [1] * 5 + [0] * 3)


def test_encode_fixed_of_repeated_and_missing_ids(spark):
    rows = [(1, "dog cat"), (1, "dog [URL] dog"), (None, "cat [USER]"), (2, None), (3, "")]
    lists = X.word_lists(spark.createDataFrame(rows, "id long, text string"))
    ids = X.fit_word_ids(lists)
    table = {r.word: r.word_id for r in ids.table.collect()}
    dog, cat = table["dog"], table["cat"]
    got = {(r.id, tuple(r.input_ids) if r.input_ids else None) for r in X.encode_fixed(ids, lists, max_length=5).collect()}
    assert got == {
        (1, (2, dog, cat, 3, 0)), (1, (2, dog, 5, dog, 3)), (None, (2, 1, 4, 3, 0)), (2, None), (3, (2, 3, 0, 0, 0)),
    }


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_of_a_stored_table_are_not_shuffled(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(joins, "FREQUENT", 20)
    big = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    lookup = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    counted = lookup.join(big.groupBy("k").count(), "k", "left").fillna(0)
    got = lookup_join(big, counted, "k", how, counts="count", spread_by="id", stored=True)
    want = big.join(lookup, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_vectors_find_the_norm_of_a_text_once(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20_000))), (2, "word1")], "id long, text string")
    _, vectors = X.fit_transform_tfidf_vectors(df)
    got = {r.id: r.features for r in vectors.collect()}
    assert got[1].size == 20_000 and abs(got[1].norm(2) - 1) < 1e-9 and got[2].norm(2) == 1
