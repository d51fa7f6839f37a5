"""Cleaning order, dedup, labels, weak labels, metrics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions.keywords import keyword_density, keyword_matches, keyword_pattern, token_count, weak_label
from tagloom.functions.numbers import ratio, round_even
from tagloom.operators import clean, labels, metrics
from tagloom.plans import corpus
from tagloom.sources.corpora import with_content_id


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ROWS = [
    (1, "same"),
    (2, None),
    (3, "same"),
    (4, "same "),
    (5, " \n"),
    (6, "http://only"),
    (7, "\U0001f600"),
    (8, "http://a \U0001f600"),
    (9, None),
    (10, ""),
    (0, "late but smallest"),
    (11, "late but smallest"),
]


def test_clean_rows(spark):
    got = clean.clean_rows(frame(spark, ROWS, "id long, text string")).select("id", "clean_text", "text_length")
    assert sorted(map(tuple, got.collect())) == [
        (0, "late but smallest", 17),
        (1, "same", 4),
        (4, "same", 4),  # dedup looks at raw text
        (8, "[URL] [EMOJI]", 13),
    ]


def test_stage_report_matches_the_stages(spark):
    rows = clean.stage_report(frame(spark, ROWS, "id long, text string")).orderBy("step").collect()
    assert [(r.stage, r.rows_in, r.dropped, r.kept) for r in rows] == [
        ("missing", 12, 2, 10),
        ("duplicate", 10, 2, 8),
        ("empty", 8, 2, 6),
        ("marks_only", 6, 2, 4),
    ]


def test_stage_report_of_nothing(spark):
    rows = clean.stage_report(frame(spark, [], "id long, text string")).collect()
    assert [(r.rows_in, r.kept) for r in rows] == [(0, 0)] * 4


def test_drop_functions_keep_null(spark):
    df = frame(spark, [("",), (None,), ("[URL]",), ("x",)], "clean_text string")
    assert [r[0] for r in clean.drop_empty(df).collect()] == [None, "[URL]", "x"]
    assert [r[0] for r in clean.drop_only_marks(df).collect()] == ["", None, "x"]


def test_keep_first_is_idempotent_under_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    df = frame(spark, rows, "id long, clean_text string").repartition(16)
    once = clean.keep_first(df)
    got = {tuple(r) for r in once.collect()}
    want = {}
    for i, text in rows:
        want.setdefault(text, i)
    assert got == {(i, text) for text, i in want.items()}
    assert {tuple(r) for r in clean.keep_first(once).collect()} == got


def test_losers_meet_texts_in_buckets_where_they_lie(spark):
    """With broadcast off no exchange moves a text once the table is stored by id."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    df = frame(spark, rows, "id long, clean_text string").repartition(5)
    want = {}
    for i, text in rows:
        want.setdefault(text, i)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored, buckets = clean.store_by_id(df)
        once = clean.keep_first(stored, buckets=buckets)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in clean.keep_first(df)._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in once.collect()} == {(i, text) for text, i in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_content_ids_do_not_depend_on_where_rows_lie(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), (None, None), (None, None), ("hot", 0), *[("hot", 0)] * 40]
    df = frame(spark, rows, "x string, y int")
    first, second = (sorted((r.id, r.x, r.y) for r in with_content_id(d).collect()) for d in (df, df.repartition(7)))
    assert str(first) == str(second) and len({r[0] for r in first}) == len(rows)
    assert sorted(str(r[1:]) for r in first) == sorted(map(str, rows))
    assert sorted(int(r[0].split(":")[1]) for r in first if r[1] == "hot") == list(range(1, 42))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert str(sorted((r.id, r.x, r.y) for r in with_content_id(df).collect())) == str(first)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_length_summary_like_pandas(spark):
    lengths = [1, 1, 2, 3, 5, 8, 13, 40, 7, 7, 7]
    row = clean.length_summary(frame(spark, [("x" * n,) for n in lengths] + [(None,)], "clean_text string")).first()
    want = pd.Series(lengths).describe()
    got = [row.n, row.mean_len, row.std_len, row.min_len, row.q25, row.q50, row.q75, row.max_len]
    assert np.allclose(got, want.to_numpy())
    one = clean.length_summary(frame(spark, [("ab",)], "clean_text string")).first()
    assert one.std_len is None and one.q50 == 2.0


def test_majority_vote(spark):
    votes = [(1, 1.0), (1, 0.0), (2, 1.0), (2, 1.0), (2, 0.0), (3, None), (4, float("nan")), (4, 1.0)]
    got = labels.majority_vote(frame(spark, votes, "rev_id long, attack double"), "rev_id", "attack").collect()
    assert {r.rev_id: r.label for r in got} == {1: 0, 2: 1, 3: None, 4: 1}


def test_binarize_and_sentinel(spark):
    df = frame(spark, [("spam", 1), ("normal", None), ("hateful", 0), (None, None)], "c string, y int")
    got = df.select(labels.binarize(F.col("c")), labels.label_or_sentinel(F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(0, 1), (0, -1), (1, 0), (1, -1)]


def test_split_stored_keeps_null_in_train(spark):
    df = frame(spark, [(1, "test"), (2, "dev"), (3, None)], "id int, split string")
    train, test = labels.split_stored(df)
    assert [r.id for r in test.collect()] == [1] and sorted(r.id for r in train.collect()) == [2, 3]


def test_replace_column(spark):
    df = frame(spark, [(1, 0, "a"), (2, 1, "b"), (3, 1, "c")], "id int, label int, text string")
    new = frame(spark, [(1, 1), (2, None)], "id int, label int")
    got = labels.replace_column(df, new, "id", "label").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (2, None, "b"), (3, 1, "c")]
    assert labels.label_domain(df).first()["labels"] == [0, 1]


def test_keywords(spark):
    words = ["bad", "bad day", "c++", "idiot"]
    df = frame(spark, [("a bad day, BAD badly idiot idiot",), ("",), ("  ",), ("éidiot idiot",)], "text string")
    got = df.select(keyword_matches(F.col("text"), words), token_count(F.col("text"))).collect()
    assert [list(r[0]) for r in got] == [["bad day", "idiot", "idiot"], [], [], ["idiot"]]
    assert [r[1] for r in got] == [len(t.split(" ")) for t in ("a bad day, BAD badly idiot idiot", "", "  ", "éidiot idiot")]
    folded = df.select(keyword_matches(F.col("text"), words, ignore_case=True)).first()[0]
    assert list(folded) == ["bad day", "BAD", "idiot", "idiot"]
    with pytest.raises(ValueError):
        keyword_pattern([""])


def test_density_exactly_at_threshold_is_negative(spark):
    df = frame(spark, [("bad " + "x " * 18 + "x",)], "text string")
    density = keyword_density(keyword_matches(F.col("text"), ["bad"]), F.col("text"))
    assert tuple(df.select(density, weak_label(density, 0.05), weak_label(density, 0.049)).first()) == (0.05, 0, 1)


def macro(y, p):
    scores = []
    for c in sorted(set(y) | set(p)):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        fp = sum(a != c and b == c for a, b in zip(y, p))
        fn = sum(a == c and b != c for a, b in zip(y, p))
        precision = tp / (tp + fp) if tp + fp else 0.0
        scores.append((precision, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0))
    return [sum(s[i] for s in scores) / len(scores) for i in (0, 1)]


@pytest.mark.parametrize(
    "pairs",
    [
        [(0, 0), (0, 1), (1, 1), (1, 0), (1, 1)],
        [(0, 0), (0, 0)],
        [(1, 1)],
        [(0, 1), (0, 1)],
        [(1, 0), (0, 0), (0, 0)],
    ],
)
def test_binary_scores(spark, pairs):
    row = metrics.binary_scores(frame(spark, pairs, "label int, prediction int")).first()
    y, p = zip(*pairs)
    precision, f1 = macro(y, p)
    assert math.isclose(row.precision_macro, precision) and math.isclose(row.f1_macro, f1)
    assert math.isclose(row.accuracy, sum(a == b for a, b in pairs) / len(pairs))
    assert (row.fpr is None) == (0 not in y) and (row.fnr is None) == (1 not in y)
    if 1 not in y:
        assert row.recall_pos == 0.0


def test_sweep_equals_one_threshold_at_a_time(spark):
    rows = [(i % 2, (i * 7 % 30) / 100) for i in range(100)] + [(None, 0.3)]
    df = frame(spark, rows, "label int, density double")
    swept = {r.threshold: r for r in metrics.threshold_sweep(df, "label", "density", [0.01, 0.05, 0.25], None).collect()}
    for t in (0.01, 0.05, 0.25):
        single = metrics.binary_scores(df.withColumn("prediction", weak_label(F.col("density"), t))).first()
        assert [swept[t][c] for c in single.asDict()] == list(single)


def test_rounding_like_numpy(spark):
    values = [0.125, 0.375, 0.575, 0.285, 2.5, -0.125, 1.005]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(round_even(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == list(np.round(values, 2))
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)), ratio(F.lit(1), F.lit(0), 0)).first()[:] == (None, 0.0)


def test_class_balance_tie_is_negative(spark):
    df = frame(spark, [(0,), (1,), (None,)], "label int")
    row = metrics.class_balance(df).first()
    assert (row.n, row.n_pos, row.n_neg, row.majority, row.pos_share) == (3, 1, 1, "negative", 0.333)
    shares = {r.label: r.share for r in metrics.class_shares(df).collect()}
    assert shares == {0: 0.5, 1: 0.5}
    assert metrics.labelled_count(df).first()[0] == 2
    assert metrics.label_mean(df).first()[0] == 0.5


def test_voted_corpus(spark):
    comments = frame(
        spark,
        [(1, "==Hi==NEWLINE_TOKENyou", "test"), (2, None, "train"), (3, "good TAB_TOKEN day", None), (4, "x", "dev")],
        "rev_id long, comment string, split string",
    )
    votes = frame(spark, [(1, 1.0), (1, 1.0), (3, 0.0), (9, 1.0)], "rev_id long, attack double")
    train, test = corpus.voted_corpus(comments, votes)
    assert [tuple(r) for r in test.collect()] == [(1, "Hi you", 1)]
    assert sorted(tuple(r) for r in train.collect()) == [(3, "good day", 0), (4, "x", None)]


def test_category_corpus_split_size(spark):
    tweets = spark.range(200).select(
        "id", F.concat(F.lit("tweet "), F.col("id").cast("string")).alias("tweet"),
        F.when(F.col("id") % 4 == 0, "abusive").otherwise("normal").alias("label"),
    )
    train, test = corpus.category_corpus(tweets)
    assert test.count() == math.ceil(0.101 * 200) and train.count() == 200 - 21
    assert train.join(test, "id").count() == 0
