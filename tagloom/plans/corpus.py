"""From raw corpora to stored base sets and samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.keywords import (
    BASE_THRESHOLD,
    SWEEP_THRESHOLDS,
    keyword_density,
    keyword_matches,
    token_count,
    weak_label,
)
from tagloom.functions.text import drop_corpus_marks
from tagloom.operators.clean import clean_rows
from tagloom.operators.labels import attach_labels, binarize, majority_vote, split_stored
from tagloom.operators.metrics import threshold_sweep
from tagloom.operators.sampling import (
    NEG_SHARES,
    TEST_BUDGET,
    TRAIN_BUDGET,
    budget_samples,
    random_split,
    shuffled,
)
from tagloom.session import materialize
from tagloom.sources.corpora import BASE, read_base, write_sample, write_samples


def voted_corpus(comments: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) `<id, text, label>` from comments with several votes each and a stored split."""
    labels = majority_vote(votes, "rev_id", "attack")
    rows = attach_labels(comments, labels, "rev_id").select(
        F.col("rev_id").alias("id"), drop_corpus_marks(F.col("comment")).alias("text"), "label", "split"
    )
    # Both halves read this, so the cleaning must not run twice.
    train, test = split_stored(materialize(_with_clean_text(rows, ["split"]), "corpus"))
    return train.drop("split"), test.drop("split")


def category_corpus(tweets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) `<id, text, label>` from rows `<id, tweet, label>` with one category each and no split."""
    rows = tweets.select("id", F.col("tweet").alias("text"), binarize(F.col("label")).alias("label"))
    # Three passes of the split read this, so the cleaning must not run three times.
    return random_split(materialize(_with_clean_text(rows, []), "corpus"))


def _with_clean_text(rows: DataFrame, keep: list[str]) -> DataFrame:
    return clean_rows(rows).select("id", F.col("clean_text").alias("text"), "label", *keep)


def add_keywords(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Add `matches, len_matches, len_text, norm_kw`."""
    text = F.col("text")
    rows = df.withColumn("matches", keyword_matches(text, keywords))
    return rows.withColumns(
        {
            "len_matches": F.size("matches"),
            "len_text": token_count(text),
            "norm_kw": keyword_density(F.col("matches"), text),
        }
    )


def add_weak_label(df: DataFrame, keywords: list[str], threshold: float = BASE_THRESHOLD) -> DataFrame:
    """`add_keywords` and `weak_pos_keywords`."""
    return add_keywords(df, keywords).withColumn("weak_pos_keywords", weak_label(F.col("norm_kw"), threshold))


def sweep(df: DataFrame, keywords: list[str], thresholds=SWEEP_THRESHOLDS, places: int | None = 2) -> DataFrame:
    """How well the weak label agrees with the true one at each threshold."""
    return threshold_sweep(add_keywords(df, keywords), "label", "norm_kw", thresholds, places)


def store_sets(
    train: DataFrame,
    test: DataFrame,
    keywords: list[str],
    path: str,
    dataset: str,
    train_budget: int = TRAIN_BUDGET,
    test_budget: int = TEST_BUDGET,
    neg_shares=NEG_SHARES,
    seed=0,
) -> None:
    """Write both base sets and, from what was written, every class-balanced sample: all samples of a base set are drawn
    together and written in one go."""
    spark = train.sparkSession
    weak = add_weak_label(train, keywords).withColumn("weak_label", F.col("weak_pos_keywords"))
    for split, rows, budget in (("test", test, test_budget), ("train", weak, train_budget)):
        write_sample(shuffled(rows, seed), path, dataset, split, BASE)
        base = read_base(spark, path, dataset, split).drop("pos")
        write_samples(budget_samples(base, [(budget, share) for share in neg_shares], seed), path, dataset, split)
