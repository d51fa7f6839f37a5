"""Labelled-text corpora: tab-separated inputs, keyword list, stored base sets and samples."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize

# --- fixed values -----------------------------------------------------------------------------
# Strings that mean "missing" in the text tables.
MISSING_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]
COMMENT_TYPES = {"rev_id": "bigint", "comment": "string", "split": "string"}
VOTE_TYPES = {"rev_id": "bigint", "attack": "double"}
TWEET_TYPES = {"tweet": "string", "label": "string", "vote": "int"}
TEST_SETS = ("base", "50", "10", "5")
# ----------------------------------------------------------------------------------------------

BASE = "base"
SAMPLE_KEYS = ["dataset", "split", "sample", "budget"]
SAMPLE_SCHEMA = (
    "id bigint, text string, label int, weak_label int, pos bigint, "
    "dataset string, split string, sample string, budget int"
)


def missing_to_null(value: Column) -> Column:
    """NULL for the strings that stand for a missing value."""
    return F.when(~value.isin(MISSING_STRINGS), value)


def _tsv(spark: SparkSession, multi_line: bool):
    # A quote inside a quoted field is doubled. The corpora mark newlines by a word of their own, so files are split
    # among tasks; with multi_line a quoted field may hold newlines, at the price of one task per file.
    return spark.read.options(sep="\t", quote='"', escape='"', encoding="UTF-8", multiLine=multi_line)


def _typed(name: str, kind: str) -> Column:
    """A text column with its type. A value that isn't of that type is an error, not a missing value."""
    value = F.col(name)
    if kind == "string":
        return missing_to_null(value).alias(name)
    value = missing_to_null(F.trim(value))
    typed = value.try_cast(kind)
    damaged = F.raise_error(F.concat(F.lit(f"damaged row, {name} is "), value)).cast(kind)
    return F.when(value.isNotNull() & typed.isNull(), damaged).otherwise(typed).alias(name)


def _by_name(table: DataFrame, types: dict[str, str]) -> DataFrame:
    """Named columns of a file with their types; other columns are not parsed further."""
    return table.select(*(_typed(name, kind) for name, kind in types.items()))


def read_comments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """`<rev_id, comment, split>` from a tab-separated file with header."""
    return _by_name(_tsv(spark, multi_line).csv(path, header=True), COMMENT_TYPES)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """`<rev_id, attack>`, many rows per comment, from a tab-separated file with header."""
    return _by_name(_tsv(spark, False).csv(path, header=True), VOTE_TYPES)


def with_content_id(df: DataFrame, out: str = "id") -> DataFrame:
    """Add an id that is the same in every job: a digest of the row, and a number among equal rows.

    The rows are stored with their digests, and only digests are counted. Rows that occur once stay where they are as long
    as the planner can broadcast the repeated digests; of repeated rows one of each is kept, before the shuffle if it can, and
    written out as often as it occurs.
    """
    rows = materialize(df.withColumn("_digest", F.sha2(F.to_json(F.struct(*df.columns)), 256)), "rows-by-content")
    counts = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    counts = materialize(counts, "repeated-rows")
    alone = rows.join(counts, "_digest", "left_anti").select(F.concat_ws(":", "_digest", F.lit(1)).alias(out), *df.columns)
    again = rows.join(counts.select("_digest"), "_digest", "left_semi").groupBy("_digest")
    again = again.agg(F.first(F.struct(*df.columns)).alias("_row")).join(counts, "_digest")
    numbers = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")
    again = again.select("_digest", "_row.*", numbers).select(F.concat_ws(":", "_digest", "_i").alias(out), *df.columns)
    return alone.unionByName(again)


def read_tweets(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """`<id, tweet, label, vote>` from a tab-separated file without header; names by position, `id` by content."""
    names = ", ".join(f"{name} string" for name in TWEET_TYPES)
    return with_content_id(_by_name(_tsv(spark, multi_line).schema(names).csv(path, header=False), TWEET_TYPES))


def read_keywords(spark: SparkSession, path: str, max_keywords: int = 50_000) -> list[str]:
    """Distinct non-empty lines, sorted. They become one pattern, so they are on the driver: more than `max_keywords`
    are an error, none are left out."""
    lines = spark.read.text(path).filter(F.col("value") != "").distinct()
    words = sorted(row["value"] for row in lines.limit(max_keywords + 1).collect())
    if len(words) > max_keywords:
        raise ValueError(f"more than {max_keywords} keywords in {path}")
    return words


def write_sample(df: DataFrame, path: str, dataset: str, split: str, sample: str, budget: int = 0) -> None:
    """Store one base set or sample as partitions; writing it again replaces it.

    `df` has `id, text, label, pos` and, for training sets, `weak_label`. `sample` is `base` or the
    positive percentage. The stored `pos` is what "the first rows" means later.
    """
    write_samples(df.withColumns({"sample": F.lit(sample), "budget": F.lit(int(budget))}), path, dataset, split)


def write_samples(df: DataFrame, path: str, dataset: str, split: str) -> None:
    """Store many samples, told apart by `sample` and `budget`, in one write; each replaces its own partition."""
    weak = F.col("weak_label") if "weak_label" in df.columns else F.lit(None)
    rows = df.select(
        "id", "text", F.col("label").cast("int").alias("label"), weak.cast("int").alias("weak_label"), "pos", "sample",
        F.col("budget").cast("int").alias("budget"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SAMPLE_KEYS).parquet(path)


def _samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).parquet(path)


def read_base(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """A stored base set, whole."""
    rows = _samples(spark, path).filter(
        (F.col("dataset") == dataset) & (F.col("split") == split) & (F.col("sample") == BASE) & (F.col("budget") == 0)
    )
    return rows.select("id", "text", "label", "weak_label", "pos")


def read_train(spark: SparkSession, path: str, dataset: str, train_n: int, pos_pct: int) -> DataFrame:
    """One sampled training set; only its partition is read."""
    rows = _samples(spark, path).filter(
        (F.col("dataset") == dataset)
        & (F.col("split") == "train")
        & (F.col("sample") == str(pos_pct))
        & (F.col("budget") == int(train_n))
    )
    return rows.select("id", "text", "label", "weak_label", "pos")


def read_tests(spark: SparkSession, path: str, dataset: str, test_n: int, sets=TEST_SETS) -> DataFrame:
    """The first `test_n` rows of each named test set, told apart by `test_set`."""
    rows = _samples(spark, path).filter(
        (F.col("dataset") == dataset)
        & (F.col("split") == "test")
        & F.col("sample").isin(list(sets))
        & (F.col("pos") < int(test_n))
    )
    return rows.select(F.concat(F.lit("test_"), "sample").alias("test_set"), "id", "text", "label", "pos")
