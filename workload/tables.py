"""Sources and sinks: tables written in the corpus layouts and read back."""

from pyspark.sql import functions as F

from tagloom.operators.experiments import GRIDS, parameter_grid
from tagloom.operators.sampling import budget_samples, class_sizes, shuffled
from tagloom.plans.corpus import add_weak_label
from tagloom.session import materialize, new_path
from tagloom.sources.corpora import (
    BASE,
    read_comments,
    read_keywords,
    read_tests,
    read_train,
    read_tweets,
    read_votes,
    write_sample,
    write_samples,
)
from tagloom.sources.results import read_grid, write_grid
from workload.experiments import sql_grid
from workload.registry import KEYWORDS, LABELLED, labelled_documents, query, sql_rank, table, texts
from workload.sampling import SEED, WEAK, sql_budget_sample


def _write_tsv(df, path: str, header: bool) -> None:
    options = {"sep": "\t", "quote": '"', "escape": '"', "quoteAll": True, "encoding": "UTF-8"}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options, **blanks).csv(path, header=header)


@query("comments_round_trip", "SELECT doc_id AS rev_id, text AS comment, nullif(source, 'src1') AS split FROM documents")
def comments_round_trip(spark, folder):
    """A column more than needed, line breaks inside quotes, and a missing value spelled out."""
    path = new_path(spark, "comments")
    split = F.when(F.col("source") == "src1", "NA").otherwise(F.col("source"))
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("rev_id"), F.col("lang").alias("ns"), F.col("text").alias("comment"), split.alias("split")
    )
    _write_tsv(rows, path, header=True)
    return read_comments(spark, path, multi_line=True)


@query("votes_round_trip", "SELECT l_orderkey AS rev_id, (l_returnflag = 'R')::INT::DOUBLE AS attack FROM lineitem")
def votes_round_trip(spark, folder):
    path = new_path(spark, "votes")
    attack = (F.col("l_returnflag") == "R").cast("int").cast("double")
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("rev_id"), attack.alias("attack"))
    _write_tsv(rows, path, header=True)
    return read_votes(spark, path)


@query("tweets_round_trip", "SELECT text AS tweet, role AS label, turn::INT AS vote FROM conversations")
def tweets_round_trip(spark, folder):
    path = new_path(spark, "tweets")
    rows = table(spark, folder, "conversations").select("text", "role", "turn")
    _write_tsv(rows, path, header=False)
    return read_tweets(spark, path, multi_line=True).drop("id")


@query("keywords_round_trip", "SELECT DISTINCT source AS word FROM documents")
def keywords_round_trip(spark, folder):
    path = new_path(spark, "keywords")
    sources = table(spark, folder, "documents").select(F.col("source").alias("word"))
    sources.write.text(path)
    return sources.filter(F.col("word").isin(read_keywords(spark, path))).distinct()


@query(
    "samples_round_trip",
    f"""SELECT 'train' AS part, id, label, weak_label, pos FROM ({sql_budget_sample(0.9)}) JOIN ({WEAK}) w USING (id, label)
    UNION ALL SELECT 'test_base', id, label, NULL, pos FROM (
      SELECT id, label, {sql_rank('id', str(SEED))} - 1 AS pos FROM ({LABELLED})) WHERE pos < 30
    UNION ALL SELECT 'test_50', id, label, NULL, pos FROM ({sql_budget_sample(0.5)}) WHERE pos < 30""",
)
def samples_round_trip(spark, folder):
    path = new_path(spark, "samples")
    rows = add_weak_label(labelled_documents(spark, folder, texts), KEYWORDS, 0.01)
    rows = materialize(rows.select("id", "text", "label", F.col("weak_pos_keywords").alias("weak_label")), "weak-rows")
    budget = class_sizes(rows, "label")[1]
    samples = materialize(budget_samples(rows, [(budget, 0.9), (budget, 0.5)], SEED), "drawn")
    write_samples(samples.filter("sample = '10'"), path, "docs", "train")
    write_sample(shuffled(rows.drop("weak_label"), SEED), path, "docs", "test", BASE)
    write_samples(samples.filter("sample = '50'").drop("weak_label"), path, "docs", "test")
    train = read_train(spark, path, "docs", budget, 10)
    tests = read_tests(spark, path, "docs", 30)
    columns = ["part", "id", "label", "weak_label", "pos"]
    train = train.withColumn("part", F.lit("train")).select(columns)
    tests = tests.withColumns({"part": F.col("test_set"), "weak_label": F.lit(None).cast("int")}).select(columns)
    return train.unionByName(tests)


@query("params_round_trip", sql_grid(GRIDS["AL_sklearn"], "SELECT DISTINCT lang AS dataset FROM documents"))
def params_round_trip(spark, folder):
    path = new_path(spark, "params")
    languages = table(spark, folder, "documents").select(F.col("lang").alias("dataset")).distinct()
    write_grid(parameter_grid(spark, GRIDS["AL_sklearn"], languages), path)
    return read_grid(spark, path).withColumn("idx", F.col("idx").cast("bigint"))
