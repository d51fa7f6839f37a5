"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. toxicity: documents whose score reaches the threshold go.
2. near_duplicates: of each group of linked fingerprints the document with the smallest id stays.
3. decontamination: documents with any window of the benchmark go.
4. personal_data: spans are replaced by their kind in brackets, and n_chars follows.
5. encode: every text as BPE ids, and decoded again.

Each stage works on all rows of the one before. A stage that lets documents go joins its verdicts back on the id and
the text, so rows without an id or with a repeated one are judged by their own text; rows that are equal in both go or
stay together, except that near_duplicates keeps one of them.

Defined cases: a null text is judged as an empty one and stays null until it is encoded (no ids, an empty text); all texts
without a word have the fingerprint zero, so one of them stays, the one with the smallest id; of linked documents the
smallest id stays and a row without an id goes before any with one; texts of any length are used whole; null lang, source
and n_chars are passed on, n_chars of texts that are cut becomes their new length; without labels nothing is toxic, without
benchmark nothing contaminated; tables without rows give none; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import bpe, decontaminate, pii, simhash, toxicity
from llm.registry import table
from llm.rows import join_rows, text_key
from tagloom.session import materialize, spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.with_scores(docs.select(*COLUMNS), model).filter(F.col("score") < toxicity.TOXIC_FROM).select(*COLUMNS)


def near_duplicates_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per component: the smallest id (nulls last), then the smallest text digest of that id."""
    keys = ["doc_id", "text_key"]
    found = simhash.near_duplicates(docs, key=True)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), *keys)
    kept = found.groupBy("root").agg(F.min(least).alias("k")).select("k.doc_id", "k.text_key")
    out = join_rows(docs.select(*COLUMNS, text_key().alias("text_key")), kept, keys, "left_semi")
    # Only rows that are equal in id and text meet again.
    twice = found.groupBy(*keys).count().filter("count > 1").select(*keys)
    if twice.limit(1).count():
        alone = join_rows(out, twice, keys, "left_anti")
        out = alone.unionByName(join_rows(out, twice, keys, "left_semi").dropDuplicates(keys))
    return out.select(*COLUMNS)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.contamination(docs, benchmark).filter("contaminated").select("doc_id", "text_key")
    keyed = docs.select(*COLUMNS, text_key().alias("text_key"))
    return join_rows(keyed, found, ["doc_id", "text_key"], "left_anti").select(*COLUMNS)


def personal_data_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.personal_data(docs).filter(F.size("spans") > 0).select("doc_id", "text_key", "spans").distinct()
    keyed = docs.select(*COLUMNS, text_key().alias("text_key"))
    joined = join_rows(keyed, found, ["doc_id", "text_key"])
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.masked(F.col("text"), F.col("spans")))
    masked = joined.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.col("spans").isNotNull().alias("__cut"))
    n_chars = F.when(F.col("__cut"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`<doc_id, n_tokens, ids, decoded>`"""
    return bpe.encode_documents(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encode", encode_stage),
]

# Fitted scores, linked components and tokenizer rules are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the `documents` in `sf_dir`."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
