"""Stateless cleaning and weak labels on a stream.

Every column function works on a streaming DataFrame unchanged. Dropping repeated text is left out:
on a stream, "the first" copy would be the first to arrive, not the one with the smallest id.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.clean import cleaned_rows, drop_missing
from tagloom.plans.corpus import add_weak_label


def clean_stream(rows: DataFrame, id_col: str = "id", text_col: str = "text", entities: str = "full") -> DataFrame:
    """`<id, clean_text, text_length>` of the rows that survive the stateless drops."""
    rows = cleaned_rows(drop_missing(rows, text_col).select(id_col, text_col), text_col, entities)
    return rows.select(id_col, "clean_text", F.length("clean_text").alias("text_length"))


def weak_label_stream(rows: DataFrame, keywords: list[str], threshold: float, id_col: str = "id") -> DataFrame:
    """`<id, norm_kw, weak_pos_keywords>` per incoming row."""
    return add_weak_label(rows, keywords, threshold).select(id_col, "norm_kw", "weak_pos_keywords")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and append it to Parquet, exactly once per input file."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
