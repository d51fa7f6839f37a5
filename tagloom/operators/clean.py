"""Row filters, keep-first dedup, the cleaning order, and its reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.numbers import count_where
from tagloom.functions.text import EMOJI, URL, clean_text, only_mark
from tagloom.session import bucketed, buckets_for, materialize


def drop_missing(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop rows whose text is NULL."""
    return df.dropna(subset=[col])


def drop_empty(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Drop rows whose text is empty; NULL stays."""
    return df.filter(F.col(col).isNull() | (F.col(col) != ""))


def drop_only_marks(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Drop rows that are exactly one link or one emoji mark; NULL stays."""
    return df.filter(F.col(col).isNull() | ~only_mark(F.col(col)))


def text_digest(text: Column) -> Column:
    """Stand-in for the text in shuffles: 32 bytes that differ when the texts differ."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class RepeatedIds(ValueError):
    """An id stands for more than one row."""


def repeated_rows(df: DataFrame, col: str = "clean_text", id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """`<id>` of the rows whose text already occurs with a smaller id. An id that occurs twice is an error.

    Only ids and digests are shuffled, and they are stored, so the texts are read once for it. The smallest id per
    digest is combined before the shuffle, so a text that fills a third of the table costs one row per task.
    """
    keys = df.select(id_col, text_digest(F.col(col)).alias("_digest"))
    keys = bucketed(keys, "digests", buckets, id_col) if buckets else materialize(keys, "digests")
    twice = keys.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise RepeatedIds(f"{id_col} {twice[0][0]} stands for {twice[0]['n']} rows")
    firsts = keys.groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Rows without a text share a NULL digest; like any other repeated text they leave their first row.
    same = keys["_digest"].eqNullSafe(firsts["_digest"])
    return keys.join(firsts.select("_digest", "_first"), same).filter(F.col(id_col) > F.col("_first")).select(id_col)


def store_by_id(df: DataFrame, id_col: str = "id", name: str = "by-id") -> tuple[DataFrame, int]:
    """The rows as a table in buckets of their ids, and the number of buckets: the one time that texts are moved."""
    buckets = buckets_for(df)
    return bucketed(df.repartition(buckets, id_col), name, buckets, id_col), buckets


def keep_first(df: DataFrame, col: str = "clean_text", id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """Of the rows with equal text keep the one with the smallest id.

    The losers are stored by id and left out. Texts stay where they are if the planner can broadcast that table. For a table in
    `buckets` of its ids, as `store_by_id` makes it, they stay where they are however many lose: losers go to the bucket
    that their rows are in.
    """
    losers = repeated_rows(df, col, id_col, buckets)
    if buckets:
        losers = bucketed(losers.repartition(buckets, id_col), "repeated", buckets, id_col)
    else:
        losers = materialize(losers, "repeated")
    return df.join(losers, id_col, "left_anti")


def clean_rows(
    df: DataFrame, id_col: str = "id", text_col: str = "text", entities: str = "full", buckets: int | None = None
) -> DataFrame:
    """Missing, repeated raw text, cleaning, empty, marks only, length: in that order. `buckets` as for `keep_first`."""
    rows = keep_first(drop_missing(df, text_col), text_col, id_col, buckets)
    return cleaned_rows(rows, text_col, entities).withColumn("text_length", F.length("clean_text"))


def cleaned_rows(df: DataFrame, text_col: str = "text", entities: str = "full") -> DataFrame:
    """Add `clean_text` and drop the rows where it is empty or marks only; NULL text is dropped too.

    The same as `drop_only_marks(drop_empty(..))`, but a filter on a computed column is pushed below
    it and cleans each text again for every condition. Exploding a filtered one-element array
    cleans it once.
    """
    kept = F.filter(F.array(clean_text(F.col(text_col), entities)), lambda text: ~(only_mark(text) | (text == "")))
    others = [name for name in df.columns if name != "clean_text"]
    return df.select(*others, F.explode(kept).alias("clean_text"))


def stage_report(df: DataFrame, text_col: str = "text", entities: str = "full") -> DataFrame:
    """Rows in, dropped and kept for each dropping step of `clean_rows`, in one pass.

    Cleaning depends on the text alone, so its outcome is reduced to two flags before the shuffle;
    after it there is one small row per distinct text.
    """
    text = F.col(text_col)
    # One lookup, so that the text is cleaned once: 1 for empty, 2 for marks only, else NULL.
    outcomes = F.create_map(F.lit(""), F.lit(1), F.lit(URL), F.lit(2), F.lit(EMOJI), F.lit(2))
    cleaned = df.select(
        text_digest(text).alias("digest"), F.element_at(outcomes, clean_text(text, entities)).alias("outcome")
    )
    distinct = cleaned.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("outcome").alias("outcome"))
    distinct = distinct.select(
        "digest",
        "copies",
        F.col("outcome").eqNullSafe(1).alias("empty"),
        F.col("outcome").eqNullSafe(2).alias("marks"),
    )
    known = F.col("digest").isNotNull()
    totals = distinct.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("copies"))), F.lit(0)).alias("missing"),
        count_where(known).alias("texts"),
        count_where(known & F.col("empty")).alias("empty"),
        count_where(known & F.col("marks")).alias("marks"),
    )
    present = F.col("n") - F.col("missing")
    filled = F.col("texts") - F.col("empty")
    steps = [
        (1, "missing", F.col("n"), present),
        (2, "duplicate", present, F.col("texts")),
        (3, "empty", F.col("texts"), filled),
        (4, "marks_only", filled, filled - F.col("marks")),
    ]
    return totals.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(step).alias("step"),
                        F.lit(name).alias("stage"),
                        before.alias("rows_in"),
                        (before - after).alias("dropped"),
                        after.alias("kept"),
                    )
                    for step, name, before, after in steps
                )
            )
        )
    )


def length_summary(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (linear) and maximum of the text length.

    Lengths are counted first. What remains has one row per distinct length, so the exact
    percentiles work on a small table, and the sums behind mean and deviation are whole numbers.
    """
    size, weight = F.col("size"), F.col("weight")
    sizes = df.filter(F.col(col).isNotNull()).groupBy(F.length(col).cast("long").alias("size"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("weight"))
    wide = "decimal(38,0)"
    totals = sizes.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("n"),
        F.sum((size * weight).cast(wide)).alias("total"),
        F.sum((size * size).cast(wide) * weight.cast("decimal(18,0)")).alias("squares"),
        F.min("size").alias("min_len"),
        F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), weight).alias("quartiles"),
        F.max("size").alias("max_len"),
    )
    n, total, squares = (F.col(name).cast("double") for name in ("n", "total", "squares"))
    return totals.select(
        "n",
        F.try_divide(total, n).alias("mean_len"),
        F.sqrt(F.try_divide(squares - F.try_divide(total * total, n), n - 1)).alias("std_len"),
        "min_len",
        F.col("quartiles")[0].alias("q25"),
        F.col("quartiles")[1].alias("q50"),
        F.col("quartiles")[2].alias("q75"),
        "max_len",
    )
