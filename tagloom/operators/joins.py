"""Joins of a large table with a lookup table that is unique on its key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than one in HEAD of all rows is split; there can be at most HEAD of them.
HEAD = 1_000
# Of a table that may be read twice, keys with more than one in FREQUENT of all rows are looked up where they lie.
FREQUENT = 500_000


def fits_broadcast(df: DataFrame) -> bool:
    """Do the planner's bytes for `df` (file sizes for a stored table) stay below its broadcast threshold?"""
    spark = df.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(threshold)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= limit


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    counts: str | None = None,
    spread_by: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join `big` with `lookup`, whatever the share of one key in `big`.

    The planner broadcasts `lookup` by its bytes if it is small enough. Beyond that, without `counts` no key is
    expected to be frequent (ids, say) and both sides are shuffled on it. With `counts`, a column of `lookup`
    that says how often each key occurs, every key with more than one in HEAD of all rows is cut into as many
    parts as its share asks for, by `spread_by`; only those keys of `lookup` are copied. A `stored` table is cheap to read
    twice: its rows with a frequent key meet a broadcast of those keys, and only the others, none of them frequent, are shuffled.
    """
    columns = [c for c in lookup.columns if c != counts]
    if counts is None or fits_broadcast(lookup):
        return big.join(lookup.select(columns), key, how)
    total = lookup.agg(F.sum(counts)).first()[0] or 0
    if stored:
        frequent = F.col(counts) * FREQUENT > F.lit(total)  # counts add up to the total: fewer than FREQUENT keys
        head = lookup.filter(frequent).select(columns)
        known = big.join(F.broadcast(head), key)
        others = big.join(F.broadcast(head.select(key)), key, "left_anti")
        return known.unionByName(others.join(lookup.filter(~frequent).select(columns), key, how))
    parts = F.ceil(F.col(counts) * HEAD / F.lit(max(total, 1))).cast("int")
    sized = lookup.withColumn("_parts", F.greatest(parts, F.lit(1)))
    # Proven size: counts add up to the total, so at most HEAD keys have more than one part.
    head = sized.filter("_parts > 1").select(key, F.col("_parts").alias("_split"))
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("_split", F.lit(1))).cast("int")
    salted = big.join(F.broadcast(head), key, "left").withColumn("_salt", salt).drop("_split")
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", counts)
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
