"""Repeatable random order and exact selection from it, without a global sort.

The random order of a row is `md5(id:seed)`, then the id. Because md5 is uniform, its first hex
digits cut the rows into even buckets. Counting rows per bucket gives, from a small table, the
position at which every bucket starts; the rest is work inside single buckets:

* `with_position` numbers all rows 0..n-1 with one window per bucket;
* `flag_first` finds the n-th key from the one bucket that holds it, and is then a plain filter on
  the full rows, which are never shuffled.

The input is read three times, twice for its ids and groups alone; store it first if it is costly to
compute. Ids must be unique. Groups are classes (labels, strata); as long as their table of buckets is below the
planner's broadcast threshold the full rows stay where they are, beyond it they meet it by a shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.joins import fits_broadcast
from tagloom.session import materialize

PREFIX_DIGITS = 4  # 16**4 buckets: the size bound of the bucket table, per group
GROUP_SIZE = "group_size"

KEY, BUCKET, COUNT, START, QUOTA = "_key", "_bucket", "_count", "_start", "_quota"


def random_key(id_col: str | Column, seed) -> Column:
    """The md5 order key; `seed` is a value or a column."""
    id_value = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_value = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", id_value.cast("string"), seed_value).cast("binary"))


def _keyed(df: DataFrame, id_col: str, seed) -> DataFrame:
    return df.withColumn(KEY, random_key(id_col, seed)).withColumn(BUCKET, F.substring(KEY, 1, PREFIX_DIGITS))


def _bucket_starts(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """Rows per (group, bucket) and the number of rows of the group in earlier buckets."""
    counts = keyed.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias(COUNT))
    earlier = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(START, F.coalesce(F.sum(COUNT).over(earlier), F.lit(0))).withColumn(
        GROUP_SIZE, F.sum(COUNT).over(Window.partitionBy(*groups))
    )


def with_position(df: DataFrame, id_col: str, seed, groups: list[str] | None = None, out: str = "pos") -> DataFrame:
    """Add the 0-based place of each row in the random order (of its group)."""
    keyed = _keyed(df, id_col, seed).withColumn("_all", F.lit(0))
    groups = list(groups or ["_all"])
    starts = _bucket_starts(keyed, groups).select(*groups, BUCKET, START)
    within = Window.partitionBy(*groups, BUCKET).orderBy(KEY, id_col)
    names = [*groups, BUCKET]
    starts = starts.select(*(F.col(name).alias(f"_at_{name}") for name in names), START)
    same = keyed[names[0]].eqNullSafe(starts[f"_at_{names[0]}"])  # rows without a group form one
    for name in names[1:]:
        same = same & keyed[name].eqNullSafe(starts[f"_at_{name}"])
    return (
        keyed.join(starts, same)
        .withColumn(out, F.col(START) + F.row_number().over(within) - 1)
        .select(*df.columns, out)
    )


def flag_first(df: DataFrame, id_col: str, seed, n, group: str | None = None, out: str = "picked") -> DataFrame:
    """Add a boolean: is the row among the first `n` of its group in the random order?

    `n` is a number; or a column over the group column and `GROUP_SIZE`, the rows of the group; or a
    DataFrame `<group, n>`, where groups without a row get none. Without `group` all rows form one
    group.
    """
    whole = group is None
    group = group or "_all"
    keyed = _keyed(df, id_col, seed).withColumn("_all", F.lit(0))
    starts = _bucket_starts(keyed.select(group, BUCKET), [group])
    if isinstance(n, DataFrame):
        starts = starts.join(n.select(group, F.col("n").cast("long").alias(QUOTA)), group)
    else:
        starts = starts.withColumn(QUOTA, (n if isinstance(n, Column) else F.lit(int(n))).cast("long"))
    # Stored, so that the planner knows its bytes; what follows has at most one row per group and is smaller.
    starts = materialize(starts, "bucket-starts")
    small = fits_broadcast(starts)
    # The bucket of each group in which its quota, or else the group, runs out: at most one per group.
    quota = F.least(QUOTA, GROUP_SIZE)
    edge = starts.withColumn(QUOTA, quota).filter(
        (F.col(START) < F.col(QUOTA)) & (F.col(START) + F.col(COUNT) >= F.col(QUOTA))
    )
    # The last row taken, from the rows of those buckets only.
    within = Window.partitionBy(group).orderBy(KEY, id_col)
    last = (
        keyed.select(group, KEY, BUCKET, id_col)
        .join(edge.select(group, BUCKET, START, QUOTA), [group, BUCKET])
        .withColumn("_rank", F.col(START) + F.row_number().over(within))
        .filter(F.col("_rank") == F.col(QUOTA))
        .select(group, F.struct(F.col(KEY).alias("key"), F.col(id_col).alias("id")).alias("_last"))
    )
    if whole:  # one row: a scalar subquery instead of a join
        limit = last.agg(F.min("_last")).scalar()
    else:
        limit = F.col("_last")
        keyed = keyed.join(F.broadcast(last) if small else last, group, "left")
    inside = F.struct(F.col(KEY).alias("key"), F.col(id_col).alias("id")) <= limit
    return keyed.withColumn(out, F.coalesce(inside, F.lit(False))).select(*df.columns, out)


def take_first(df: DataFrame, id_col: str, seed, n, group: str | None = None) -> DataFrame:
    """Exactly the first `n` rows of the random order (per group); all of a smaller group."""
    return flag_first(df, id_col, seed, n, group, "_picked").filter("_picked").drop("_picked")
