"""Labels: votes, categories, joins with items, splits by a stored column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
NEGATIVE_CATEGORIES = ("spam", "normal")
NO_LABEL = -1
TEST_SPLIT = "test"


def majority_vote(votes: DataFrame, item_col: str, vote_col: str) -> DataFrame:
    """`<item, label>`: 1 where the mean vote is strictly above one half. Missing votes are skipped."""
    vote = F.col(vote_col).cast("double")
    known = F.when(~F.isnan(vote), vote)  # NaN would count as larger than everything
    return votes.groupBy(item_col).agg((F.avg(known) > 0.5).cast("int").alias("label"))


def attach_labels(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is unique in `labels`; items without votes get NULL."""
    return items.join(labels, key, "left")


def binarize(category: Column, negatives: tuple[str, ...] = NEGATIVE_CATEGORIES) -> Column:
    """0 for the listed categories, 1 for everything else, a missing category included."""
    return F.when(category.isin(*negatives), 0).otherwise(1)


def split_stored(df: DataFrame, col: str = "split", test: str = TEST_SPLIT) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a stored column; rows without a split belong to train."""
    is_test = F.col(col).eqNullSafe(F.lit(test))
    return df.filter(~is_test), df.filter(is_test)


def by_label(df: DataFrame, value: int, col: str = "label") -> DataFrame:
    """Rows with this label; rows without a label belong to no class."""
    return df.filter(F.col(col) == value)


def label_or_sentinel(label: Column, sentinel: int = NO_LABEL) -> Column:
    """Missing label to -1."""
    return F.coalesce(label, F.lit(sentinel))


def replace_column(df: DataFrame, new: DataFrame, id_col: str, col: str) -> DataFrame:
    """Take `col` (features or labels) from `new`, every other column from `df`.

    Ids that `new` lacks keep their value; a NULL in `new` is a value and replaces the old one.
    """
    fresh = new.select(id_col, F.col(col).alias("_new"), F.lit(True).alias("_has"))
    value = F.when(F.col("_has"), F.col("_new")).otherwise(F.col(col))
    columns = [value.alias(col) if name == col else F.col(name) for name in df.columns]
    return df.join(fresh, id_col, "left").select(*columns)


def label_domain(df: DataFrame, col: str = "label") -> DataFrame:
    """One row: the sorted distinct labels and their number."""
    domain = F.array_sort(F.collect_set(col))
    return df.agg(domain.alias("labels"), F.size(domain).alias("n_labels"))
