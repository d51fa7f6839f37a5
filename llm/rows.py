"""Keys for rows of a text table that hold in the face of null and repeated ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: str = "text") -> Column:
    """128 bits as hex that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def join_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which null equals null; the keys of `right` are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for key in keys:
        same = left[key].eqNullSafe(renamed[f"__{key}"])
        on = same if on is None else on & same
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__{key}" for key in keys]) if how not in ("left_semi", "left_anti") else joined
