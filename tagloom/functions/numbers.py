"""Small numeric column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, places: int = 0) -> Column:
    """Round half to even on the scaled double, as numpy does (0.125 -> 0.12, 0.575 -> 0.57)."""
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """`numerator / denominator`; `empty` (NULL by default) where the denominator is 0."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def count_where(condition: Column) -> Column:
    """Number of rows for which `condition` is true; NULL counts as false."""
    return F.count(F.when(condition, F.lit(1)))
