"""Class counts and binary scores, all from conditional counts in one pass."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.numbers import count_where, ratio, round_even

CELLS = ("tn", "fp", "fn", "tp")


def class_balance(df: DataFrame, col: str = "label") -> DataFrame:
    """Rows, rows per class, positive share and which class is larger (a tie goes to negative)."""
    label = F.col(col)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(label == 1).alias("n_pos"),
        count_where(label == 0).alias("n_neg"),
        F.avg(label.cast("double")).alias("label_mean"),
    )
    return counts.withColumn("pos_share", round_even(ratio(F.col("n_pos"), F.col("n")), 3)).withColumn(
        "majority", F.when(F.col("n_neg") >= F.col("n_pos"), "negative").otherwise("positive")
    )


def class_shares(df: DataFrame, col: str = "label") -> DataFrame:
    """Rows and share of the whole per class; rows without a class do not count."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per class.
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def label_mean(df: DataFrame, col: str = "label", places: int | None = None) -> DataFrame:
    """Mean label, the measure of imbalance."""
    mean = F.avg(F.col(col).cast("double"))
    return df.agg((mean if places is None else round_even(mean, places)).alias("label_mean"))


def labelled_count(df: DataFrame, col: str = "label") -> DataFrame:
    """Rows that have a label."""
    return df.agg(F.count(col).alias("num_examples"))


def confusion_cells(label: Column, prediction: Column) -> list[Column]:
    """The four counts, in the order of `CELLS`. Rows without label or prediction do not count."""
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1)]
    return [count_where((label == a) & (prediction == b)).alias(name) for name, (a, b) in zip(CELLS, pairs)]


def score_columns(places: int | None = None) -> dict[str, Column]:
    """Scores from the columns of `CELLS`.

    Precision and F1 are macro means over the classes that occur as label or prediction; recall is
    that of the positive class. An empty denominator counts 0, except in the two error rates, where
    it gives NULL.
    """
    tn, fp, fn, tp = (F.col(name) for name in CELLS)
    one = F.lit(1)

    def macro(positive: Column, negative: Column) -> Column:
        has_pos, has_neg = (tp + fn + fp) > 0, (tn + fn + fp) > 0
        total = F.when(has_pos, positive).otherwise(0.0) + F.when(has_neg, negative).otherwise(0.0)
        return ratio(total, F.when(has_pos, one).otherwise(0) + F.when(has_neg, one).otherwise(0), empty=0)

    scores = {
        "accuracy": ratio(tn + tp, tn + fp + fn + tp, empty=0),
        "precision_macro": macro(ratio(tp, tp + fp, empty=0), ratio(tn, tn + fn, empty=0)),
        "recall_pos": ratio(tp, tp + fn, empty=0),
        "f1_macro": macro(ratio(2 * tp, 2 * tp + fp + fn, empty=0), ratio(2 * tn, 2 * tn + fp + fn, empty=0)),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }
    return {name: value if places is None else round_even(value, places) for name, value in scores.items()}


def binary_scores(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None, places=None
) -> DataFrame:
    """Confusion counts and scores per group."""
    cells = df.groupBy(*(by or [])).agg(*confusion_cells(F.col(label), F.col(prediction)))
    return cells.select("*", *(value.alias(name) for name, value in score_columns(places).items()))


def threshold_sweep(df: DataFrame, label: str, density: str, thresholds, places: int | None = 2) -> DataFrame:
    """Scores of the weak label at each threshold.

    One pass and one row per task: the counts of all thresholds are aggregated side by side and
    only then turned into rows.
    """
    aggregates = []
    for i, threshold in enumerate(thresholds):
        weak = F.when(F.col(density) > F.lit(float(threshold)), 1).otherwise(0)
        aggregates += [
            cell.alias(f"{name}_{i}") for name, cell in zip(CELLS, confusion_cells(F.col(label), weak))
        ]
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{name}_{i}").alias(name) for name in CELLS))
        for i, t in enumerate(thresholds)
    ]
    counts = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    return counts.select("*", *(value.alias(name) for name, value in score_columns(places).items()))


def set_scores(predictions: DataFrame, set_col: str = "test_set") -> DataFrame:
    """Macro F1, label mean and row count of every evaluated set, in one aggregate."""
    label = F.col("label")
    cells = predictions.groupBy(set_col).agg(
        *confusion_cells(label, F.col("prediction")),
        F.avg(label.cast("double")).alias("imbalance"),
        F.count(F.lit(1)).alias("n"),
    )
    return cells.select(set_col, score_columns()["f1_macro"].alias("f1"), "imbalance", "n")
