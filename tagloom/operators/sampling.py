"""Exact, repeatable samples and splits.

Every draw takes the first rows of the md5 order (see `ordering`), so it depends on ids and seed
only, never on partitioning. Draws that cannot be met raise before anything is sampled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.numbers import count_where
from tagloom.operators.ordering import GROUP_SIZE, flag_first, take_first, with_position
from tagloom.session import materialize

# Fixed values
NEG_SHARES = (0.95, 0.9, 0.5)
TRAIN_BUDGET, TEST_BUDGET = 20_000, 5_000
TEST_SHARE, SPLIT_SEED = 0.101, 42
VALIDATION_SHARE = 0.1


class TooFewRows(ValueError):
    """A class has fewer rows than the draw asks for."""


def class_sizes(df: DataFrame, col: str) -> dict[int, int]:
    """Rows with label 0 and with label 1; one small aggregate."""
    label = F.col(col)
    row = df.agg(count_where(label == 0).alias("neg"), count_where(label == 1).alias("pos")).first()
    return {0: row["neg"], 1: row["pos"]}


def per_class(col: str, n_neg: int, n_pos: int) -> Column:
    """Quota of the row's class; rows without a class get none."""
    return F.when(F.col(col) == 0, n_neg).when(F.col(col) == 1, n_pos).otherwise(0)


def _require(sizes: dict[int, int], n_neg: int, n_pos: int) -> None:
    if sizes[0] < n_neg or sizes[1] < n_pos:
        raise TooFewRows(f"asked for {n_neg} negatives and {n_pos} positives, have {sizes[0]} and {sizes[1]}")


def budget_parts(budget: int, neg_share: float) -> tuple[int, int, int]:
    """(negatives, positives, positive percentage used in names) of a sample."""
    n_neg = int(neg_share * budget)
    return n_neg, budget - n_neg, 100 - int(neg_share * 100)


def budget_sample(
    df: DataFrame, budget: int, neg_share: float, seed=0, id_col: str = "id", label_col: str = "label"
) -> DataFrame:
    """`budget` rows at a fixed class ratio, without replacement, in shuffled order `pos`.

    The share is part of the seed, because samples of different shares are drawn independently.
    """
    n_neg, n_pos, _ = budget_parts(budget, neg_share)
    seed = f"{seed}:{neg_share}"
    # Ids and labels are stored once and drawn from; the other columns are fetched last, for the sample alone.
    keys = materialize(df.select(id_col, label_col), "labels")
    _require(class_sizes(keys, label_col), n_neg, n_pos)
    drawn = take_first(keys, id_col, seed, per_class(label_col, n_neg, n_pos), label_col)
    ordered = with_position(materialize(drawn.select(id_col), "sample"), id_col, f"{seed}:order")
    return df.join(materialize(ordered, "ordered-sample"), id_col).select(*df.columns, "pos")


def budget_samples(
    df: DataFrame, samples: list[tuple[int, float]], seed=0, id_col: str = "id", label_col: str = "label"
) -> DataFrame:
    """Many samples in one draw: the rows of `budget_sample` for every (budget, share) in `samples`, one after the other,
    with `sample` (the positive percentage), `budget` and `pos`.

    A row is looked at once for all samples, by id and label alone: it gets a copy per sample, whose seed, class and quota
    decide. The other columns are fetched once, for the rows that some sample takes.
    """
    spark = df.sparkSession
    keys = materialize(df.select(id_col, label_col), "labels")
    sizes = class_sizes(keys, label_col)
    parts = [(budget, share, *budget_parts(budget, share)) for budget, share in samples]
    for _, _, n_neg, n_pos, _ in parts:
        _require(sizes, n_neg, n_pos)
    draws = F.array(*[F.struct(F.lit(at).alias("_draw"), F.lit(f"{seed}:{part[1]}").alias("_seed")) for at, part in enumerate(parts)])
    copies = keys.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_class"), F.inline(draws))
    copies = copies.withColumn("_group", F.concat_ws(":", "_draw", "_class"))
    quotas = [(f"{at}:{c}", part[2 + c]) for at, part in enumerate(parts) for c in (0, 1)]
    quotas = spark.createDataFrame(quotas, "_group string, n bigint")
    drawn = take_first(copies, id_col, F.col("_seed"), quotas, "_group").select(id_col, "_draw", "_seed")
    order = F.concat(F.col("_seed"), F.lit(":order"))
    ordered = with_position(materialize(drawn, "samples"), id_col, order, ["_draw"])
    named = F.array(*[F.struct(F.lit(str(part[4])).alias("sample"), F.lit(part[0]).alias("budget")) for part in parts])
    ordered = ordered.select(id_col, F.get(named, F.col("_draw")).alias("_named"), "pos")
    ordered = materialize(ordered.select(id_col, "_named.sample", "_named.budget", "pos"), "ordered-samples")
    return df.join(ordered, id_col).select(*df.columns, "sample", "budget", "pos")


def shuffled(df: DataFrame, seed=0, id_col: str = "id") -> DataFrame:
    """All rows with their place `pos` in the random order."""
    return with_position(df, id_col, seed)


def flag_test(df: DataFrame, share: float = TEST_SHARE, seed=SPLIT_SEED, id_col: str = "id") -> DataFrame:
    """Add `is_test` for exactly `ceil(share * rows)` rows."""
    return flag_first(df, id_col, seed, F.ceil(F.lit(share) * F.col(GROUP_SIZE)), out="is_test")


def random_split(df: DataFrame, share: float = TEST_SHARE, seed=SPLIT_SEED, id_col: str = "id"):
    """(train, test) with exactly `ceil(share * rows)` test rows."""
    flagged = flag_test(df, share, seed, id_col)
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")


def cold_start(
    df: DataFrame, strategy: str, n: int, seed=0, id_col="id", label_col="label", weak_col="weak_label"
) -> DataFrame:
    """The first `n` rows to label.

    `TrueRandom` draws from all labelled rows, `BalancedRandom` half of each true class,
    `BalancedWeak` half of each weak class; if there are too few weak positives it takes them all
    and fills up with weak negatives.
    """
    half = int(n / 2)
    if strategy == "TrueRandom":
        pool = df.filter(F.col(label_col).isin(0, 1))
        have = sum(class_sizes(pool, label_col).values())
        if have < n:
            raise TooFewRows(f"asked for {n} rows, have {have}")
        return take_first(pool, id_col, seed, n)
    if strategy == "BalancedRandom":
        _require(class_sizes(df, label_col), half, half)
        return take_first(df, id_col, seed, per_class(label_col, half, half), label_col)
    if strategy == "BalancedWeak":
        sizes = class_sizes(df, weak_col)
        n_neg, n_pos = (half, half) if sizes[1] > half else (n - sizes[1], sizes[1])
        _require(sizes, n_neg, n_pos)
        return take_first(df, id_col, seed, per_class(weak_col, n_neg, n_pos), weak_col)
    raise ValueError(f"unknown cold start strategy: {strategy}")


def flag_al_validation(initial: DataFrame, init_n: int, seed=0, id_col="id", label_col="label") -> DataFrame:
    """Add `is_valid` to `int(0.1 * init_n / 2)` rows of each true class of the initial set."""
    n = int(VALIDATION_SHARE * (init_n / 2))
    _require(class_sizes(initial, label_col), n, n)
    return flag_first(initial, id_col, f"{seed}:valid", per_class(label_col, n, n), label_col, out="is_valid")


def flag_sl_validation(df: DataFrame, seed=0, id_col="id", label_col="label") -> DataFrame:
    """Add `is_valid` to a tenth of each class, rounded down."""
    classes = df.filter(F.col(label_col).isin(0, 1))
    quota = F.floor(F.lit(VALIDATION_SHARE) * F.col(GROUP_SIZE))
    return flag_first(classes, id_col, f"{seed}:valid", quota, label_col, out="is_valid")


def _class_quotas(df: DataFrame, label_col: str, share: float, stratified: bool) -> DataFrame:
    """`<label, n>` with n adding up to the validation size.

    Stratified: proportional, the largest remainders rounded up. Balanced: equal, the first classes
    take what is left over. All windows here see one row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(everything)
    sizes = counts.withColumn("wanted", total - F.floor(total * F.lit(1 - share)))
    if stratified:
        part = F.expr("wanted * size div sum(size) over (partition by 0)")
        rest = F.expr("wanted * size % sum(size) over (partition by 0)")
    else:
        part = F.expr("wanted div count(*) over (partition by 0)")
        rest = F.lit(0)
    parts = sizes.withColumn("part", part).withColumn("rest", rest)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), label_col)
    missing = F.col("wanted") - F.sum("part").over(everything)
    n = F.col("part") + F.when(F.row_number().over(order) <= missing, 1).otherwise(0)
    return parts.select(label_col, "size", n.alias("n"))


def split_data(
    df: DataFrame, strategy: str = "random", share: float = VALIDATION_SHARE, seed=0, id_col="id", label_col="label"
) -> DataFrame:
    """Add `is_valid`; `int(rows * (1 - share))` rows stay for training."""
    if strategy == "random":
        quota = F.floor(F.col(GROUP_SIZE) * F.lit(1 - share))
        return flag_first(df, id_col, seed, quota, out="is_train").withColumn("is_valid", ~F.col("is_train")).drop(
            "is_train"
        )
    if strategy not in ("balanced", "stratified"):
        raise ValueError(f"unknown split strategy: {strategy}")
    quotas = _class_quotas(df, label_col, share, strategy == "stratified")
    short = quotas.filter("size < n").first()
    if short:
        raise TooFewRows(f"class {short[0]} has {short['size']} rows, {short['n']} asked for")
    return flag_first(df, id_col, seed, quotas, label_col, out="is_valid")


def head(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """First `n` rows of a stored order: a filter the Parquet scan can apply by itself."""
    return df.filter(F.col(pos_col) < n)
