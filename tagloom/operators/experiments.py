"""Parameter grids, experiment status, nested metrics and summaries as tables."""

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.numbers import count_where
from tagloom.operators.ordering import with_position
from tagloom.sources.results import RECORD_SCHEMA, RESULTS_TYPE

# --- fixed values -----------------------------------------------------------------------------
_COMMON = {"datadir": ["./data"], "dataset": ["wiki", "tweets"], "outdir": ["./results"]}
_SIZES = {"class_imbalance": [50, 10, 5], "train_n": [20000], "test_n": [5000], "run_n": [3]}
_TF = {"framework": ["TF"], "transformer_model": ["./distilroberta-base"], "n_epochs": [3]}
_SK = {"framework": ["SK"], "sklearn_model": ["ConfidenceEnhancedLinearSVC"]}
_AL = {"init_n": [20, 200], "cold_strategy": ["TrueRandom", "BalancedWeak"], "query_n": [50, 100, 500]}
_SK_STRATEGIES = ["RandomSampling()", "LeastConfidence()"]
_TF_STRATEGIES = _SK_STRATEGIES + ["EmbeddingKMeans(normalize=True)", "GreedyCoreset(normalize=True)"]
GRIDS = {
    "SL_transformers": {"method": ["SL"], **_TF, **_COMMON, **_SIZES},
    "SL_sklearn": {"method": ["SL"], **_SK, **_COMMON, **_SIZES},
    "AL_transformers": {"method": ["AL"], **_TF, **_COMMON, **_SIZES, **_AL, "query_strategy": _TF_STRATEGIES},
    "AL_sklearn": {"method": ["AL"], **_SK, **_COMMON, **_SIZES, **_AL, "query_strategy": _SK_STRATEGIES},
}
SL_KEY = ["method", "framework", "dataset", "class_imbalance", "train_n"]
AL_KEY = [
    "method", "framework", "dataset", "class_imbalance", "init_n", "cold_strategy", "query_strategy", "query_n",
]
KINDS = ("START", "END", "FAILED")
STAMPED_NAME = r"^\w+?_(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})\.json$"
# ----------------------------------------------------------------------------------------------


def parameter_grid(spark: SparkSession, axes: dict[str, list], datasets: DataFrame | None = None) -> DataFrame:
    """Every combination of the axes, with its index `idx`.

    Axes are exploded one after the other, so there is no join; `idx` is the place in the product
    over the alphabetically sorted axes, last axis fastest, computed from the places on the axes
    without sorting. `datasets`, a table `<dataset>` of distinct names, replaces the dataset axis.
    """
    if datasets is None:
        grid = spark.range(1).select()
        n_datasets: Column | int = len(axes["dataset"])
    else:
        axes = {name: values for name, values in axes.items() if name != "dataset"}
        grid = with_position(datasets.select("dataset"), "dataset", 0, out="_at_dataset")
        n_datasets = datasets.agg(F.count(F.lit(1))).scalar()
    for name, values in axes.items():
        grid = grid.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_at_{name}", name))
    sizes = {name: len(values) for name, values in axes.items()} | {"dataset": n_datasets}
    idx = F.lit(0).cast("bigint")
    for name in sorted(sizes):
        idx = idx * sizes[name] + F.col(f"_at_{name}")
    return grid.select(*sorted(sizes), idx.alias("idx"))


def grid_size(axes: dict[str, list]) -> int:
    return prod(len(values) for values in axes.values())


def grid_slice(grid: DataFrame, first: int, last: int = -1) -> DataFrame:
    """Rows with `first <= idx < last`; -1 means to the end."""
    rows = grid.filter(F.col("idx") >= first)
    return rows if last == -1 else rows.filter(F.col("idx") < last)


def experiment_key(grid: DataFrame) -> Column:
    """Folder name of an experiment; supervised and active runs have different parts."""

    def joined(names: list[str]) -> Column:
        return F.concat_ws("_", *(F.col(name).cast("string") for name in names))

    supervised = joined(SL_KEY)
    if not set(AL_KEY) <= set(grid.columns):
        return supervised
    return F.when(F.col("method") == "SL", supervised).otherwise(joined(AL_KEY))


def job_name(key: Column) -> Column:
    """The key without brackets and without `=True`."""
    return F.regexp_replace(key, r"[()]|=True", "")


def pending(grid: DataFrame, folders: DataFrame) -> DataFrame:
    """Grid rows whose folder does not exist yet; a folder in any state is never run again."""
    return grid.withColumn("folder", experiment_key(grid)).join(folders.select("folder"), "folder", "left_anti")


def file_kind(file_name: Column) -> Column:
    """START, END, FAILED, or empty."""
    return F.regexp_extract(file_name, f"^({'|'.join(KINDS)})", 1)


def file_stamp(file_name: Column) -> Column:
    """Time in a result file name such as `END_20220101T100000.json`; NULL if there is none."""
    # A wall-clock time without zone, as in the name. Other names stay as they are and fail the cast.
    return F.regexp_replace(file_name, STAMPED_NAME, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")


def experiment_status(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """`<folder, n_start, n_end, n_failed, status>` from `<folder, file_name>`.

    Any END means done, else any FAILED means failed, else any START means running, else the folder
    is a non-starter. Folders that are neither supervised nor active runs are unknown. `expected`
    adds folders that hold no file at all, which a file listing cannot show.
    """
    kind = file_kind(F.col("file_name"))
    counts = files.groupBy("folder").agg(*(count_where(kind == name).alias(f"n_{name.lower()}") for name in KINDS))
    if expected is not None:
        counts = expected.select("folder").join(counts, "folder", "left").na.fill(0)
    status = (
        F.when(~F.col("folder").rlike("^(AL|SL)_"), "unknown")
        .when(F.col("n_end") >= 1, "done")
        .when(F.col("n_failed") >= 1, "failed")
        .when(F.col("n_start") >= 1, "running")
        .otherwise("non_starter")
    )
    return counts.withColumn("status", status)


def status_lists(statuses: DataFrame) -> DataFrame:
    """`<folder, list>`: the lists of failed, running and not started experiments, each by its own condition on the
    files of a folder that has no END."""
    lists = {
        "failed": F.col("n_failed") >= 1,
        "running": (F.col("n_start") >= 1) & (F.col("n_failed") == 0),
        "non_starter": F.col("n_start") == 0,
    }
    named = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in lists.items())))
    return statuses.filter("n_end = 0").select("folder", F.explode(named).alias("list"))


def overlapping(lists: DataFrame) -> DataFrame:
    """`<folder, n>`: folders on more than one list, such as one that failed without ever having started."""
    return lists.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def summarize(files: DataFrame) -> DataFrame:
    """One row per finished experiment, and per failed active one, from `<folder, file_name, content>`.

    Columns: the record (parameters, nested results, error), status, start and end time and run
    time in seconds. Failed experiments have no times. One aggregate: a folder is reduced to its
    first file of each kind before the shuffle.
    """
    kind = file_kind(F.col("file_name"))
    firsts = files.groupBy("folder").agg(
        *(
            F.min(F.when(kind == name, F.struct("file_name", "content"))).alias(name.lower())
            for name in KINDS
        )
    )
    is_active = F.col("folder").startswith("AL_")
    status = F.when(F.col("end").isNotNull(), "done").when(is_active & F.col("failed").isNotNull(), "failed")
    rows = firsts.withColumn("status", status).filter(F.col("status").isNotNull())
    done = F.col("status") == "done"  # never NULL here
    content = F.when(done, F.col("end.content")).otherwise(F.col("failed.content"))
    start = F.when(done, file_stamp(F.col("start.file_name")))
    end = F.when(done, file_stamp(F.col("end.file_name")))
    rows = rows.select(
        "folder",
        "status",
        start.alias("start_time"),
        end.alias("end_time"),
        F.from_json(content, RECORD_SCHEMA).alias("record"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    return rows.select("folder", "status", "start_time", "end_time", seconds.alias("run_seconds"), "record.*")


def parse_metrics(text: Column) -> Column:
    """Nested metrics from their JSON text."""
    return F.from_json(text, RESULTS_TYPE)


def metrics_long(df: DataFrame, results_col: str = "results_dict", keys: list[str] | None = None) -> DataFrame:
    """One row per run, iteration and metric from the nested map."""
    keys = keys or ["folder"]
    return (
        df.select(*keys, F.explode(results_col).alias("run", "_iterations"))
        .select(*keys, "run", F.explode("_iterations").alias("iteration", "_metrics"))
        .select(*keys, "run", "iteration", F.explode("_metrics").alias("metric", "value"))
    )


def stack_records(frames: list[DataFrame]) -> DataFrame:
    """Rows of several record tables; a column that one of them lacks is NULL there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def map_predictions(df: DataFrame, ids_col: str, predictions_col: str, source: DataFrame, id_col: str = "id"):
    """Predictions back on their source rows: two parallel arrays become rows, then an id join."""
    others = [name for name in df.columns if name not in (ids_col, predictions_col)]
    zipped = F.arrays_zip(F.col(ids_col).alias(id_col), F.col(predictions_col).alias("prediction"))
    rows = df.select(*others, F.inline(zipped).alias(id_col, "prediction"))
    return rows.join(source, id_col)
