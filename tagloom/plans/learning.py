"""Label, train, score: supervised runs on everything and active runs that grow a labelled set.

Each round writes the rows it picked, features included, to the shared folder, and the next round
reads them back. Lineage therefore never grows with the number of rounds, training never scans the
pool, and a lost executor costs one task, not the run.
"""

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from math import ceil

from pyspark.ml import Estimator, Model
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.epochs import EpochClassifier
from tagloom.operators.experiments import experiment_key
from tagloom.operators.features import fit_transform_tfidf_vectors
from tagloom.operators.metrics import set_scores
from tagloom.operators.sampling import TooFewRows, class_sizes, cold_start, flag_al_validation, flag_sl_validation
from tagloom.operators.select import (
    coreset_query,
    kmeans_query,
    least_confident,
    random_query,
    rows_by_id,
    unlabelled,
)
from tagloom.operators.svm import SquaredHingeSVM
from tagloom.session import materialize, new_path
from tagloom.sources.corpora import read_tests, read_train
from tagloom.sources.results import write_run_table, write_status

# Fixed values
LABEL_BUDGET = 2_000
TRAIN_SET = "train"
ROWS_PER_TASK = 2_000
STAMP = "%Y%m%dT%H%M%S"


@dataclass(frozen=True)
class Settings:
    """One run. `framework` SK is the SVM on text features, TF a classifier on embeddings."""

    method: str = "AL"
    framework: str = "SK"
    init_n: int = 20
    cold_strategy: str = "TrueRandom"
    query_n: int = 100
    query_strategy: str = "RandomSampling()"
    budget: int = LABEL_BUDGET
    seed: int = 0


@dataclass
class Round:
    """What a query strategy may look at."""

    pool: DataFrame  # unlabelled rows
    labelled: DataFrame
    model: Model
    n: int
    seed: str
    vector_col: str | None = None


# --- classifiers: functions from the number of training rows to an estimator -------------------


def svm(n_rows: int) -> Estimator:
    """Linear SVM with squared hinge loss and a cost of 1 per training row."""
    return SquaredHingeSVM(cost=1.0)


def logistic(n_rows: int, n_epochs: int = 3) -> Estimator:
    """Two-class classifier for embedding features, which keeps the epoch that is best on held-out rows."""
    return EpochClassifier(n_epochs)


def fit(classifier: Callable[[int], Estimator], rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> Model:
    """Fit on `<id, label, features>`. Rows flagged `is_valid` are held out; classifiers that choose by them get them as well.
    An SVM needs both classes. `rows_per_task` is for other estimators: it says how small a labelled set may be per
    task before it is put into fewer; wide rows want fewer rows in a task."""
    train = rows.filter(~F.col("is_valid")) if "is_valid" in rows.columns else rows
    sizes = class_sizes(train, "label")
    n_rows = sum(sizes.values())
    estimator = classifier(n_rows)
    if isinstance(estimator, SquaredHingeSVM):
        if not (sizes[0] and sizes[1]):
            raise TooFewRows(f"training needs both classes, have {sizes}")
        return estimator.fit(train)  # puts its rows into blocks itself
    if getattr(estimator, "holds_out", False):
        return estimator.fit(rows)
    train = train.select(F.col("label").cast("double").alias("label"), "features")
    # Other solvers run one job per step. A labelled set of a few thousand rows belongs in one task; a large
    # one has more partitions than this and keeps them as they are, since coalesce never adds any.
    return estimator.fit(train.coalesce(ceil(n_rows / rows_per_task) or 1))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """Add `prediction` (0/1) and `confidence`, the absolute margin, which orders rows as the
    probability of the predicted class does."""
    margin = F.abs(vector_to_array("rawPrediction")[1])
    scored = model.transform(rows)
    return scored.withColumns({"prediction": F.col("prediction").cast("int"), "confidence": margin}).select(
        *rows.columns, "prediction", "confidence"
    )


# --- query strategies --------------------------------------------------------------------------


def _query_random(state: Round) -> DataFrame:
    return random_query(state.pool, state.n, state.seed)


def _query_least_confident(state: Round) -> DataFrame:
    return least_confident(predict(state.model, state.pool).select("id", "confidence"), state.n)


def _query_kmeans(state: Round) -> DataFrame:
    seed = zlib.crc32(state.seed.encode())
    return kmeans_query(state.pool.select("id", state.vector_col), state.n, seed, state.vector_col)


def _query_coreset(state: Round) -> DataFrame:
    return coreset_query(state.pool, state.labelled, state.n, state.vector_col)


STRATEGIES: dict[str, Callable[[Round], DataFrame]] = {
    "RandomSampling()": _query_random,
    "LeastConfidence()": _query_least_confident,
    "EmbeddingKMeans(normalize=True)": _query_kmeans,
    "GreedyCoreset(normalize=True)": _query_coreset,
}


# --- inputs ------------------------------------------------------------------------------------


def settings_from(params: dict, seed: int = 0) -> Settings:
    """Settings of a run from a row of a parameter grid; what the row lacks keeps its default."""
    names = ("method", "framework", "init_n", "cold_strategy", "query_n", "query_strategy")
    return Settings(**{name: params[name] for name in names if params.get(name) is not None}, seed=seed)


def classifier_from(params: dict) -> Callable[[int], Estimator]:
    """The SVM for SK; for TF the embedding classifier with the row's epochs."""
    if params.get("framework") == "TF":
        return lambda n_rows: logistic(n_rows, params.get("n_epochs") or 3)
    return svm


def text_sets(train: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add `features` to both: TF-IDF fitted on the training texts. Stored, since every round reads them."""
    model, vectors = fit_transform_tfidf_vectors(train)
    return vectors, model.transform(tests)


def load_text_sets(spark: SparkSession, path: str, params: dict) -> tuple[DataFrame, DataFrame]:
    """Stored training sample and test sets of a grid row, with features."""
    train = read_train(spark, path, params["dataset"], params["train_n"], params["class_imbalance"])
    return text_sets(train, read_tests(spark, path, params["dataset"], params["test_n"]))


# --- one run -----------------------------------------------------------------------------------


@dataclass
class RunResult:
    """Metrics per iteration, and the tables written on the way."""

    metrics: dict[int, dict[str, float]] = field(default_factory=dict)
    predictions_path: str = ""
    labelled_path: str = ""
    log_path: str = ""

    def labelled(self, spark, upto: int | None = None) -> DataFrame:
        """`<id, label, .., round>`; rounds start at 0. `upto` leaves out what a lost driver may have written beyond."""
        rows = spark.read.parquet(self.labelled_path)
        return rows if upto is None else rows.filter(F.col("round") <= upto)

    def predictions(self, spark) -> DataFrame:
        """`<test_set, id, label, prediction, iteration>`."""
        return spark.read.parquet(self.predictions_path)


def _evaluate(model: Model, labelled: DataFrame, tests: DataFrame, result: RunResult, iteration: int) -> None:
    """Score the labelled rows and all test sets in one pass; metrics come from what was written."""
    own = labelled.select(F.lit(TRAIN_SET).alias("test_set"), "id", "label", "features")
    rows = predict(model, own.unionByName(tests.select("test_set", "id", "label", "features")))
    path = f"{result.predictions_path}/iteration={iteration}"
    rows.select("test_set", "id", "label", "prediction").write.mode("overwrite").parquet(path)
    scores = set_scores(labelled.sparkSession.read.parquet(path)).collect()  # one row per set
    metrics: dict[str, float] = {}
    for row in sorted(scores, key=lambda row: row["test_set"]):
        if row["test_set"] == TRAIN_SET:
            metrics |= {"train_f1": row["f1"], "train_imbalance": row["imbalance"], "num_examples": float(row["n"])}
        else:
            metrics[f"{row['test_set']}_f1"] = row["f1"]
    result.metrics[iteration] = metrics


# --- round log ---------------------------------------------------------------------------------
#
# A round's tables lie in folders named by its number and are replaced as a whole, so a round that runs again leaves the
# same tables. Its entry in the log is written last: rounds with an entry are over, whatever else lies there.

ROUND_SCHEMA = "iteration int, n_labelled bigint, metrics map<string,double>"


def _commit(spark, result: RunResult, iteration: int, n_labelled: int) -> None:
    row = spark.createDataFrame([(iteration, n_labelled, result.metrics[iteration])], ROUND_SCHEMA).coalesce(1)
    row.write.mode("overwrite").parquet(f"{result.log_path}/round={iteration}")


def _committed(spark, result: RunResult) -> int:
    """Labelled rows after the last round in the log, 0 if there is none; their metrics are put into `result`."""
    rows = {row["iteration"]: row for row in _stored(spark, result.log_path, ROUND_SCHEMA).collect()}  # one per round
    n_labelled, iteration = 0, 0
    while iteration in rows:
        result.metrics[iteration] = dict(rows[iteration]["metrics"])
        n_labelled, iteration = rows[iteration]["n_labelled"], iteration + 1
    return n_labelled


def _stored(spark, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _result_at(spark, root: str | None) -> RunResult:
    root = root or new_path(spark, "run")
    return RunResult(predictions_path=f"{root}/predictions", labelled_path=f"{root}/labelled", log_path=f"{root}/log")


def run_supervised(train: DataFrame, tests: DataFrame, settings: Settings, classifier=svm, root=None) -> RunResult:
    """Train on every labelled row at once and score. The TF track holds out a tenth of each class. A run whose round is in
    the log below `root` is only read."""
    spark = train.sparkSession
    result = _result_at(spark, root)
    if _committed(spark, result):
        return result
    rows = train.filter(F.col("label").isin(0, 1))
    if settings.framework == "TF":
        rows = flag_sl_validation(rows, settings.seed)
    else:
        rows = rows.withColumn("is_valid", F.lit(False))
    rows.write.mode("overwrite").parquet(f"{result.labelled_path}/round=0")
    labelled = result.labelled(spark)
    _evaluate(fit(classifier, labelled), labelled, tests, result, 0)
    _commit(spark, result, 0, int(result.metrics[0]["num_examples"]))
    return result


def run_active(
    train: DataFrame, tests: DataFrame, settings: Settings, classifier=svm, vector_col=None, root=None, after_round=None
) -> RunResult:
    """Cold start, then query, reveal, retrain and score until the label budget is used up.

    `train` is the pool `<id, label, weak_label, features, ..>`; it should be a stored table, since
    every round reads it once. The last query takes what the budget still allows. Below `root` (default: a new folder) a
    driver that takes over goes on behind the last round in the log; seeds make its rounds those of an unbroken run.
    `after_round` is called with the number of each round that is over.
    """
    spark = train.sparkSession
    strategy = STRATEGIES[settings.query_strategy]
    result = _result_at(spark, root)
    n_labelled = _committed(spark, result)
    iteration = len(result.metrics)
    if not iteration:
        initial = cold_start(
            train.select("id", "label", "weak_label"), settings.cold_strategy, settings.init_n, settings.seed
        )
        if settings.framework == "TF":
            initial = flag_al_validation(initial, settings.init_n, settings.seed)
        else:
            initial = initial.withColumn("is_valid", F.lit(False))
        start = train.join(initial.select("id", "is_valid"), "id")
        path = f"{result.labelled_path}/round=0"
        start.write.mode("overwrite").parquet(path)
        n_labelled = spark.read.parquet(path).count()  # a balanced start from an odd `init_n` has one row less
    # A round's entry counts the rows picked at its end, so it alone says whether the run is over.
    while not (result.metrics and n_labelled == _at_end(result)):
        labelled = result.labelled(spark, iteration)
        model = fit(classifier, labelled)
        _evaluate(model, labelled, tests, result, iteration)
        n = min(settings.query_n, settings.budget - n_labelled)
        if n > 0:
            state = Round(
                pool=unlabelled(train, labelled),
                labelled=labelled,
                model=model,
                n=n,
                seed=f"{settings.seed}:{iteration + 1}",
                vector_col=vector_col,
            )
            picks = rows_by_id(train, strategy(state)).withColumn("is_valid", F.lit(False))
            path = f"{result.labelled_path}/round={iteration + 1}"
            picks.write.mode("overwrite").parquet(path)
            picked = spark.read.parquet(path).count()
            if picked < n:
                raise TooFewRows(f"asked for {n} unlabelled rows, the pool has {picked}")
            n_labelled += n
        _commit(spark, result, iteration, n_labelled)
        if after_round is not None:
            after_round(iteration)
        iteration += 1
    return result


def _at_end(result: RunResult) -> int:
    """Rows that the last round in the log has learned from: as many as labelled only if it picked none."""
    return int(result.metrics[max(result.metrics)]["num_examples"])


def run_once(
    train, tests, settings: Settings, classifier=svm, vector_col=None, root=None, after_round=None
) -> RunResult:
    """One supervised or active run."""
    if settings.method == "SL":
        return run_supervised(train, tests, settings, classifier, root)
    return run_active(train, tests, settings, classifier, vector_col, root, after_round)


# --- one experiment ----------------------------------------------------------------------------


@dataclass
class Experiment:
    """Stored tables of one experiment below `root`, and what ended it if that was a failure."""

    name: str
    root: str
    spark: SparkSession
    error: Exception | None = None

    def _own(self, table: str, key: str, schema: str) -> DataFrame:
        return _stored(self.spark, f"{self.root}/{table}", schema).filter(F.col(key) == self.name)

    @property
    def metrics(self) -> DataFrame:
        """`<experiment, run, iteration, metric, value>`"""
        return self._own("metrics", "experiment", METRICS_SCHEMA).select("experiment", "run", "iteration", "metric", "value")

    @property
    def predictions(self) -> DataFrame:
        """`<experiment, run, iteration, test_set, id, label, prediction>`"""
        schema = f"test_set string, id {self.id_type}, label int, prediction int, iteration int, experiment string, run string"
        return self._own("predictions", "experiment", schema)

    @property
    def status(self) -> DataFrame:
        """`<folder, file_name, content>`"""
        return self._own("status", "folder", STATUS_SCHEMA)

    id_type: str = "bigint"

    def check(self) -> "Experiment":
        """Itself, or the failure that ended it."""
        if self.error is not None:
            raise self.error
        return self


METRICS_SCHEMA = "iteration int, metric string, value double, experiment string, run string"
STATUS_SCHEMA = "folder string, file_name string, content string"


def run_experiment(
    train,
    tests,
    settings: Settings,
    name: str,
    run_n: int = 3,
    classifier=svm,
    vector_col=None,
    params=None,
    root=None,
    after_round=None,
) -> Experiment:
    """Repeat a run for seeds 0..run_n-1, storing everything below `root` as it happens.

    START is written before the first run and predictions and metrics after each, so another driver sees what runs. A
    driver that takes over after a loss goes on behind the last stored run, and inside a run behind its last round. END or
    FAILED comes last. A run that
    fails ends the experiment; the runs before it stay. The caller sees the failure by `check()`.
    """
    spark = train.sparkSession
    params = dict(params or {})
    kind = train.schema["id"].dataType.simpleString()
    experiment = Experiment(name, root or new_path(spark, "experiment"), spark, id_type=kind)

    def event(kind: str, record: dict) -> None:
        stamp = datetime.now(timezone.utc).strftime(STAMP)
        rows = [(name, f"{kind}_{stamp}.json", json.dumps(record))]
        write_status(spark.createDataFrame(rows, STATUS_SCHEMA), f"{experiment.root}/status")

    stored = {row["run"] for row in experiment.metrics.select("run").distinct().collect()}
    event("START", params)
    try:
        for seed in range(run_n):
            run = f"run_{seed}"
            if run in stored:
                continue
            # Rounds lie apart per run, so that a second driver finds them.
            rounds = f"{experiment.root}/rounds/{name}/{run}"
            result = run_once(train, tests, replace(settings, seed=seed), classifier, vector_col, rounds, after_round)
            rows = result.predictions(spark).filter(F.col("test_set") != TRAIN_SET)
            write_run_table(
                rows.withColumns({"experiment": F.lit(name), "run": F.lit(run)}), f"{experiment.root}/predictions"
            )
            # Metrics last: a run counts as stored when they are there.
            metric_rows = [
                (iteration, metric, value, name, run)
                for iteration, metrics in result.metrics.items()
                for metric, value in metrics.items()
            ]
            write_run_table(spark.createDataFrame(metric_rows, METRICS_SCHEMA), f"{experiment.root}/metrics")
        nested: dict[str, dict[str, dict[str, float]]] = {}
        for row in experiment.metrics.collect():  # a few numbers per run and iteration
            nested.setdefault(row["run"], {}).setdefault(str(row["iteration"]), {})[row["metric"]] = row["value"]
        event("END", params | {"results_dict": nested, "Error_Code": "NONE"})
    except Exception as error:  # any failure is a result of the experiment
        event("FAILED", params | {"Error_Code": str(error)})
        experiment.error = error
    return experiment


def load_vector_sets(
    spark: SparkSession, path: str, params: dict, embeddings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Stored training sample and test sets of a grid row, with the stored `<id, embedding>` of their rows."""
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    vectors = embeddings.select("id", "embedding", vector)
    train = read_train(spark, path, params["dataset"], params["train_n"], params["class_imbalance"])
    tests = read_tests(spark, path, params["dataset"], params["test_n"])
    stored = [materialize(rows.drop("text").join(vectors, "id"), "vectors") for rows in (train, tests)]
    if stored[0].count() < train.count() or stored[1].count() < tests.count():
        raise ValueError("rows of the stored sets have no embedding")
    return stored[0], stored[1]


def run_grid_row(
    spark: SparkSession, path: str, params: dict, root: str, embeddings: DataFrame | None = None, **changes
) -> Experiment:
    """One row of a parameter grid on the sets stored below `path`, its results stored below `root`.

    SK rows learn from the texts, TF rows from `embeddings`. `changes` replace settings such as the label budget.
    """
    row = spark.createDataFrame([{k: v for k, v in params.items() if v is not None}])
    name = row.select(experiment_key(row)).first()[0]
    settings = replace(settings_from(params), **changes)
    if params["framework"] == "TF":
        if embeddings is None:
            raise ValueError("TF rows need the embeddings of their rows")
        train, tests = load_vector_sets(spark, path, params, embeddings)
    else:
        train, tests = load_text_sets(spark, path, params)
    vector_col = "embedding" if params["framework"] == "TF" else None
    runs = params.get("run_n") or 3
    return run_experiment(train, tests, settings, name, runs, classifier_from(params), vector_col, params, root)
