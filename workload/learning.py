"""Models and whole runs. Solvers iterate, so they have no SQL and tests check their properties; which rows a run labels,
and what it stores, has SQL where the classifier is a plug-in with a known margin."""

import zlib
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.epochs import DECAYS, N_BATCHES, RATE, TINY
from tagloom.operators.experiments import grid_slice, parameter_grid
from tagloom.operators.features import STOP_WORDS, TERM_PATTERN
from tagloom.operators.metrics import binary_scores
from tagloom.operators.sampling import budget_sample, class_sizes, flag_sl_validation, flag_test
from tagloom.plans.batch import run_batch
from tagloom.plans.corpus import add_weak_label
from tagloom.plans.learning import Settings, fit, logistic, predict, run_experiment, run_once, svm, text_sets
from tagloom.session import materialize, new_path
from workload.registry import (
    KEYWORDS,
    LABELLED,
    labelled_documents,
    query,
    quote,
    sql_cells,
    sql_key,
    sql_rank,
    sql_scores,
    table,
    texts,
)
from workload.selection import coreset_steps, kmeans_steps


def _text_sets(spark, folder, weak: bool = True):
    """(train, test) with features: the labelled documents, split three to one."""
    rows = labelled_documents(spark, folder, texts)
    if weak:
        rows = add_weak_label(rows, KEYWORDS, 0.01).withColumnRenamed("weak_pos_keywords", "weak_label")
    rows = rows.select("id", "text", "label", *(["weak_label"] if weak else []))
    rows = materialize(flag_test(rows, 0.25), "split")
    return text_sets(rows.filter("NOT is_test").drop("is_test"), rows.filter("is_test").drop("is_test"))


def _vector_sets(spark, folder):
    """(train, test) on the embeddings; the first class against the rest."""
    vector = F.col("embedding").cast("array<double>")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") == 0).cast("int").alias("label"),
        (F.col("label") < 2).cast("int").alias("weak_label"),
        "embedding",
        array_to_vector(vector).alias("features"),
    )
    rows = materialize(flag_test(rows, 0.25), "features")
    return rows.filter("NOT is_test").drop("is_test"), rows.filter("is_test").drop("is_test")


def _test_sets(test):
    """The whole test part, and as many rows as it has positives at half and half."""
    sample = budget_sample(test, class_sizes(test, "label")[1], 0.5).drop("pos")
    base = test.withColumn("test_set", F.lit("test_base"))
    return materialize(base.unionByName(sample.withColumn("test_set", F.lit("test_50"))), "tests")


def sql_margins(iterations: int = 3_000) -> str:
    """`<id, label, is_test, margin>` of all rows. Another way to the same minimum: steps with momentum on the dual, whose matrix
    is the inner products of the training rows."""
    stop = ", ".join(map(quote, STOP_WORDS))
    return f"""
    WITH RECURSIVE split AS MATERIALIZED (SELECT *,
        {sql_rank('id', '42')} <= ceil(0.25::DOUBLE * count(*) OVER ()) AS is_test FROM ({LABELLED})),
    found AS (SELECT id, is_test, unnest(regexp_extract_all(lower(text), {quote(TERM_PATTERN)})) AS term FROM split),
    tf AS MATERIALIZED (SELECT id, is_test, term, count(*) AS tf FROM found WHERE term NOT IN ({stop}) GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM split WHERE NOT is_test))::DOUBLE / (1 + count(*))) + 1 AS idf
      FROM tf WHERE NOT is_test GROUP BY term),
    raw AS (SELECT id, is_test, term, tf * idf AS raw FROM tf JOIN idf USING (term)),
    weights AS MATERIALIZED (SELECT id, is_test, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw),
    train AS MATERIALIZED (SELECT id, 2 * label - 1 AS y FROM split WHERE NOT is_test),
    products AS (SELECT a.id AS i, b.id AS j, sum(a.weight * b.weight) AS k FROM weights a JOIN weights b USING (term)
      WHERE NOT b.is_test GROUP BY ALL),
    lines AS MATERIALIZED (SELECT s.id, s.label, s.is_test,
        list((t.y * (1 + coalesce(k, 0)))::DOUBLE ORDER BY t.id) AS line
      FROM split s CROSS JOIN train t LEFT JOIN products ON i = s.id AND j = t.id GROUP BY ALL),
    matrix AS MATERIALIZED (SELECT list(list_transform(line, lambda x: x * (2 * label - 1)) ORDER BY id) AS q,
        max(list_sum(list_transform(line, lambda x: abs(x)))) + 0.5 AS top FROM lines WHERE NOT is_test),
    sized AS MATERIALIZED (SELECT q, top, (sqrt(top) - sqrt(0.5)) / (sqrt(top) + sqrt(0.5)) AS momentum FROM matrix),
    steps AS (
      SELECT 0 AS step, list_transform(q, lambda x: 0.0::DOUBLE) AS a, list_transform(q, lambda x: 0.0::DOUBLE) AS b FROM sized
      UNION ALL
      SELECT step + 1, list_transform(list_zip(v, q), lambda x: greatest(0.0::DOUBLE,
          x[1] - (list_inner_product(x[2], v) + 0.5 * x[1] - 1) / top)), a
      FROM (SELECT step, a, q, top, list_transform(list_zip(a, b), lambda x: x[1] + momentum * (x[1] - x[2])) AS v FROM steps, sized)
      WHERE step < {iterations})
    SELECT l.id, l.label, l.is_test, list_inner_product(line, a) AS margin
    FROM lines l, (SELECT a FROM steps WHERE step = {iterations})"""


@query(
    "svm_predict",
    f"""SELECT id, label, (margin > 0)::INT AS prediction, round(abs(margin), 4) AS confidence FROM ({sql_margins()})
    WHERE is_test""",
)
def svm_predict(spark, folder):
    train, test = _text_sets(spark, folder, weak=False)
    rows = predict(fit(svm, train), test)
    return rows.select("id", "label", "prediction", F.round("confidence", 4).alias("confidence"))


@query(
    "svm_metrics",
    "SELECT * EXCLUDE (one) FROM ("
    + sql_scores(f"SELECT 1 AS one, {sql_cells('label', '(margin > 0)::INT')} FROM ({sql_margins()}) WHERE is_test", "one", 6)
    + ")",
)
def svm_metrics(spark, folder):
    train, test = _text_sets(spark, folder, weak=False)
    return binary_scores(predict(fit(svm, train), test), places=6)


EPOCHS = 3


def sql_epochs(seed: int = 0) -> str:
    """The same batches one after the other, each a relation, and the held-out loss after each epoch."""
    batch = f"('0x' || {sql_key('id', f'{seed}:batch')}[1:8])::BIGINT % {N_BATCHES}"
    steps = [
        f"""rows AS MATERIALIZED (SELECT vec_id AS id, (label = 0)::INT AS y, list_append(list_transform(embedding, lambda x: x::DOUBLE), 1.0::DOUBLE) AS x,
          {sql_rank('vec_id', '42')} <= ceil(0.25::DOUBLE * count(*) OVER ()) AS is_test FROM embeddings)""",
        f"""train AS MATERIALIZED (SELECT *, CASE WHEN {sql_rank('id', f'{seed}:valid', 'y')}
          <= floor(0.1::DOUBLE * count(*) OVER (PARTITION BY y)) THEN -1 ELSE {batch} END AS batch FROM rows WHERE NOT is_test)""",
        "size AS (SELECT any_value(len(x)) AS n FROM rows)",
        """s0 AS MATERIALIZED (SELECT list_transform(range(n), lambda i: 0.0::DOUBLE) AS w, list_transform(range(n), lambda i: 0.0::DOUBLE) AS m,
          list_transform(range(n), lambda i: 0.0::DOUBLE) AS v, 0 AS t FROM size)""",
    ]
    a, b = DECAYS
    at, losses = 0, []
    for epoch in range(EPOCHS):
        for number in range(N_BATCHES):
            steps.append(f"""g{at} AS MATERIALIZED (SELECT list(g ORDER BY place) AS g FROM (SELECT place, avg(gap * x) AS g FROM (
              SELECT 1 / (1 + exp(-list_inner_product(x, w))) - y AS gap, unnest(x) AS x, generate_subscripts(x, 1) AS place
              FROM train, s{at} WHERE batch = {number}) GROUP BY place))""")
            steps.append(f"""n{at} AS MATERIALIZED (SELECT w, t + 1 AS t, list_transform(list_zip(m, g), lambda p: {a} * p[1] + {1 - a}::DOUBLE * p[2]) AS m,
              list_transform(list_zip(v, g), lambda p: {b} * p[1] + {1 - b}::DOUBLE * p[2] * p[2]) AS v FROM s{at}, g{at} WHERE g IS NOT NULL)""")
            steps.append(f"""s{at + 1} AS MATERIALIZED (SELECT list_transform(list_zip(w, m, v), lambda p: p[1] - {RATE} * (p[2] / (1 - {a}::DOUBLE ** t))
                / (sqrt(p[3] / (1 - {b}::DOUBLE ** t)) + {TINY})) AS w, m, v, t FROM n{at}
              UNION ALL SELECT s.* FROM s{at} s WHERE NOT EXISTS (FROM n{at}))""")
            at += 1
        steps.append(f"""l{epoch} AS MATERIALIZED (SELECT {epoch} AS epoch, any_value(w) AS w, avg(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))) AS loss
          FROM (SELECT y, w, list_inner_product(x, w) AS z FROM train, s{at} WHERE batch = -1))""")
        losses.append(f"SELECT * FROM l{epoch}")
    return f"""WITH {', '.join(steps)} SELECT id, y AS label, (list_inner_product(x, w) > 0)::INT AS prediction
      FROM rows, (SELECT w FROM ({' UNION ALL '.join(losses)}) ORDER BY loss, epoch LIMIT 1) WHERE is_test"""


@query("embedding_classifier", sql_epochs())
def embedding_classifier(spark, folder):
    """A tenth of each class of the training rows says which epoch is kept."""
    train, test = _vector_sets(spark, folder)
    rows = predict(fit(lambda n_rows: logistic(n_rows, EPOCHS), flag_sl_validation(train)), test)
    return rows.select("id", "label", "prediction")


def _metric_rows(spark, result):
    rows = [(i, name, value) for i, metrics in result.metrics.items() for name, value in metrics.items()]
    return spark.createDataFrame(rows, "iteration int, metric string, value double")


def sql_supervised() -> str:
    """Metrics of the SVM on its own rows, on all test rows, and on a sample of them at half and half."""
    cells = f"SELECT test_set, {sql_cells('label', 'prediction')} FROM sets GROUP BY test_set"
    place = sql_rank("id", "0:0.5", "label")
    return f"""
    WITH scored AS MATERIALIZED (SELECT id, label, is_test, (margin > 0)::INT AS prediction FROM ({sql_margins()})),
    budget AS (SELECT count(*) AS n FROM scored WHERE is_test AND label = 1),
    sets AS (SELECT 'train' AS test_set, label, prediction FROM scored WHERE NOT is_test
      UNION ALL SELECT 'test_base', label, prediction FROM scored WHERE is_test
      UNION ALL SELECT 'test_50', label, prediction FROM (SELECT *, {place} AS place FROM scored WHERE is_test), budget
        WHERE place <= CASE label WHEN 0 THEN n // 2 ELSE n - n // 2 END),
    rows AS (SELECT * FROM ({sql_scores(cells, 'test_set')}))
    SELECT 0 AS iteration, CASE test_set WHEN 'train' THEN 'train_f1' ELSE test_set || '_f1' END AS metric, f1_macro AS value FROM rows
    UNION ALL SELECT 0, 'train_imbalance', (tp + fn)::DOUBLE / (tn + fp + fn + tp) FROM rows WHERE test_set = 'train'
    UNION ALL SELECT 0, 'num_examples', (tn + fp + fn + tp)::DOUBLE FROM rows WHERE test_set = 'train'"""


@query("sl_run", sql_supervised())
def sl_run(spark, folder):
    train, test = _text_sets(spark, folder)
    return _metric_rows(spark, run_once(train, _test_sets(test), Settings(method="SL")))


@query("al_run")
def al_run(spark, folder):
    train, test = _text_sets(spark, folder)
    n = train.count() // 20  # the budget is a share of the rows
    settings = Settings(
        init_n=n, cold_strategy="BalancedRandom", query_n=n, query_strategy="LeastConfidence()", budget=3 * n
    )
    return _metric_rows(spark, run_once(train, _test_sets(test), settings))


@query("al_run_embeddings")
def al_run_embeddings(spark, folder):
    train, test = _vector_sets(spark, folder)
    n = train.count() // 20
    settings = Settings(
        framework="TF",
        init_n=n,
        cold_strategy="BalancedWeak",
        query_n=n,
        query_strategy="GreedyCoreset(normalize=True)",
        budget=3 * n,
    )
    return _metric_rows(spark, run_once(train, _test_sets(test), settings, logistic, "embedding"))


@query("multi_seed")
def multi_seed(spark, folder):
    train, test = _vector_sets(spark, folder)
    n = train.count() // 20
    settings = Settings(
        framework="TF", init_n=n, cold_strategy="BalancedWeak", query_n=n, query_strategy="RandomSampling()", budget=2 * n
    )
    result = run_experiment(train, _test_sets(test), settings, "AL_TF_embeddings", 2, logistic, "embedding")
    return result.check().metrics


# --- runs with a plug-in classifier, so that SQL can follow them ------------------------------------


class ConstantMargin(Estimator):
    """A classifier that says 1 with margin 1 to every row."""

    def _fit(self, dataset):
        return ConstantMarginModel()


class ConstantMarginModel(Model):
    def _transform(self, dataset):
        margin = array_to_vector(F.array(F.lit(-1.0), F.lit(1.0)))
        return dataset.withColumns({"rawPrediction": margin, "prediction": F.lit(1.0)})


VECTOR_TRAIN = f"""
  SELECT id, label, weak_label FROM (
    SELECT vec_id AS id, (label = 0)::INT AS label, (label < 2)::INT AS weak_label,
      {sql_rank('vec_id', '42')} <= ceil(0.25::DOUBLE * count(*) OVER ()) AS is_test FROM embeddings)
  WHERE NOT is_test"""
ROUNDS = 3


def sql_rounds(seed: int, cold: str, order, share: int = 20) -> str:
    """`<id, label, round>` of a run that labels one in `share` training rows per round. `cold` is the condition of
    the first round on rows with `k`; `order` gives the rank of an unlabelled row in a round."""
    parts = [f"r0 AS (SELECT *, 0 AS round FROM ({cold}))"]
    for i in range(1, ROUNDS):
        seen = " UNION ALL ".join(f"SELECT id FROM r{j}" for j in range(i))
        parts.append(
            f"""r{i} AS (SELECT id, label, {i} AS round FROM (
              SELECT id, label, {order(f'{seed}:{i}')} AS place FROM train WHERE id NOT IN ({seen}))
              WHERE place <= (SELECT k FROM size))"""
        )
    rows = " UNION ALL ".join(f"SELECT id, label, round::INT AS round FROM r{i}" for i in range(ROUNDS))
    return f"""WITH train AS ({VECTOR_TRAIN}), size AS (SELECT count(*) // {share} AS k FROM train),
      {', '.join(parts)} {rows}"""


def sql_random_rounds(seed: int, share: int = 20) -> str:
    cold = f"SELECT id, label FROM (SELECT id, label, {sql_rank('id', str(seed))} AS place FROM train), size WHERE place <= k"
    return sql_rounds(seed, cold, lambda key: sql_rank("id", key), share)


SMALLEST_IDS = sql_rounds(
    0,
    f"""SELECT id, label FROM (SELECT id, label, {sql_rank('id', '0', 'weak_label')} AS place FROM train), size
    WHERE place <= k // 2""",
    lambda key: "row_number() OVER (ORDER BY id)",
)


def _plugged(train, share: int = 20, **settings) -> Settings:
    n = train.count() // share
    return Settings(init_n=n - n % 2 if settings["cold_strategy"] != "TrueRandom" else n, query_n=n,
                    budget=(n - n % 2 if settings["cold_strategy"] != "TrueRandom" else n) + (ROUNDS - 1) * n, **settings)


def _labelled_rows(spark, folder, **settings):
    train, test = _vector_sets(spark, folder)
    tests = materialize(test.withColumn("test_set", F.lit("test_base")), "tests")
    result = run_once(train, tests, _plugged(train, **settings), lambda n_rows: ConstantMargin())
    return result.labelled(spark).select("id", "label", "round")


@query("al_random_rows", sql_random_rounds(0))
def al_random_rows(spark, folder):
    """Which rows an active run labels, by round: random start, random queries."""
    return _labelled_rows(spark, folder, cold_strategy="TrueRandom", query_strategy="RandomSampling()")


@query("al_least_confident_rows", SMALLEST_IDS)
def al_least_confident_rows(spark, folder):
    """Balanced weak start; with a constant margin the least confident rows are those with the smallest ids."""
    return _labelled_rows(spark, folder, cold_strategy="BalancedWeak", query_strategy="LeastConfidence()")


INIT_N, NEXT_N = 20, 8


def sql_vector_rounds(seed: int, steps_of, rounds: int = 2) -> str:
    """`<id, label, round>`: a random start, then in each round what `steps_of` (pool, labelled, round, prefix) makes."""
    steps = [
        f"train AS MATERIALIZED ({VECTOR_TRAIN})",
        f"r0 AS MATERIALIZED (SELECT id AS vec_id, 0 AS round FROM (SELECT id, {sql_rank('id', str(seed))} AS place FROM train) WHERE place <= {INIT_N})",
    ]
    for i in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT vec_id FROM r{j}" for j in range(i))
        pool = f"SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM train) AND vec_id NOT IN ({seen})"
        steps += steps_of(pool, f"SELECT vec_id, embedding FROM embeddings WHERE vec_id IN ({seen})", i, f"x{i}")
        steps.append(f"r{i} AS MATERIALIZED (SELECT vec_id, {i} AS round FROM x{i}picks)")
    rows = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(rounds + 1))
    return f"WITH {', '.join(steps)} SELECT id, label, round FROM ({rows}) JOIN train ON id = vec_id"


def _vector_rounds(spark, folder, strategy):
    train, test = _vector_sets(spark, folder)
    tests = materialize(test.withColumn("test_set", F.lit("test_base")), "tests")
    settings = Settings(init_n=INIT_N, query_n=NEXT_N, query_strategy=strategy, budget=INIT_N + 2 * NEXT_N)
    result = run_once(train, tests, settings, lambda n_rows: ConstantMargin(), "embedding")
    return result.labelled(spark).select("id", "label", "round")


@query("al_coreset_rows", sql_vector_rounds(0, lambda pool, labelled, i, x: coreset_steps(pool, labelled, NEXT_N, x)))
def al_coreset_rows(spark, folder):
    return _vector_rounds(spark, folder, "GreedyCoreset(normalize=True)")


@query(
    "al_kmeans_rows",
    sql_vector_rounds(0, lambda pool, labelled, i, x: kmeans_steps(pool, NEXT_N, zlib.crc32(f"0:{i}".encode()), 20, x)),
)
def al_kmeans_rows(spark, folder):
    return _vector_rounds(spark, folder, "EmbeddingKMeans(normalize=True)")


def _sql_run(seed: int, share: int = 20) -> str:
    rounds = f"SELECT DISTINCT round AS iteration FROM ({sql_random_rounds(seed, share)})"
    return f"""SELECT 'run_{seed}' AS run, iteration, count(*)::DOUBLE AS num_examples, round(avg(label::DOUBLE), 6) AS train_imbalance
    FROM ({rounds}) i JOIN ({sql_random_rounds(seed, share)}) r ON r.round <= i.iteration GROUP BY iteration"""


@query("runs_stored", f"{_sql_run(0)} UNION ALL {_sql_run(1)}")
def runs_stored(spark, folder):
    """Metrics of two runs, as stored while they ran, and read back."""
    train, test = _vector_sets(spark, folder)
    tests = materialize(test.withColumn("test_set", F.lit("test_base")), "tests")
    settings = _plugged(train, cold_strategy="TrueRandom", query_strategy="RandomSampling()")
    root = new_path(spark, "stored-runs")
    done = run_experiment(train, tests, settings, "AL_x", 2, lambda n_rows: ConstantMargin(), root=root).check()
    wide = done.metrics.groupBy("run", "iteration").pivot("metric", ["num_examples", "train_imbalance"]).agg(F.first("value"))
    return wide.withColumn("train_imbalance", F.round("train_imbalance", 6))


SHARES = [20, 25, 40, 50]
_BATCH = " UNION ALL ".join(
    f"SELECT 'AL_SK_' || share AS experiment, * EXCLUDE (share) FROM (SELECT {share} AS share, * FROM ({_sql_run(seed, share)}))"
    for share in SHARES[1:]
    for seed in range(2)
)


@query("batch_of_runs", _BATCH)
def batch_of_runs(spark, folder):
    """A slice of a grid over how many rows a round labels: three experiments of two runs at once, by two drivers that look at
    the same list."""
    train, test = _vector_sets(spark, folder)
    tests = materialize(test.withColumn("test_set", F.lit("test_base")), "tests")
    grid = grid_slice(parameter_grid(spark, {"dataset": ["embeddings"], "share": SHARES}), 1)
    root = new_path(spark, "batch")

    def experiment(name, share):
        settings = _plugged(train, share, cold_strategy="TrueRandom", query_strategy="RandomSampling()")
        classifier = lambda n_rows: ConstantMargin()
        return name, lambda after_round: run_experiment(
            train, tests, settings, name, 2, classifier, root=f"{root}/{name}", after_round=after_round
        )

    listed = [experiment(f"AL_SK_{row['share']}", row["share"]) for row in grid.collect()]  # rows of a grid slice
    first, second = (run_batch(spark, part, root) for part in (listed[::2], listed))
    assert not set(first) & set(second)
    done = [x.check() for x in (first | second).values()]
    rows = reduce(DataFrame.unionByName, [x.metrics for x in done])
    wide = rows.groupBy("experiment", "run", "iteration").pivot("metric", ["num_examples", "train_imbalance"])
    return wide.agg(F.first("value")).withColumn("train_imbalance", F.round("train_imbalance", 6))
