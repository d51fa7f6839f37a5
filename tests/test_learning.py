import json

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tagloom.operators.experiments import metrics_long, summarize
from tagloom.operators.sampling import TooFewRows
from tagloom.plans import learning as L
from tagloom.plans.corpus import store_sets
from tagloom.session import materialize, new_path
from tagloom.sources.results import write_run_table


@pytest.fixture(scope="module")
def sets(spark):
    """Two clouds that a line separates, 300 rows; a third of them positive."""
    i = F.col("id")
    label = (i % 3 == 0).cast("int")
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 - 0.5).cast("double")
    vector = F.array(label * 4.0 - 2.0 + noise, noise * 2, F.cos(i.cast("double")), F.lit(1.0))
    rows = spark.range(300).select(
        "id", label.alias("label"), (i % 6 == 0).cast("int").alias("weak_label"), vector.alias("embedding")
    )
    rows = materialize(rows.withColumn("features", array_to_vector("embedding")), "points")
    tests = rows.filter("id >= 220").withColumn("test_set", F.when(F.col("id") % 2 == 0, "test_a").otherwise("test_b"))
    return rows.filter("id < 220"), tests


@pytest.mark.parametrize("strategy", list(L.STRATEGIES))
def test_active_run(spark, sets, strategy):
    train, tests = sets
    settings = L.Settings(
        framework="TF", init_n=20, cold_strategy="BalancedRandom", query_n=15, query_strategy=strategy, budget=45
    )
    result = L.run_once(train, tests, settings, L.logistic, "embedding")
    sizes = [result.metrics[i]["num_examples"] for i in sorted(result.metrics)]
    assert sizes == [20, 35, 45]  # the last query takes what the budget still allows
    assert set(result.metrics[0]) == {"train_f1", "train_imbalance", "num_examples", "test_a_f1", "test_b_f1"}
    assert result.metrics[2]["test_a_f1"] > 0.9
    labelled = result.labelled(spark)
    assert labelled.count() == labelled.select("id").distinct().count() == 45
    assert {r["round"]: r["count"] for r in labelled.groupBy("round").count().collect()} == {0: 20, 1: 15, 2: 10}
    assert labelled.filter("is_valid").count() == 2
    assert result.predictions(spark).filter("test_set = 'test_a'").count() == 40 * 3


def test_same_seed_same_rows(spark, sets):
    train, tests = sets
    settings = L.Settings(init_n=20, cold_strategy="BalancedWeak", query_n=10, budget=30, seed=4)
    first = L.run_once(train, tests, settings, L.logistic)
    second = L.run_once(train.repartition(5), tests, settings, L.logistic)
    rows = [sorted((r.id, r["round"]) for r in run.labelled(spark).collect()) for run in (first, second)]
    assert rows[0] == rows[1]


def test_svm_learns_and_confidence_is_the_margin(sets):
    train, tests = sets
    model = L.fit(L.svm, train)
    rows = L.predict(model, tests).collect()
    assert sum(r.label == r.prediction for r in rows) / len(rows) > 0.95
    assert all(r.confidence >= 0 for r in rows)


def test_svm_needs_both_classes(sets):
    train, _ = sets
    with pytest.raises(TooFewRows, match="both classes"):
        L.fit(L.svm, train.filter("label = 0"))


def test_pool_too_small(sets):
    train, tests = sets
    settings = L.Settings(init_n=10, cold_strategy="BalancedRandom", query_n=20, budget=60)
    with pytest.raises(TooFewRows, match="the pool has"):
        L.run_once(train.filter("id < 40"), tests, settings, L.logistic)


def test_supervised_run(spark, sets):
    train, tests = sets
    result = L.run_once(train, tests, L.Settings(method="SL", framework="TF"), L.logistic)
    assert list(result.metrics) == [0] and result.metrics[0]["num_examples"] == 220
    positives = train.filter("label = 1").count()
    valid = result.labelled(spark).filter("is_valid").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in valid} == {1: int(0.1 * positives), 0: int(0.1 * (220 - positives))}


def test_experiment_end_to_end(spark, sets, tmp_path):
    train, tests = sets
    settings = L.Settings(framework="TF", init_n=20, cold_strategy="BalancedRandom", query_n=10, budget=30)
    params = {"method": "AL", "dataset": "points", "init_n": 20}
    root = str(tmp_path)
    result = L.run_experiment(train, tests, settings, "AL_TF_points", 2, L.logistic, "embedding", params, root)
    row = summarize(result.status).first()
    assert row.status == "done" and row.dataset == "points" and row.Error_Code == "NONE" and row.run_seconds >= 0
    long = metrics_long(summarize(result.status)).collect()
    direct = result.metrics.collect()
    assert {(r.run, int(r.iteration), r.metric): r.value for r in long} == {
        (r.run, r.iteration, r.metric): r.value for r in direct
    }
    write_run_table(result.predictions.filter("run = 'run_1'"), str(tmp_path / "predictions"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == len(direct)
    assert spark.read.parquet(str(tmp_path / "status")).count() == 2
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == result.predictions.count() == 80 * 2 * 2


def test_experiment_goes_on_behind_its_last_stored_run(spark, sets, tmp_path, monkeypatch):
    train, tests = sets
    settings = L.Settings(framework="TF", init_n=20, cold_strategy="BalancedRandom", query_n=10, budget=30)
    once, calls = L.run_once, []

    def lost_in_the_second_run(train, tests, settings, *rest):
        calls.append(settings.seed)
        if calls == [0, 1]:
            kinds = [r.file_name[:3] for r in spark.read.parquet(f"{tmp_path}/status").collect()]
            assert kinds == ["STA"] and spark.read.parquet(f"{tmp_path}/metrics").select("run").distinct().count() == 1
            raise RuntimeError("lost")
        return once(train, tests, settings, *rest)

    monkeypatch.setattr(L, "run_once", lost_in_the_second_run)
    first = L.run_experiment(train, tests, settings, "AL_TF_points", 2, L.logistic, "embedding", {}, str(tmp_path))
    with pytest.raises(RuntimeError, match="lost"):
        first.check()
    second = L.run_experiment(train, tests, settings, "AL_TF_points", 2, L.logistic, "embedding", {}, str(tmp_path))
    assert calls == [0, 1, 1]
    assert {r.run for r in second.check().metrics.collect()} == {"run_0", "run_1"}
    kinds = sorted(r.file_name.split("_")[0] for r in second.status.collect())
    assert kinds == ["END", "FAILED", "START", "START"]


def test_failed_experiment_is_recorded(sets):
    train, tests = sets
    settings = L.Settings(init_n=1000, cold_strategy="BalancedRandom")
    result = L.run_experiment(train, tests, settings, "AL_SK_points", 3)
    row = summarize(result.status).first()
    assert row.status == "failed" and "asked for 500" in row.Error_Code and row.end_time is None
    content = {r.file_name.split("_")[0]: r.content for r in result.status.collect()}
    assert set(content) == {"START", "FAILED"} and result.metrics.count() == 0
    assert json.loads(content["FAILED"])["Error_Code"] == row.Error_Code


def test_grid_row_to_run_on_stored_sets(spark, tmp_path):
    text = F.concat(F.when(F.col("id") % 4 == 0, "bad awful ").otherwise("fine nice "), (F.col("id") % 17).cast("string"))
    rows = spark.range(600).select("id", F.concat(text, F.lit(" x"), "id").alias("text"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    store_sets(rows.filter("id < 400"), rows.filter("id >= 400"), ["bad"], str(tmp_path), "d", 100, 40)
    params = {
        "method": "AL", "framework": "SK", "dataset": "d", "class_imbalance": 50, "init_n": 10,
        "cold_strategy": "BalancedWeak", "query_n": 10, "query_strategy": "RandomSampling()", "train_n": 100, "test_n": 20,
    }
    train, tests = L.load_text_sets(spark, str(tmp_path), params)
    assert train.count() == 100 and tests.count() == 80
    settings = L.settings_from(params, seed=1)
    assert settings.init_n == 10 and settings.budget == L.LABEL_BUDGET and settings.seed == 1
    model = L.fit(L.classifier_from(params), train)
    rows = L.predict(model, tests).collect()
    assert all(r.label == r.prediction for r in rows)
    epochs = L.classifier_from({"framework": "TF", "n_epochs": 7})(10)
    assert epochs.n_epochs == 7
    for framework, kind in (("SK", "sklearn_model"), ("TF", "transformer_model")):
        row = params | {"framework": framework, kind: "x", "run_n": 1, "n_epochs": 3}
        vector = F.array((F.col("id") % 4 == 0).cast("double"), F.lit(0.5))
        embeddings = spark.range(600).select("id", vector.alias("embedding"))
        out = L.run_grid_row(spark, str(tmp_path), row, f"{tmp_path}-out", embeddings, budget=30).check()
        assert out.name == f"AL_{framework}_d_50_10_BalancedWeak_RandomSampling()_10"
        sizes = out.metrics.filter("metric = 'num_examples'").orderBy("iteration").collect()
        assert [r.value for r in sizes] == [10, 20, 30]
    with pytest.raises(ValueError, match="no embedding"):
        L.load_vector_sets(spark, str(tmp_path), params, embeddings.filter("id > 100"))


class Lost(Exception):
    pass


@pytest.mark.parametrize("stops_at", [0, 1, 2])
def test_run_goes_on_behind_its_last_round(spark, sets, tmp_path, monkeypatch, stops_at):
    """A driver is lost in a round, after it has written tables of that round; the next one ends as an unbroken run does."""
    train, tests = sets
    settings = L.Settings(framework="TF", init_n=20, cold_strategy="BalancedRandom", query_n=10, budget=40)

    def run(root, after_round=None):
        return L.run_active(train, tests, settings, L.logistic, "embedding", root, after_round)

    unbroken = run(str(tmp_path / "unbroken"))
    commit, fits = L._commit, []

    def lost(spark, result, iteration, n_labelled):
        if iteration == stops_at:
            raise Lost
        commit(spark, result, iteration, n_labelled)

    monkeypatch.setattr(L, "_commit", lost)
    with pytest.raises(Lost):
        run(str(tmp_path / "broken"))
    monkeypatch.setattr(L, "_commit", commit)
    fitted = L.fit
    monkeypatch.setattr(L, "fit", lambda *a: fits.append(1) or fitted(*a))
    done = []
    second = run(str(tmp_path / "broken"), done.append)
    assert done == list(range(stops_at, 3)) and len(fits) == 3 - stops_at
    assert second.metrics == unbroken.metrics
    rows = [sorted((r.round, r.id, r.label) for r in x.labelled(spark).collect()) for x in (second, unbroken)]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    rows = [sorted(map(str, x.predictions(spark).collect())) for x in (second, unbroken)]
    assert rows[0] == rows[1]
    again = run(str(tmp_path / "broken"), done.append)  # a run that is over is only read
    assert again.metrics == unbroken.metrics and len(fits) == 3 - stops_at


@pytest.mark.parametrize("strategy", ["RandomSampling()", "LeastConfidence()"])
def test_balanced_start_from_an_odd_number(spark, sets, strategy):
    """Half of each class: one row less than asked for. The run still ends, with the whole budget labelled."""
    train, tests = sets
    settings = L.Settings(init_n=21, cold_strategy="BalancedRandom", query_n=15, query_strategy=strategy, budget=45)

    def stop(iteration):
        assert iteration < 4, "the run goes on behind its budget"

    root = new_path(spark, "odd")
    result = L.run_once(train, tests, settings, L.logistic, root=root, after_round=stop)
    assert [result.metrics[i]["num_examples"] for i in sorted(result.metrics)] == [20, 35, 45]
    again = L.run_once(train, tests, settings, L.logistic, root=root, after_round=stop)
    assert again.metrics == result.metrics
