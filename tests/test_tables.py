"""Sources, sinks, experiment tables, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.operators import experiments as E
from tagloom.plans.corpus import store_sets
from tagloom.session import new_path, shared_dir
from tagloom.sources import corpora, results
from tagloom.streaming.rows import run_available, weak_label_stream


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "a") != new_path(spark, "a")


def test_comments_with_extra_columns_quotes_and_missing(spark, tmp_path):
    path = tmp_path / "comments.tsv"
    path.write_text(
        'rev_id\tcomment\tyear\tsplit\n1\t"say ""hi""\nthere"\t2001\ttrain\n2\tNA\t2002\ttest\n3\t  padded \t2003\tNULL\n',
        encoding="utf-8",
    )
    got = sorted(tuple(r) for r in corpora.read_comments(spark, str(path), multi_line=True).collect())
    assert got == [(1, 'say "hi"\nthere', "train"), (2, None, "test"), (3, "  padded ", None)]


def test_votes_tweets_keywords(spark, tmp_path):
    (tmp_path / "votes.tsv").write_text("rev_id\tworker\tattack\n1\t9\t1.0\n1\t8\t\n")
    got = corpora.read_votes(spark, str(tmp_path / "votes.tsv")).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (1, None)]
    (tmp_path / "tweets.tsv").write_text("hé\tspam\t3\nnan\tabusive\t4\n", encoding="utf-8")
    (tmp_path / "again.tsv").write_text("nan\tabusive\t4\nhé\tspam\t3\nhé\tspam\t3\n", encoding="utf-8")
    got, again = (
        {r.id: (r.tweet, r.label, r.vote) for r in corpora.read_tweets(spark, str(tmp_path / name)).collect()}
        for name in ("tweets.tsv", "again.tsv")
    )
    assert sorted(got.values(), key=str) == [("hé", "spam", 3), (None, "abusive", 4)]
    assert len(again) == 3 and got.items() < again.items()
    (tmp_path / "keywords.txt").write_text("b\na\n\nb\n")
    assert corpora.read_keywords(spark, str(tmp_path / "keywords.txt")) == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1 keywords"):
        corpora.read_keywords(spark, str(tmp_path / "keywords.txt"), max_keywords=1)


def test_damaged_rows_are_errors(spark, tmp_path):
    (tmp_path / "votes.tsv").write_text("rev_id\tattack\n1\t1.0\nx2\t0.0\n")
    with pytest.raises(Exception, match="damaged row, rev_id is x2"):
        corpora.read_votes(spark, str(tmp_path / "votes.tsv")).collect()


def test_store_sets(spark, tmp_path):
    def part(first, n):
        text = F.concat(F.when(F.col("id") % 8 == 0, "bad ").otherwise("fine "), F.col("id").cast("string"))
        return spark.range(first, first + n).select("id", text.alias("text"), (F.col("id") % 4 == 0).cast("int").alias("label"))

    path = str(tmp_path / "sets")
    for _ in range(2):  # writing twice leaves one copy
        store_sets(part(0, 400), part(1000, 200), ["bad"], path, "d", train_budget=100, test_budget=40)
    train = corpora.read_train(spark, path, "d", 100, 10)
    assert train.count() == 100 and train.filter("label = 1").count() == 10
    assert train.filter("weak_label = 1").join(part(0, 400).filter("text like 'bad%'"), "id").count() == train.filter(
        "weak_label = 1"
    ).count()
    tests = corpora.read_tests(spark, path, "d", 30)
    counts = {r.test_set: r["count"] for r in tests.groupBy("test_set").count().collect()}
    assert counts == {"test_base": 30, "test_50": 30, "test_10": 30, "test_5": 30}
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    plan = tests._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(pos,30)" in plan


def test_grids():
    assert {name: E.grid_size(axes) for name, axes in E.GRIDS.items()} == {
        "SL_transformers": 6, "SL_sklearn": 6, "AL_transformers": 288, "AL_sklearn": 144,
    }


@pytest.mark.parametrize("name", list(E.GRIDS))
def test_grid_rows_and_index(spark, name, tmp_path):
    grid = E.parameter_grid(spark, E.GRIDS[name])
    rows = grid.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(E.grid_size(E.GRIDS[name])))
    # Last sorted axis that varies is the fastest.
    varying = [axis for axis in sorted(E.GRIDS[name]) if len(E.GRIDS[name][axis]) > 1]
    assert [r[varying[-1]] for r in rows[:2]] == E.GRIDS[name][varying[-1]][:2]
    assert [r[varying[0]] for r in rows[:2]] == [E.GRIDS[name][varying[0]][0]] * 2
    for _ in range(2):
        results.write_grid(grid, str(tmp_path / "grid"))
    again = results.read_grid(spark, str(tmp_path / "grid"))
    assert again.count() == len(rows) and dict(again.dtypes)["train_n"] == "int"
    assert E.grid_slice(grid, 2, 5).count() == 3 and E.grid_slice(grid, 2).count() == len(rows) - 2


def test_keys_and_pending(spark):
    grid = E.parameter_grid(spark, E.GRIDS["AL_transformers"])
    keyed = grid.withColumn("folder", E.experiment_key(grid)).withColumn("job", E.job_name(F.col("folder")))
    row = keyed.filter("query_strategy like 'Greedy%' and query_n = 50 and init_n = 20").orderBy("idx").first()
    assert row.folder == "AL_TF_wiki_50_20_TrueRandom_GreedyCoreset(normalize=True)_50"
    assert row.job == "AL_TF_wiki_50_20_TrueRandom_GreedyCoresetnormalize_50"
    supervised = E.parameter_grid(spark, E.GRIDS["SL_sklearn"])
    folders = spark.createDataFrame([("SL_SK_wiki_50_20000",), ("SL_SK_tweets_5_20000",)], "folder string")
    assert E.pending(supervised, folders).count() == 4


@pytest.fixture
def result_root(tmp_path):
    record = {"method": "AL", "dataset": "wiki", "train_n": 20000, "query_strategy": "RandomSampling()"}
    nested = {"run_0": {"0": {"train_f1": 0.5, "num_examples": 20}, "1": {"train_f1": 0.75}}}
    done = record | {"results_dict": nested, "Error_Code": "NONE"}
    files = {
        "AL_done": {"START_20220101T100000.json": record, "END_20220101T101500.json": done},
        "AL_twice": {"END_20220101T100000.json": done, "END_20220102T100000.json": record},
        "AL_failed": {"START_20220101T100000.json": record, "FAILED_20220101T100100.json": record | {"Error_Code": "boom"}},
        "AL_running": {"START_20220101T100000.json": record},
        "AL_other": {"log.json": {}},
        "SL_failed": {"START_20220101T100000.json": record, "FAILED_20220101T100100.json": record},
        "SL_done": {"START_20220101T100000.json": record, "END_20220101T100001.json": done},
        "misc": {"START_20220101T100000.json": record},
    }
    for folder, contents in files.items():
        (tmp_path / folder).mkdir()
        for name, content in contents.items():
            (tmp_path / folder / name).write_text(json.dumps(content, indent=2))
    return str(tmp_path)


def test_status_and_summary_of_result_folders(spark, result_root):
    files = results.list_result_files(spark, result_root)
    expected = spark.createDataFrame([(f,) for f in ("AL_done", "AL_empty", "AL_running")], "folder string")
    assert {r.folder: r.status for r in E.experiment_status(files).collect()} == {
        "AL_done": "done", "AL_twice": "done", "AL_failed": "failed", "AL_running": "running",
        "AL_other": "non_starter", "SL_failed": "failed", "SL_done": "done", "misc": "unknown",
    }
    assert {r.folder: r.status for r in E.experiment_status(files, expected).collect()} == {
        "AL_done": "done", "AL_empty": "non_starter", "AL_running": "running",
    }
    assert E.overlapping(E.status_lists(E.experiment_status(files))).count() == 0
    unstarted = spark.createDataFrame([("AL_x", "FAILED_20220101T100000.json")], "folder string, file_name string")
    lists = E.status_lists(E.experiment_status(files.unionByName(unstarted)))
    assert [tuple(r) for r in E.overlapping(lists).collect()] == [("AL_x", 2)]
    summary = E.summarize(results.read_result_files(spark, result_root))
    rows = {r.folder: r for r in summary.collect()}
    assert set(rows) == {"AL_done", "AL_twice", "AL_failed", "SL_done"}
    assert rows["AL_done"].run_seconds == 900 and rows["AL_failed"].start_time is None
    assert rows["AL_failed"].Error_Code == "boom" and rows["AL_twice"].Error_Code == "NONE"
    long = E.metrics_long(summary.filter("folder = 'AL_done'")).collect()
    assert sorted((r.run, r.iteration, r.metric, r.value) for r in long) == [
        ("run_0", "0", "num_examples", 20.0), ("run_0", "0", "train_f1", 0.5), ("run_0", "1", "train_f1", 0.75),
    ]


def test_summary_sinks(spark, result_root, tmp_path):
    summary = E.summarize(results.read_result_files(spark, result_root))
    results.write_summary(summary, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    results.write_summary(summary, str(tmp_path / "csv"), as_csv=True)
    text = spark.read.csv(str(tmp_path / "csv"), header=True, escape="\\").filter("folder = 'AL_done'").first().results_dict
    assert json.loads(text)["run_0"]["1"]["train_f1"] == 0.75


def test_stack_and_status_append(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2, 0.5)], "a int, c double")
    assert sorted(tuple(r) for r in E.stack_records([a, b]).collect()) == [(1, "x", None), (2, None, 0.5)]
    event = spark.createDataFrame([("AL_x", "START_20220101T100000.json", "{}")], "folder string, file_name string, content string")
    for _ in range(2):
        results.write_status(event, str(tmp_path / "status"))
    assert spark.read.parquet(str(tmp_path / "status")).count() == 2


def test_weak_labels_on_a_stream(spark, tmp_path):
    for part in (["you idiot", "fine"], ["idiot idiot", ""]):
        spark.createDataFrame([(t,) for t in part], "text string").selectExpr("xxhash64(text) AS id", "text").write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
        labels = weak_label_stream(stream, ["idiot"], 0.4)
        run_available(labels, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.filter("weak_pos_keywords = 1").count() == 2
