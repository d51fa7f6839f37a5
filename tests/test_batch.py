"""Claims on experiments, batches of them, and folders of result files."""

import json
import threading
import time

import pytest

from tagloom.plans.batch import Claims, Taken, run_batch
from tagloom.sources import folders


def test_a_claim_is_taken_once(spark, tmp_path):
    claims = Claims(spark, str(tmp_path))
    taken = []
    threads = [threading.Thread(target=lambda: taken.append(Claims(spark, str(tmp_path)).take("AL_x"))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken, key=str) == [0, *[None] * 7]
    assert claims.take("AL_y") == 0 and claims.take("AL_y") is None


def test_a_stale_claim_is_taken_over(spark, tmp_path):
    first, second = (Claims(spark, str(tmp_path), stale_after=1.0) for _ in range(2))
    assert first.take("AL_x") == 0 and second.take("AL_x") is None
    for _ in range(3):
        time.sleep(0.6)
        first.renew("AL_x", 0)
        assert second.take("AL_x") is None  # renewed in time
    time.sleep(1.2)
    assert second.take("AL_x") == 1 and first.take("AL_x") is None
    with pytest.raises(Taken):
        first.renew("AL_x", 0)
    second.renew("AL_x", 1)


def test_two_drivers_run_every_experiment_once(spark, tmp_path):
    ran, at_once, most = [], 0, [0]
    lock = threading.Lock()

    def experiment(name):
        def run(after_round):
            nonlocal at_once
            with lock:
                at_once += 1
                most[0] = max(most[0], at_once)
                ran.append(name)
            assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == name
            assert spark.range(10).count() == 10
            time.sleep(0.3)
            after_round(0)
            with lock:
                at_once -= 1
            return name.lower()

        return name, run

    listed = [experiment(f"AL_{i}") for i in range(9)]
    found = []
    drivers = [threading.Thread(target=lambda: found.append(run_batch(spark, listed, str(tmp_path), 2))) for _ in range(2)]
    for t in drivers:
        t.start()
    for t in drivers:
        t.join()
    assert sorted(ran) == [f"AL_{i}" for i in range(9)]
    assert found[0].keys().isdisjoint(found[1]) and found[0] | found[1] == {f"AL_{i}": f"al_{i}" for i in range(9)}
    assert 2 <= most[0] <= 4
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_failures_are_not_swallowed(spark, tmp_path):
    def fails(after_round):
        raise RuntimeError("no such set")

    with pytest.raises(RuntimeError, match="no such set"):
        run_batch(spark, [("AL_a", fails), ("AL_b", lambda after_round: 1)], str(tmp_path))
    assert run_batch(spark, [("AL_b", lambda after_round: 1)], str(tmp_path)) == {}  # ran in the batch above


def test_result_folders(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = [(f"AL_{i % 7}", f"START_{i}.json", json.dumps({"é": i})) for i in range(60)] + [("AL_0", "END_1.json", None)]
    schema = "file_name string, content string, folder string"
    given = spark.createDataFrame([(name, text, folder) for folder, name, text in rows], schema)
    for _ in range(2):  # a second write leaves the same files
        folders.write_result_folders(given, root)
    want = sorted((folder, name, text or "") for folder, name, text in rows)
    read = folders.read_result_folders(spark, root)
    assert sorted(tuple(r) for r in read.collect()) == want
    assert json.loads(read.filter("folder = 'AL_3'").first().content)["é"] % 7 == 3
    names = folders.read_result_folders(spark, str(tmp_path / "out"), content=False)
    assert sorted(tuple(r) for r in names.collect()) == [(a, b, None) for a, b, _ in want]
    many = spark.read.format("result_folders").option("foldersPerTask", 2).option("path", root).load()
    assert many.rdd.getNumPartitions() == 4 and many.count() == 61
    assert not list(tmp_path.glob("out/*/.*"))  # nothing half written


def test_result_folders_without_files_and_with_bad_names(spark, tmp_path):
    assert folders.read_result_folders(spark, str(tmp_path / "none")).count() == 0
    for folder, name in (("a/b", "x"), ("a", ".hidden"), ("", "x"), ("a", None)):
        given = spark.createDataFrame([(folder, name, "")], "folder string, file_name string, content string")
        with pytest.raises(Exception, match="no names"):
            folders.write_result_folders(given, str(tmp_path / "bad"))


def test_result_folders_in_a_bounded_number_of_tasks(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"AL_{i:05}").mkdir()
    (tmp_path / "AL_00007" / "START_1.json").write_text("a")
    (tmp_path / "AL_19999" / "END_1.json").write_text("b")
    read = folders.read_result_folders(spark, str(tmp_path))
    slots = spark.sparkContext.defaultParallelism
    # The least number of folders per task would make 79 tasks of these.
    assert read.rdd.getNumPartitions() <= max(folders.MOST_TASKS, folders.TASKS_PER_SLOT * slots) < 20_000 / folders.FOLDERS_PER_PARTITION
    assert [tuple(r) for r in read.collect()] == [("AL_00007", "START_1.json", "a"), ("AL_19999", "END_1.json", "b")]
