"""Many experiments at once, by one driver or several.

An experiment belongs to the driver that creates its claim, a file whose creation the file system does once only. Drivers look at the
same list and take what is unclaimed; a claim that has not been renewed for long may be taken over by creating its successor, and
the experiment then goes on behind its last round. Inside a driver threads run experiments side by side, each in a scheduler
pool of its own, so that with `spark.scheduler.mode` FAIR a long one does not hold up the others.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Taken(Exception):
    """Another driver has taken the experiment over."""


@dataclass
class Claims:
    """Claims on experiments below `root`, on a file system that creates a file once only: HDFS, or one that all drivers have
    mounted."""

    spark: SparkSession
    root: str
    stale_after: float | None = None  # seconds without renewal; None: claims are for ever

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self, name: str) -> tuple[int, float]:
        """(number of claims so far, seconds since the last one was renewed)"""
        path, system = self._folder(name)
        if not system.exists(path):
            return 0, 0.0
        files = list(system.listStatus(path))
        if not files:
            return 0, 0.0
        newest = max(files, key=lambda f: int(f.getPath().getName()))
        return len(files), time.time() - newest.getModificationTime() / 1000

    def take(self, name: str) -> int | None:
        """The number of the claim if this call has created it, else None."""
        number, age = self._last(name)
        if number and (self.stale_after is None or age < self.stale_after):
            return None
        path, system = self._folder(name)
        system.mkdirs(path)
        return number if _created(system, self.spark._jvm.org.apache.hadoop.fs.Path(path, str(number))) else None

    def renew(self, name: str, number: int) -> None:
        """Keep a claim; it is an error if the experiment has been taken over."""
        if self._last(name)[0] > number + 1:
            raise Taken(f"{name} has been taken over")
        path, system = self._folder(name)
        system.setTimes(self.spark._jvm.org.apache.hadoop.fs.Path(path, str(number)), int(time.time() * 1000), -1)


def _created(system, path) -> bool:
    """Whether this call has created the file."""
    if system.getScheme() == "file":  # Hadoop's local files are looked for first and created then
        try:
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        return system.createNewFile(path)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False


def run_batch(
    spark: SparkSession,
    experiments: Iterable[tuple[str, Callable]],
    root: str,
    parallel: int = 4,
    stale_after: float | None = None,
) -> dict:
    """Run what nobody else has claimed, `parallel` at a time: `{name: result}` of this driver's experiments.

    Experiments that run side by side must not write the same tables: give each a folder of its own.
    An experiment is a name and a function of `after_round`, which it calls after every round to keep its claim, as
    `learning.run_experiment` does. A failure inside an experiment is its result; what a function raises ends the batch when
    all that have begun are over.
    """
    claims = Claims(spark, root, stale_after)

    def run(name: str, experiment: Callable):
        number = claims.take(name)
        if number is None:
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return experiment(lambda _: claims.renew(name, number))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallel) as threads:
        begun = {name: threads.submit(inheritable_thread_target(spark)(run), name, f) for name, f in experiments}
    return {name: future.result() for name, future in begun.items() if future.result() is not None}
