"""Session settings and the shared folder that holds state between jobs."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tagloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested with. `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from `spark.checkpoint.dir`.

    A local-mode session without that setting uses its warehouse; a cluster session without it is an error, because
    a folder of one machine would lose state with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # executors of a local-cluster are machines of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/tagloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and unlike a checkpoint keeps
    column pruning and filter pushdown for whatever reads the result.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Like `materialize`, as a table in buckets: joins and groups on `keys` with tables of as many buckets move no rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def buckets_for(df: DataFrame, bytes_per_bucket: int = 64 << 20) -> int:
    """Buckets for a table, by the planner's estimate of its bytes: one per MB as long as there are task slots. As many as
    slots if the planner knows no bytes, which it does for every stored table."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >> 55:
        return slots
    return min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")), max(-(-size // bytes_per_bucket), min(slots, 1 + (size >> 20))))


def release(spark: SparkSession) -> None:
    """Delete everything this application has stored with `materialize` and `new_path`; call it when no DataFrame that
    reads it is needed any more, such as at the end of an application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tagloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle an input that has fewer splits than the session has task slots; else leave it alone.

    For work that costs far more than moving the rows, such as cleaning text from one small file. A
    large input has more splits than slots and is never shuffled here. Meant for plain scans: asking
    a plan with shuffles for its number of partitions would run them.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df
