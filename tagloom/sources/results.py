"""Experiment results: parameter files, result folders, metric and status tables, summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
PARAMETERS = {
    "method": "string",
    "framework": "string",
    "datadir": "string",
    "dataset": "string",
    "outdir": "string",
    "transformer_model": "string",
    "sklearn_model": "string",
    "n_epochs": "int",
    "class_imbalance": "int",
    "init_n": "int",
    "cold_strategy": "string",
    "query_n": "int",
    "query_strategy": "string",
    "train_n": "int",
    "test_n": "int",
    "run_n": "int",
}
RESULTS_TYPE = "map<string,map<string,map<string,double>>>"
RECORD_SCHEMA = (
    ", ".join(f"{name} {kind}" for name, kind in PARAMETERS.items())
    + f", results_dict {RESULTS_TYPE}, Error_Code string"
)
# ----------------------------------------------------------------------------------------------

FOLDER_AND_FILE = r"([^/]+)/([^/]+)$"


def write_grid(grid: DataFrame, path: str) -> None:
    """Parameter grid as CSV with header; a second write replaces the first instead of repeating it."""
    grid.write.mode("overwrite").csv(path, header=True)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Parameter grid from CSV. Columns that a grid lacks are absent, as in the file."""
    table = spark.read.csv(path, header=True)
    return table.select(*(F.col(name).cast(PARAMETERS.get(name, "string")).alias(name) for name in table.columns))


def list_result_files(spark: SparkSession, root: str) -> DataFrame:
    """`<folder, file_name>` of every file one folder below `root`. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_extract("path", FOLDER_AND_FILE, 1).alias("folder"),
        F.regexp_extract("path", FOLDER_AND_FILE, 2).alias("file_name"),
    )


def read_result_files(spark: SparkSession, root: str) -> DataFrame:
    """`<folder, file_name, content>` of the JSON files one folder below `root`."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(path, FOLDER_AND_FILE, 1).alias("folder"),
        F.regexp_extract(path, FOLDER_AND_FILE, 2).alias("file_name"),
        F.col("value").alias("content"),
    )


def write_run_table(df: DataFrame, path: str) -> None:
    """Metrics or predictions in long form; writing a run again replaces that run only."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("experiment", "run").parquet(path)


def write_status(df: DataFrame, path: str) -> None:
    """Status events `<folder, file_name, content>`, appended: an event is never rewritten."""
    df.write.mode("append").parquet(path)


def write_summary(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """Summary table as Parquet, or as CSV with nested columns rendered as JSON."""
    if not as_csv:
        df.write.mode("overwrite").parquet(path)
        return
    nested = ("map", "array", "struct")
    columns = [
        F.to_json(name).alias(name) if kind.startswith(nested) else F.col(name) for name, kind in df.dtypes
    ]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
