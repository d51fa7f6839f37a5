"""Queries of the subpackage, their SQL, and the tables they read."""

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The rows come from small files in tests and from many splits at scale; see tagloom.session.spread.


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under `name`, with its SQL if it has one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark, folder: str, name: str, *columns: str):
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)
