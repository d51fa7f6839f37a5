"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from conftest import FOLDER
from tools.compare import compare, connect

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    outcome, rows, _, difference = compare(spark, connection, FOLDER, name)
    assert outcome in ("same", "rows-only"), difference


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
