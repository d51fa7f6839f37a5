import pytest

from odd_rows import CLASHING, ROWS

FOLDER = "/root/testdata/sf0.001"
@pytest.fixture(scope="session")
def odd_documents(spark):
    """ROWS with the columns of `documents` and many more whose names operators use themselves."""
    from pyspark.sql import functions as F

    given = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr(
        "*", "'en' AS lang", "CASE WHEN doc_id = 3 THEN NULL ELSE 's' END AS source", "length(text)::bigint AS n_chars"
    )
    return given.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row.doc_id: row.text for row in documents.select("doc_id", "text").collect()}
