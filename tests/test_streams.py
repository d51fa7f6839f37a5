import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_a_table_of_part_files(spark, tmp_path, parts):
    """A table is a folder of files; other tables beside it are not read."""
    rows = [(1, " a  b "), (2, None), (3, "[URL]"), (4, "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "x")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries()["clean_stream_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, "a b", 3), (4, "c", 1)]


def test_stream_reads_a_table_of_one_file(spark, tmp_path):
    folder = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").coalesce(1)
    folder.write.parquet(f"{tmp_path}/made")
    (file,) = (tmp_path / "made").glob("part-*")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "documents.parquet").write_bytes(file.read_bytes())
    found = queries()["clean_stream_documents"](spark, str(tmp_path / "in")).collect()
    assert [tuple(r) for r in found] == [(1, "a", 1)]
