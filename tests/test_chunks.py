"""The chunk queries against their SQL on a table of odd rows: ids that come twice or not at all, nulls, empty and blank
texts, words of over 1000 bytes and white space that is not ASCII."""

import os

import duckdb
import pytest

from memoria import plans

LONG = "é" * 1100
ODD = [
    (1, "one two three " * 200, "en", "src1"), (1, "one two three " * 200, "en", "src1"), (3, "first " * 300, "de", "src1"), (3, "second " * 300, None, "src2"), (3, "", "fr", "src3"),
    (6, None, "en", "src1"), (6, "", "de", None), (6, "   \n\t", "de", "src1"), (9, "no language", None, "src1"), (10, "no source " * 150, "en", None), (12, "", "", "src1"),
    (None, "no id " * 200, "en", "src1"), (None, "no id", "en", "src1"), (15, f"a {LONG} b c", "en", "src1"), (16, LONG, "en", "src1"), (18, f"word{' ' * 1200}x", "en", ""),
    (50, "a b c\u0085d " * 120, "en", "src1"), (51, "a\x1cb\x1fc\x0bd\x0ce\r\n" * 120, "en", "src1"), (-3, "below nought " * 100, "en", "src:1"), (100, "x" * 999 + " y z", "es", "src1"), (101, " lead", "es", "src1"),
]


def both(spark, folder, name):
    columns = (df := plans.QUERIES[name](spark, folder)).columns
    db = duckdb.connect()
    for table in os.listdir(folder):
        db.execute(f"create view {table.split('.')[0]} as select * from '{folder}/{table}/*.parquet'")
    theirs = db.execute(f"select {', '.join(columns)} from ({plans.SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(theirs, key=repr)


@pytest.mark.parametrize("rows", [ODD, ODD[:1]], ids=["odd", "one"])
@pytest.mark.parametrize("name", ["record_chunks", "chunk_coverage", "missing_chunks", "orphan_vectors", "storable_vectors"])
def test_chunk_queries_on_odd_rows(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ours, theirs = both(spark, str(tmp_path), name)
    assert ours == theirs


def test_coverage_of_no_chunks_is_null(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in plans.QUERIES["chunk_coverage"](spark, str(tmp_path)).collect()] == [(None, 0)]


def test_only_rows_of_repeated_ids_move(spark, tmp_path):
    spark.createDataFrame([(i, "some words", "en", "src1") for i in range(50)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES["record_chunks"](spark, str(tmp_path))
    df.collect()
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
