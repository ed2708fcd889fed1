"""Operators that SQL can express give the rows that DuckDB gives on whole tables."""

import duckdb
import pytest

from memoria.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows(spark, name, data):
    found = queries.QUERIES[name](spark, data)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{data}/documents.parquet'")
    con = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, con.fetchall())) == sorted(map(tuple, found.select(*names).collect()))
