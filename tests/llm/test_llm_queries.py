"""The registered queries of the operators against SQL, where SQL can say them."""

import duckdb
import pytest

from faultlens.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    rows = sorted(repr(tuple(row[c] for c in sorted(frame.columns))) for row in frame.collect())
    assert rows
    if name in oracle.SQL:
        connection = duckdb.connect()
        for table in ("documents", "benchmark", "pages", "labels"):
            connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        cursor = connection.execute(oracle.SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        places = sorted(range(len(names)), key=lambda i: names[i])
        assert rows == sorted(repr(tuple(row[i] for i in places)) for row in cursor.fetchall())
