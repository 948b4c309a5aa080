"""Every registered query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from faultlens.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def second_engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in places)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, second_engine, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    cursor = second_engine.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    rows = ordered(cursor.fetchall(), columns)
    assert rows
    assert ordered(map(tuple, frame.collect()), frame.columns) == rows


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(catalog.QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"stream_failed_runs", "stream_analysis"}))
def test_plans_stay_on_native_operators(spark, name):
    plan = entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "PythonUDF", "ArrowEvalPython", "MapInPandas", "BatchEvalPython"):
        assert unwanted not in plan
    assert plan.count("BroadcastNestedLoopJoin") == 0


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry_points.queries()["truncate_text"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    prompt = entry_points.queries()["latest_report"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in prompt
    history = entry_points.queries()["recent_history_top5"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert history.index("WindowGroupLimit") < history.index("Exchange")
    assert history.rindex("WindowGroupLimit") > history.index("Exchange")


def test_the_first_failed_task_is_found_in_a_buffer_of_fixed_width(spark):
    """No sort-based aggregation, and the least rank is taken from a few columns of the feed."""
    plan = entry_points.queries()["first_failed_task"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min(_rank" in plan
    assert plan.count("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_returnflag:") == 2
