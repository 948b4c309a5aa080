from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import failures as X


def task(key, run_id=1, result=None, kind=None, code=None, message=None, note=None, **blocks):
    return Row(
        notebook_task=blocks.get("notebook"), python_wheel_task=blocks.get("wheel"), run_id=run_id,
        spark_python_task=blocks.get("script"), state=Row(result_state=result, state_message=note),
        status=Row(termination_details=Row(code=code, message=message, type=kind)), task_key=key,
    )


WHEN = datetime(2024, 1, 1, 0, 0, 7, 900000)


def runs(spark, *task_lists):
    rows = [(i, 7, f"run {i}", WHEN, list(tasks)) for i, tasks in enumerate(task_lists)]
    return spark.createDataFrame(rows, S.RUNS)


def test_blamed_task(spark):
    frame = runs(
        spark,
        [task("a", result="SUCCESS"), task("b", result="FAILED"), task("c", result="FAILED")],
        [task("a"), task("b", kind="CLIENT_ERROR")],
        [task("a"), task("b", code="RUN_EXECUTION_ERROR")],
        [task("a", result="SUCCESS"), task("b")],
        [],
        [task(""), task("b")],
    )
    got = {r.run_id: (r.failed_task_key, r.is_fallback) for r in X.heads(frame).collect()}
    assert got == {
        0: ("b", False), 1: ("b", False), 2: ("b", False), 3: ("a", True),
        4: ("unknown_task", True), 5: ("unknown_task", True),
    }
    assert sorted(r.run_id for r in X.qualifying_runs(frame).collect()) == [0, 1, 2]


def test_missing_structs_count_as_no(spark):
    bare = Row(notebook_task=None, python_wheel_task=None, run_id=None, spark_python_task=None, state=None,
               status=None, task_key="a")
    frame = runs(spark, [bare, task("b", result="FAILED")], [bare])
    got = {r.run_id: r.failed_task_key for r in X.heads(frame).collect()}
    assert got == {0: "b", 1: "a"}
    null_list = spark.createDataFrame([(1, 1, "r", WHEN, None)], S.RUNS)
    assert X.qualifying_runs(null_list).count() == 0
    assert X.heads(null_list).first().failed_task_key == "unknown_task"


def test_task_feed_agrees_with_documents(spark):
    lists = [
        [task(f"t{j}", run_id=j, result="FAILED" if (i * j) % 3 == 2 else "SUCCESS") for j in range(i % 5)]
        for i in range(40)
    ]
    nested = X.heads(runs(spark, *lists)).where(F.col("task").isNotNull())
    feed = spark.createDataFrame(
        [(i, j, t) for i, tasks in enumerate(lists) for j, t in enumerate(tasks)], S.RUN_TASKS
    ).repartition(5)
    want = {r.run_id: (r.failed_task_key, r.is_fallback) for r in nested.collect()}
    got = {r.parent_run_id: (r.task.task_key, r.is_fallback) for r in X.blamed_tasks(feed).collect()}
    assert got == want
    ids = {r.parent_run_id for r in X.qualifying_run_ids(feed).collect()}
    assert ids == {run for run, (_, fallback) in want.items() if not fallback}


def test_tasks_without_a_place_or_with_the_same(spark):
    rows = [
        (1, None, task("late", run_id=1, result="FAILED")), (1, 7, task("ok", run_id=2, result="SUCCESS")),
        (2, 3, task("a", run_id=3, result="FAILED")), (2, 3, task("b", run_id=4, result="FAILED")), (2, 1, task("c", run_id=5)),
        (3, None, task("only", run_id=6)), (None, 1, task("lost", run_id=7)),
    ]
    found = X.blamed_tasks(spark.createDataFrame(rows, S.RUN_TASKS)).collect()
    got = {r.parent_run_id: (r.task.task_key, r.is_fallback) for r in found}
    assert got[1] == ("late", False) and got[2] == ("a", False) and got[3] == ("only", True)
    assert len(found) == 3


def test_code_path(spark):
    tasks = [
        task("a", notebook={"notebook_path": "/n"}, script={"python_file": "/s"}),
        task("b", notebook={"notebook_path": ""}, script={"python_file": "/s"}),
        task("c", notebook={}, script={"python_file": "/s"}),
        task("d", wheel={"package_name": "p"}),
        task("e", notebook={"other": "x"}, wheel={"package_name": "p"}),
        task("f"),
    ]
    frame = runs(spark, tasks).select(F.explode("tasks").alias("t"))
    got = {r.k: r.p for r in frame.select(F.col("t.task_key").alias("k"), X.code_path(F.col("t")).alias("p")).collect()}
    assert got == {"a": "/n", "b": "", "c": "/s", "d": "p", "e": "", "f": ""}


def test_identify(spark):
    entry = lambda key, path: Row(notebook_task={"notebook_path": path}, python_wheel_task=None,
                                  spark_python_task=None, task_key=key)
    settings = spark.createDataFrame(
        [(7, Row(name="nightly", tasks=[entry("x", "/x"), entry("b", "/first"), entry("b", "/second")]))],
        S.JOB_SETTINGS,
    )
    frame = spark.createDataFrame(
        [
            (1, 7, "", WHEN, [task("b", run_id=5, result="FAILED", notebook={"notebook_path": "/own"})]),
            (2, 7, "named", WHEN, [task("q", run_id=0, result="FAILED", notebook={"notebook_path": "/own"})]),
            (3, 8, None, WHEN, [task("b", run_id=9, result="FAILED")]),
        ],
        S.RUNS,
    )
    got = {r.source_run_id: r for r in X.identify(X.heads(frame), settings).collect()}
    assert got["1"].source_job_name == "nightly" and got["1"].failure_code_path == "/first"
    assert got["1"].event_id == "7:1:b:1704067207"
    assert got["2"].source_job_name == "named" and got["2"].failure_code_path == "/own"
    assert got["2"].task_run_id is None
    assert got["3"].source_job_name == "" and got["3"].failure_code_path == "" and got["3"].settings is None


def test_require_keys(spark):
    frame = spark.createDataFrame([(1, "a", "b"), (2, " ", "b"), (3, None, "")], "i int, job string, run string")
    complete, rejected = X.require_keys(frame, "job", "run")
    assert [r.i for r in complete.collect()] == [1]
    assert {r.i: r.reason for r in rejected.collect()} == {2: "required: job", 3: "required: job, run"}


# The five failing workloads: text, class by rule, family.
SCENARIOS = [
    ("AnalysisException: [UNRESOLVED_COLUMN.WITH_SUGGESTION] transaction_amount", "UNRESOLVED_COLUMN", "schema_drift"),
    ("[TABLE_OR_VIEW_NOT_FOUND] daily_orders cannot be found", "NOT_FOUND", "missing_object"),
    ("ValueError: data quality rule broken for the daily feed, found 0", "RUN_EXECUTION_ERROR", "data_quality"),
    ("ModuleNotFoundError: No module named 'vendor_library'", "RUN_EXECUTION_ERROR", "dependency"),
    ("PermissionError: permission denied on table payroll", "RUN_EXECUTION_ERROR", "permission"),
]


@pytest.mark.parametrize("text, by_rule, family", SCENARIOS)
def test_scenarios(spark, text, by_rule, family):
    from faultlens.operators.health import failure_families, failure_family

    row = spark.range(1).select(
        X.classify_error(F.lit(text), F.lit("RUN_EXECUTION_ERROR"), F.lit("FAILED")).alias("rule"),
        failure_family(failure_families(F.lit(text))).alias("family"),
    ).first()
    assert (row.rule, row.family) == (by_rule, family)


def test_rule_order(values):
    rule = lambda x: X.classify_error(x, F.lit(""), F.lit(None).cast("string"))
    got = values(rule, [
        "PERMISSION_DENIED and UNRESOLVED_COLUMN", "PermissionDenied: file Not Found", "Path NOT FOUND", "unresolved_column",
    ])
    assert got == ["UNRESOLVED_COLUMN", "PERMISSION_DENIED", "NOT_FOUND", "UNKNOWN"]


def test_description_falls_through_empty_texts(spark):
    text = lambda v: F.lit(v).cast("string")
    row = spark.range(1).select(
        X.describe_error(text(""), text(None), text(""), text("state"), text("{}")).alias("a"),
        X.describe_error(text(None), text("out"), text("t"), text("s"), text("{}")).alias("b"),
        X.describe_error(text(None), text(None), text(None), text(None), text("{}")).alias("c"),
        F.length(X.describe_error(F.repeat(F.lit("x"), 4000), text(""), text(""), text(""), text(""))).alias("n"),
    ).first()
    assert (row.a, row.b, row.c, row.n) == ("state", "out", "{}", 3000 + len("\n...[truncated]..."))
