"""Two-phase analysis of a few hand-written runs."""

import hashlib
import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import schemas as S
from faultlens.operators import evidence as E
from faultlens.operators import failures
from faultlens.operators import prompts as P
from faultlens.plans import analysis
from faultlens.sources.readers import (
    outputs_from_documents,
    runs_from_documents,
    settings_from_documents,
    split_documents,
)
from tests.test_failures import task

WHEN = datetime(2024, 1, 1, 0, 0, 7)
REFS = [f"lake.sales.t{i:02d}" for i in range(12)]


def inputs(spark, template="{{x}} {source_run_id} {evidence_bundle_json}"):
    runs = [
        (1, 7, "nightly", WHEN, [task("load", run_id=11, result="FAILED", note="see " + " ".join(REFS))]),
        (2, 7, "", WHEN, [task("load", run_id=None, result="FAILED", message="ended")]),
        (3, 8, "ok", WHEN, [task("load", run_id=31, result="SUCCESS")]),
        (4, 8, "gone", WHEN, [task("load", run_id=41, code="RUN_EXECUTION_ERROR")]),
        (None, 8, "no id", WHEN, [task("load", result="FAILED")]),
    ]
    entry = Row(notebook_task={"notebook_path": "/src"}, python_wheel_task=None, spark_python_task=None, task_key="load")
    prompt = ("p", "a", "2", "TRUE", "m", "", "", "sys", template, "", "t", "t")
    return analysis.Inputs(
        runs=spark.createDataFrame(runs, S.RUNS),
        settings=spark.createDataFrame([(7, Row(name="nightly job", tasks=[entry]))], S.JOB_SETTINGS),
        outputs=spark.createDataFrame(
            [(1, None, "root log", None, None), (11, "UNRESOLVED_COLUMN in lake.sales.t00", "x" * 12001, "", "{}")],
            S.RUN_OUTPUTS,
        ),
        source_code=spark.createDataFrame([("/src", "read('raw.in.x')" + "y" * 16000)], S.SOURCE_CODE),
        table_columns=spark.createDataFrame(
            [("lake.sales.t00", 2, "b", "int", None), ("lake.sales.t00", 1, "a", "string", "key")], S.TABLE_COLUMNS
        ),
        table_history=spark.createDataFrame(
            [("lake.sales.t00", v, WHEN, "WRITE") for v in range(9)] + [("lake.sales.t01", 1, WHEN, "WRITE")],
            S.TABLE_HISTORY,
        ),
        table_details=spark.createDataFrame([("lake.sales.t00", "parquet", 3)], S.TABLE_DETAILS),
        prompts=spark.createDataFrame([prompt], S.PROMPTS),
    )


@pytest.fixture(scope="module")
def collected(spark):
    return analysis.collect(inputs(spark), "p", "a")


@pytest.fixture(scope="module")
def evidence(collected):
    rows = collected.evidence.orderBy("source_run_id", "ord", "detail").collect()
    found = {}
    for row in rows:
        found.setdefault(row.source_run_id, []).append((row.collector_name, json.loads(row.evidence_json)))
    return found


def test_only_failed_runs_with_keys_become_events(collected):
    events = {r.source_run_id: r for r in collected.events.collect()}
    assert set(events) == {"1", "2", "4"}
    first = events["1"]
    assert first.event_id == "7:1:load:1704067207" and first.source_job_name == "nightly"
    assert events["2"].source_job_name == "nightly job"
    assert json.loads(first.payload_json) == {
        "failed_task_key": "load", "failed_task_run_id": "11", "failure_code_path": "/src",
        "slack_channel": V.DEFAULT_CHANNEL, "source_job_id": "7", "source_job_name": "nightly",
        "source_run_id": "1", "trigger_source": "job_failure_callback",
    }
    rejected = collected.rejects.collect()
    assert [(r.source_run_id, r.event_id, r.reason) for r in rejected] == [(None, None, "required: run_id")]
    assert rejected[0].source_job_id is not None


def test_all_runs_may_be_analysed(spark):
    everything = analysis.collect(inputs(spark), "p", "a", only_failed=False)
    assert {r.source_run_id for r in everything.events.collect()} == {"1", "2", "3", "4"}


def test_evidence_order_and_count(evidence):
    names = [name for name, _ in evidence["1"]]
    fixed = ["job_run", "job_settings", "failed_task_settings", "root_run_output", "failed_task_output", "failure_code"]
    assert names == fixed + ["discovered_table_schema"] * 10 + ["error_summary"]
    assert [name for name, _ in evidence["4"]] == fixed + ["error_summary"]


def test_documents(evidence):
    one = dict(evidence["1"])
    assert one["job_run"]["tasks"][0]["state"]["result_state"] == "FAILED"
    assert "run_name" in one["job_run"] and "python_wheel_task" not in one["job_run"]["tasks"][0]
    assert one["job_settings"]["settings"]["name"] == "nightly job"
    assert one["failed_task_output"]["logs"] == "x" * 12000 + V.TRUNCATION_MARKER
    assert one["failure_code"]["source"].endswith(V.TRUNCATION_MARKER)
    assert one["error_summary"] == {
        "error_description": "UNRESOLVED_COLUMN in lake.sales.t00", "error_type": "UNRESOLVED_COLUMN"
    }


def test_absent_documents(evidence):
    two, four = dict(evidence["2"]), dict(evidence["4"])
    assert two["failed_task_output"] == {"warning": "Failed task run id not found"}
    assert two["error_summary"] == {"error_description": "ended", "error_type": "NOT_FOUND"}
    assert four["job_settings"] == {} and four["failed_task_settings"] == {}
    assert four["failure_code"] == {"warning": "No task code path discovered"}
    assert four["failed_task_output"]["error"].startswith("LookupError")
    assert four["error_summary"]["error_type"] == "RUN_EXECUTION_ERROR"


def test_tables_are_the_first_ten_and_keep_what_is_known(evidence, collected):
    tables = [doc for name, doc in evidence["1"] if name == "discovered_table_schema"]
    assert [t["table"] for t in tables] == REFS[:10]
    known, partly, absent = tables[0], tables[1], tables[2]
    assert [c["col_name"] for c in known["schema"]] == ["a", "b"]
    assert [h["version"] for h in known["recent_history"]] == [8, 7, 6, 5, 4]
    assert known["detail"] == [{"format": "parquet", "num_files": 3}] and "missing_parts" not in known
    assert partly["missing_parts"] == ["detail", "schema"]
    assert absent["error"].startswith("LookupError")
    refs = {r.event_id.split(":")[1]: r.refs for r in collected.refs.collect()}
    assert refs["1"] == sorted([*REFS, "raw.in.x"])  # all of them, not only ten


def test_requests(collected):
    rows = {r.event_id.split(":")[1]: r for r in collected.requests.collect()}
    one = rows["1"]
    assert (one.temperature, one.max_tokens, one.model_endpoint) == (0.1, 1600, "m")
    head, bundle = one.user_prompt.split(" ", 2)[:2], one.user_prompt.split(" ", 2)[2]
    assert head == ["{x}", "1"]
    items = json.loads(bundle)
    assert len(items) == 17 and set(items[0]) == {"collector_name", "evidence_json_excerpt"}
    assert all(len(i["evidence_json_excerpt"]) <= 18000 + len(V.TRUNCATION_MARKER) for i in items)


@pytest.mark.parametrize(
    "template, prompt, reason",
    [
        ("{other}", "p", "unknown placeholder {other}"),
        ("a } b", "p", "unknown placeholder }"),
        ("fine", "q", "No active RCA prompt found for q@a"),
    ],
)
def test_events_that_cannot_be_asked(spark, template, prompt, reason):
    got = analysis.collect(inputs(spark, template), prompt, "a")
    assert got.requests.count() == 0
    assert {r.reason for r in got.rejects.where(F.col("event_id").isNotNull()).collect()} == {reason}


def test_reports(spark, collected):
    ids = {r.source_run_id: r.event_id for r in collected.asked.collect()}
    answer = json.dumps({"error_type": "", "possible_fixes": "restart", "confidence": ["a"], "prompt_metadata": 1})
    content = lambda text: [Row(message=Row(content=text))]
    responses = spark.createDataFrame(
        [(ids["1"], content(answer), None, None, None), (ids["2"], None, ["words"], None, None)], S.MODEL_RESPONSES
    )
    attempts = spark.createDataFrame([(ids["1"], "helper", 1, True, None, None, None)], S.DELIVERY_ATTEMPTS)
    out = analysis.report(collected.asked, responses, attempts)
    rows = {r.source_run_id: r for r in out.reports.collect()}
    assert out.reports.columns == S.REPORTS.fieldNames()
    one = rows["1"]
    assert one.error_type == "UNRESOLVED_COLUMN" and one.error_description.startswith("UNRESOLVED")
    assert one.possible_fixes == '"restart"' and one.confidence == '["a"]'
    assert one.slack_notification_status == "sent_helper" and one.created_at == "2024-01-01T00:00:07+00:00"
    whole = json.loads(one.report_json)
    assert whole["prompt_metadata"]["prompt_name"] == "p" and whole["slack_notification"]["status"] == "sent_helper"
    assert json.loads(rows["2"].report_json)["summary"] == "words" and rows["2"].error_type == "UNKNOWN"
    assert rows["4"].error_type == "MODEL_CALL_FAILED" and rows["4"].missing_context == '["Model response"]'
    assert rows["4"].slack_notification_status == "skipped_missing_slack_config"
    assert out.evidence.count() == 3 and out.notifications.count() == 3


def test_run_documents_in_json(spark):
    text = json.dumps({"run_id": 5, "job_id": 6, "tasks": [{"task_key": "t", "extra": {"x": 1}, "notebook_task": {"notebook_path": "/n"}}]})
    frame = spark.createDataFrame([(text,), ("{}",)], "details string")
    rows = runs_from_documents(frame, "details", F.lit("2024-01-01")).collect()
    by_id = {r.run_id: r for r in rows}
    assert by_id[5].tasks[0].notebook_task == {"notebook_path": "/n"} and by_id[5].tasks[0].state is None
    assert by_id[None].tasks is None


def test_whole_documents_are_kept_and_searched(spark):
    task_text = {"task_key": "load", "state": {"result_state": "FAILED"}, "depends_on": [{"task_key": "a.b.c"}],
                 "sql_task": {"query": 'select "x" from `lake`.raw.orders -- \\\n"'}, "w.x.y": 1.50}
    run = json.dumps({"job_id": 7, "run_id": 1, "run_page_url": "http://host/1", "tasks": [task_text]})
    job = json.dumps({"creator": "me", "settings": {"name": "n", "tags": {"k": "main.ops.tags"}, "tasks": [
        {"task_key": "other", "retries": 0}, {"task_key": "load", "retries": 2}, {"task_key": "load"}]}})
    frame = spark.createDataFrame([(run, job)], "run string, job string")
    runs = runs_from_documents(frame, "run", F.lit("2024-01-01"))
    settings = settings_from_documents(frame.withColumn("id", F.lit(7)), "id", "job")
    got = analysis.collect(replace(inputs(spark), runs=runs, settings=settings), "p", "a")
    shown = {r.collector_name: r.evidence_json for r in got.evidence.collect()}
    assert shown["job_run"] == run and shown["job_settings"] == job
    assert json.loads(shown["failed_task_settings"]) == {"task_key": "load", "retries": 2}
    assert got.refs.first().refs == ["a.b.c", "lake.raw.orders", "main.ops.tags"]  # no reference from a key


def test_all_columns_of_a_snapshot_are_kept(spark):
    known = inputs(spark)
    history = known.table_history.withColumn("user_name", F.lit("u")).withColumn("metrics", F.create_map(F.lit("rows"), F.lit(1)))
    details = known.table_details.withColumn("location", F.lit('/"x"'))
    found = E.table_documents(known.table_columns, history, details).where("table_name = 'lake.sales.t00'").first()
    document = json.loads(found.table_json)
    assert document["detail"] == [{"format": "parquet", "num_files": 3, "location": '/"x"'}]
    assert document["recent_history"][0]["metrics"] == {"rows": 1} and document["recent_history"][0]["user_name"] == "u"


def test_snapshot_times_do_not_depend_on_the_session_zone(spark):
    known = inputs(spark)
    zone = "spark.sql.session.timeZone"
    spark.conf.set(zone, "Asia/Tokyo")
    try:
        found = E.table_documents(known.table_columns, known.table_history, known.table_details).where("table_name = 'lake.sales.t01'").first()
    finally:
        spark.conf.set(zone, "UTC")
    assert json.loads(found.table_json)["recent_history"][0]["timestamp"] == "2024-01-01 00:00:07"


def test_repeated_and_simultaneous_runs(spark):
    known = inputs(spark)
    one = known.runs.where("run_id = 1")
    close = one.withColumn("event_ts", F.col("event_ts") + F.expr("interval 300 milliseconds"))
    runs = one.unionByName(one).unionByName(one).unionByName(close)
    got = analysis.collect(replace(known, runs=runs), "p", "a")
    ids = [r.case_id for r in got.asked.collect()]
    assert got.events.count() == len(ids) == len(set(ids)) == 2
    assert got.requests.count() == 2 and got.requests.select("event_id").distinct().count() == 1
    assert got.evidence.groupBy("case_id").count().select("count").distinct().collect() == [Row(count=17)]
    assert [(r.reason, len(r.digest)) for r in got.rejects.collect()] == [("delivered again: 2", 32)]
    by_event = spark.createDataFrame([(r.event_id, None, ["one"], None, None) for r in got.events.limit(1).collect()], S.MODEL_RESPONSES)
    attempts = spark.createDataFrame([], S.DELIVERY_ATTEMPTS)
    assert analysis.report(got.asked, by_event, attempts).reports.count() == 2
    said = [(case, None, [f"answer {case}"], None, None) for case in ids]
    by_case = spark.createDataFrame(said, S.MODEL_RESPONSES).withColumnRenamed("event_id", "case_id")
    reports = analysis.report(got.asked, by_case, attempts).reports.collect()
    assert {json.loads(r.report_json)["summary"] for r in reports} == {f"answer {case}" for case in ids}


def test_of_differing_deliveries_the_fullest_counts(spark):
    """Most tasks first, then the longest text; every other text is a reject with its digest."""
    known = inputs(spark)
    short = json.dumps({"run_id": 1, "job_id": 7, "tasks": [{"task_key": "a", "state": {"result_state": "FAILED"}}]})
    long = short[:-1] + ', "note": "more"}'
    two = json.dumps({"run_id": 1, "job_id": 7, "tasks": [{"task_key": "b", "state": {"result_state": "FAILED"}}, {}]})
    turned = json.dumps(dict(reversed(json.loads(two).items())), indent=1)
    texts = spark.createDataFrame([(t,) for t in [short, two, long, short, turned, long, short]], "details string")
    got = analysis.collect(replace(known, runs=runs_from_documents(texts, "details", F.lit("2024-01-01"))), "p", "a")
    assert [r.failed_task_key for r in got.events.collect()] == ["b"]
    # A text whose keys come in another order is the same delivery.
    assert [r.evidence_json for r in got.evidence.where("collector_name = 'job_run'").collect()][0] in (two, turned)
    digest = lambda text: hashlib.md5(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {(r.reason, r.digest) for r in got.rejects.collect()} == {
        ("delivered again: 3", digest(short)), ("delivered again: 2", digest(long)), ("delivered again: 1", digest(two))}


def test_unreadable_documents_are_rejects(spark):
    good = json.dumps({"run_id": 5, "job_id": 7, "tasks": [{"task_key": "t", "state": {"result_state": "FAILED"}}]})
    texts = [good, good[:-9], f"[{good}]", good + " x", None, "", "17", "{'run_id': 5}", "{}", '{"run_id": "seven", "job_id": 7}']
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, details string")
    objects, bad = split_documents(frame, "details", "run", source_run_id=F.col("n"))
    assert bad.columns == S.REJECTS.fieldNames()
    assert [(r.source_run_id, r.reason) for r in bad.orderBy("source_run_id").collect()] == [
        ("1", "unreadable run: not JSON"), ("2", "unreadable run: not an object but array"), ("3", "unreadable run: not JSON"),
        ("4", "unreadable run: no document"), ("5", "unreadable run: not JSON"), ("6", "unreadable run: not an object but number"),
        ("7", "unreadable run: not JSON")]
    assert {r.source_run_id: r.digest for r in bad.collect()}["1"] == hashlib.md5(texts[1].encode()).hexdigest()
    runs = runs_from_documents(objects, "details", F.lit("2024-01-01"))
    got = analysis.collect(replace(inputs(spark), runs=runs, unreadable=bad), "p", "a", only_failed=False)
    assert [r.source_run_id for r in got.events.collect()] == ["5"]
    reasons = sorted(r.reason for r in got.rejects.collect())
    assert reasons == sorted([r.reason for r in bad.collect()] + ["required: job_id, run_id", "required: run_id"])


def test_output_documents(spark):
    texts = ['{"error": "e", "logs": "l", "metadata": {"a": [1]}, "x": null}', '{"notebook_output": {"result": "r"}}', "{}",
             '{"logs": 5, "x": {"a": 1, "a": 2}}']
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, details string")
    rows = {r.run_id: r for r in outputs_from_documents(frame, F.col("n"), "details").collect()}
    assert (rows[0].error, rows[0].logs, rows[0].notebook_output) == ("e", "l", None)
    assert json.loads(rows[0].output_json) == {"metadata": {"a": [1]}, "x": None}
    assert rows[1].notebook_output == '{"result":"r"}' and rows[1].output_json is None
    assert tuple(rows[2])[1:] == (None,) * 4
    assert rows[3].logs == "5" and rows[3].output_json == texts[3]


def test_one_report_per_case_whatever_responses_repeat(spark, collected):
    asked = collected.asked
    cases = {r.source_run_id: r for r in asked.collect()}
    attempts = spark.createDataFrame([], S.DELIVERY_ATTEMPTS)
    schema = "case_id string, event_id string, answered_at timestamp, predictions array<string>, error string"
    later = WHEN.replace(minute=5)
    rows = [(cases["1"].case_id, None, WHEN, ["first"], None), (cases["1"].case_id, None, later, ["a later one"], None),
            (cases["1"].case_id, None, WHEN, ["first"], None), (cases["2"].case_id, None, WHEN, ["only"], None)]
    nothing = {"choices": F.lit(None).cast(S.MODEL_RESPONSES["choices"].dataType), "outputs": F.lit(None).cast("array<string>")}
    out = analysis.report(asked, spark.createDataFrame(rows, schema).withColumns(nothing), attempts)
    told = {r.source_run_id: json.loads(r.report_json).get("summary") for r in out.reports.collect()}
    assert out.reports.count() == 3 and told["1"] == "first" and told["2"] == "only"
    assert [(r.source_run_id, r.reason) for r in out.rejects.collect()] == [("1", "answered again: 2")]
    # By event id, which two runs of a second share, each gets the one answer.
    by_event = spark.createDataFrame([(cases["1"].event_id, None, ["x"], None, None)] * 2, S.MODEL_RESPONSES)
    twins = asked.unionByName(asked.where("source_run_id = '1'").withColumn("case_id", F.lit("twin")))
    out = analysis.report(twins, by_event, attempts)
    assert out.reports.count() == 4 and [r.reason for r in out.rejects.collect()] == ["answered again: 1"]


def test_settings_documents_in_json(spark):
    text = json.dumps({"settings": {"name": "n", "tasks": [{"task_key": "t", "spark_python_task": {"python_file": "/f"}}]}})
    frame = spark.createDataFrame([("7", text), ("8", "{}")], "job string, details string")
    rows = {r.job_id: r.settings for r in settings_from_documents(frame, "job", "details").collect()}
    assert rows[7].name == "n" and rows[7].tasks[0].spark_python_task == {"python_file": "/f"} and rows[8] is None


def test_default_template_is_complete(spark):
    pieces = P.template_pieces(F.lit(V.DEFAULT_USER_TEMPLATE))
    row = spark.range(1).select(P.template_error(pieces).alias("e"), pieces.alias("p")).first()
    assert row.e is None
    assert {p[1:-1] for p in row.p if p.startswith("{")} == set(V.PROMPT_PLACEHOLDERS)


def test_inserted_values_are_not_scanned_again(spark):
    pieces = P.template_pieces(F.lit("{{{source_job_id}}} {discovered_tables}"))
    filled = P.fill_template(pieces, {"source_job_id": F.lit("{discovered_tables}"), "discovered_tables": F.lit("T")})
    assert spark.range(1).select(filled.alias("x")).first().x == "{{discovered_tables}} T"


def test_only_what_is_read_is_written(spark):
    written = []

    def keep(frame, label):
        written.append(label)
        return frame

    got = analysis.collect(inputs(spark), "p", "a", keep=keep)
    assert got.asked.count() == 3 and written == ["cases", "asked"]
    assert got.requests.count() == 3 and written == ["cases", "asked", "again", "evidence", "outputs", "refs"]
    assert got.evidence.count() > 0 and len(written) == 6


def test_a_report_reads_no_document_and_searches_no_text(spark):
    """The error summary has a path of its own: no evidence documents, no references."""
    got = analysis.collect(inputs(spark), "p", "a", keep=lambda frame, _: frame)
    plan = got.summaries._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    whole = {r.case_id: (r.error_type, r.error_description) for r in got.outputs.where("error_type is not null").collect()}
    assert {r.case_id: (r.error_type, r.error_description) for r in got.summaries.collect()} == whole


def test_lookups_are_cut_to_what_is_asked_before_their_texts_are_read(spark):
    known = inputs(spark)
    got = analysis.collect(known, "p", "a", keep=lambda frame, _: frame)
    code = E.code_evidence(got.cases, known.source_code)
    plan = code._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    # In the printed tree an operator stands above its inputs: the search is done on what the join leaves.
    assert plan.index("regexp_extract_all") < plan.index("LeftSemi")


def test_a_run_delivered_often_is_reduced_where_it_is_read(spark):
    runs = inputs(spark).runs.where("run_id = 1").withColumn("digest", F.lit(1))
    first = failures.first_deliveries(failures.heads(failures.with_document(runs)), "digest")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_texts_are_judged_once_for_both_parts(spark):
    """Neither part, nor a filter on what was read of it, goes back to the source or parses a text again to judge it."""
    frame = spark.createDataFrame([("{}",), ("{",), (None,)], "details string").withColumn("details", F.concat("details", F.lit(" ")))
    for part in split_documents(frame, "details", "run"):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "concat(details" not in plan


def test_deliveries_are_ranked_once(spark):
    """Which cases repeat is known from the written cases; the texts are not read for it again."""
    from faultlens import session

    got = analysis.collect(inputs(spark), "p", "a", keep=session.stage)
    plan = failures.delivered_again(got.counted)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" not in plan and "parse_json" not in plan
    assert got.again.isEmpty() and "delivered again" not in got.rejects._jdf.queryExecution().optimizedPlan().toString()


def test_what_outputs_share_is_made_once(spark):
    """Table documents for the evidence and the requests, and answers for reports, notifications and evidence."""
    from faultlens import session

    written = []

    def keep(frame, label):
        written.append(label)
        return session.stage(frame, label)

    got = analysis.collect(inputs(spark), "p", "a", keep=keep)
    frames = analysis.collected_frames(got)
    assert written.count("tables") == 1
    for name in ("evidence", "prompt_requests"):
        assert "row_number" not in frames[name]._jdf.queryExecution().optimizedPlan().toString()
    answers = spark.createDataFrame([], "event_id string, choices array<struct<message: struct<content: string>>>, "
                                    "predictions array<string>, outputs array<string>, error string")
    attempts = spark.createDataFrame([], S.DELIVERY_ATTEMPTS)
    reported = analysis.report(got.asked, answers, attempts)
    for frame in (reported.reports, reported.notifications, reported.evidence):
        assert "regexp_extract(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert reported.reports.count() == got.asked.count() == 3


def test_a_case_without_references_keeps_its_row(spark):
    """Rows without references are left out before rows are grouped, but for the run document."""
    from faultlens import session

    frames = {}

    def keep(frame, label):
        frames[label] = session.stage(frame, label)
        return frame if label == "refs" else frames[label]

    got = analysis.collect(inputs(spark), "p", "a", keep=keep)
    assert {r.case_id for r in got.refs.collect()} == {r.case_id for r in got.cases.collect()}
    assert "size(refs" in got.refs._jdf.queryExecution().optimizedPlan().toString()


def test_settings_that_come_twice_do_not_count_deliveries_again(spark):
    known = inputs(spark)
    thrice = known.runs.where("run_id = 1")
    runs = known.runs.unionByName(thrice).unionByName(thrice)
    got = analysis.collect(replace(known, runs=runs, settings=known.settings.unionByName(known.settings)), "p", "a")
    again = [r.reason for r in got.rejects.collect() if r.reason.startswith("delivered again")]
    assert again == ["delivered again: 2"]
