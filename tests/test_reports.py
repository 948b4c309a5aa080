import json

import pytest
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import notify, reports


def fields(spark, *texts, name="job"):
    frame = spark.createDataFrame([(str(i), "7", "1", name, "t", text) for i, text in enumerate(texts)],
                                  "event_id string, source_job_id string, source_run_id string, "
                                  "source_job_name string, failed_task_key string, answer string")
    parsed = reports.parse_report(frame, F.col("answer"), F.col("source_job_name"), F.col("failed_task_key"))
    return reports.report_fields(parsed)


FORMS = [
    ('{"title": "a"}', "whole"),
    (' \n{"title": "a"}\xa0', "whole"),
    ('```json\n{"title": "a"}\n```', "inner"),
    ('see {"title": "a"} done', "inner"),
    ("[1, 2]", "fixed"),
    ('[{"title": "a"}]', "fixed"),
    ("42", "fixed"),
    ('x {"a": 1} y {"b": 2} z', "fixed"),
    ("{'title': 'a'}", "fixed"),
    ("", "fixed"),
    (None, "fixed"),
]


def test_forms_of_answers(spark):
    rows = {r.event_id: r for r in fields(spark, *[text for text, _ in FORMS]).collect()}
    for i, (text, source) in enumerate(FORMS):
        row = rows[str(i)]
        assert row.report_source == source, text
        report = json.loads(row.report_json)
        if source == "fixed":
            assert report["summary"] == (text or "").strip()[:2000] and len(report) == 15
            assert row.model_error_type == "UNKNOWN" and row.model_confidence == "low"
        else:
            assert report == {"title": "a"}


def test_summary_is_bounded(spark):
    row = fields(spark, "w" * 5000).first()
    assert json.loads(row.report_json)["summary"] == "w" * 2000


def test_field_forms(spark):
    answers = [
        {"error_type": None, "confidence": 0, "possible_fixes": [], "owner_next_steps": ["o"], "evidence": {"k": 1}},
        {"error_type": ["x", 1], "possible_fixes": {"a": 1}, "recommended_fix": "r"},
        {"possible_fixes": "", "recommended_fix": '["p", "q"]', "databricks_links": ["u", "v", "w"], "error_type": ""},
        {"recommended_fix": None},
    ]
    rows = sorted(fields(spark, *map(json.dumps, answers)).collect(), key=lambda r: int(r.event_id))
    a, b, c, d = rows
    assert (a.error_type_shown, a.model_error_type, a.confidence_shown, a.model_confidence) == ("None", None, "0", None)
    assert (a.possible_fixes, a.evidence_json, a.missing_context) == ('["o"]', '{"k":1}', "[]")
    assert a.fix_lines == []  # the message looks at recommended_fix next, not at the owner's steps
    assert (b.model_error_type, b.possible_fixes, b.fix_lines) == ('["x",1]', '{"a":1}', ['{"a":1}'])
    assert (c.fix_lines, c.link_lines, c.error_type_shown) == (["p", "q"], ["u", "v", "w"], "")
    assert (d.fix_lines, d.error_type_shown, d.possible_fixes) == ([], None, "[]")


def test_content_pick(spark):
    frame = spark.createDataFrame(
        [
            ("a", [((("c",),))], ["p"], ["o"], None), ("b", [], ["p"], ["o"], None), ("c", None, None, ["o"], None),
            ("d", None, [], [], None), ("e", [((None,),)], ["p"], None, None),
        ],
        S.MODEL_RESPONSES,
    )
    pick = reports.response_content(F.col("choices"), F.col("predictions"), F.col("outputs"))
    got = {r.event_id: r.c for r in frame.select("event_id", pick.alias("c")).collect()}
    assert got == {"a": "c", "b": "p", "c": "o", "d": "", "e": ""}


def test_attach(values):
    add = lambda x: reports.attach(x, F.struct(F.lit("n").alias("prompt_name")), F.struct(F.lit("s").alias("status")))
    got = [json.loads(t) for t in values(add, ["{}", '{"a":"é\\n"}', '{"slack_notification":1,"b":[2]}'])]
    extra = {"prompt_metadata": {"prompt_name": "n"}, "slack_notification": {"status": "s"}}
    assert got == [extra, {"a": "é\n", **extra}, {"b": [2], **extra}]


def test_message_text(spark):
    answer = json.dumps({"error_type": "E", "possible_fixes": ["a", "b", "c", "d"], "likely_root_cause": "x" * 1000,
                         "primary_error": "boom"})
    row = notify.notifications(fields(spark, answer, name="")).first()
    assert row.text == (
        "Databricks job RCA generated\nJob: 7\nRun: 1\nFailed task: t\nError type: E\nConfidence: unknown\n\n"
        "Error:\nboom\n\nLikely root cause:\n" + "x" * 900 + "\n...[truncated]...\n\n"
        "Possible fixes:\n- a\n- b\n- c\n\nLinks:\nNo run link returned by RCA model.\n"
    )
    blocks = json.loads(row.blocks_json)
    assert [b["type"] for b in blocks] == ["header", "section", "section", "section", "context"]
    assert blocks[2]["text"]["text"] == "*Likely root cause:*\n" + "x" * 1000
    assert blocks[3]["text"]["text"] == "*Possible fixes:*\n- a\n- b\n- c"
    assert blocks[4]["elements"] == [{"text": "*Links:* No run link returned by RCA model.", "type": "mrkdwn"}]


def test_message_defaults(spark):
    row = notify.notifications(fields(spark, "{}")).first()
    assert "Error type: UNKNOWN\n" in row.text and "- Review RCA report table for details." in row.text


HELPER = ("helper", False, None, None, "ImportError: x")
ERR = "helper failed: ImportError: x"
DELIVERIES = [
    ([("helper", True, None, None, None)], ("sent_helper", "chan", "", "")),
    ([("helper", False, None, None, "not_in_channel")], ("failed_not_in_channel", "chan", "", "helper failed: not_in_channel")),
    ([("helper", False, None, None, "channel_not_found")], ("failed_channel_not_found", "chan", "", "helper failed: channel_not_found")),
    ([HELPER, ("api", True, 200, '{"ok":true,"channel":"C","ts":"1"}', None)], ("sent", "C", "1", "")),
    ([HELPER, ("api", None, 200, '{"ok":true}', None)], ("sent", "chan", "", "")),
    ([HELPER, ("api", None, 200, '{"ok":false,"error":"e"}', None), ("webhook", None, 200, "ok", None)],
     ("failed", "chan", "", ERR + "; fallback e")),
    ([HELPER, ("api", None, 503, "busy", None)], ("failed", "chan", "", ERR + "; fallback HTTPError 503: busy")),
    ([HELPER, ("api", None, None, None, "URLError: t")], ("failed", "chan", "", ERR + "; fallback URLError: t")),
    ([HELPER, ("webhook", None, 200, " OK\n", None)], ("sent_webhook", "chan", "", "")),
    ([HELPER, ("webhook", None, 200, "no", None)], ("failed", "chan", "", ERR + "; fallback Unexpected webhook response: no")),
    ([HELPER, ("webhook", None, 404, "x", None)], ("failed", "chan", "", ERR + "; fallback Webhook HTTPError 404: x")),
    ([HELPER, ("webhook", None, None, None, "URLError: t")], ("failed", "chan", "", ERR + "; fallback Webhook URLError: t")),
    ([("webhook", None, 200, "ok", None)], ("sent_webhook", "chan", "", "")),
    ([HELPER], ("skipped_missing_slack_config", "chan", "", ERR + "; no token; no webhook")),
]


@pytest.fixture(scope="module")
def delivered(spark):
    attempts = spark.createDataFrame(
        [(str(i), k, 1, ok, st, body, e) for i, (tries, _) in enumerate(DELIVERIES) for k, ok, st, body, e in tries],
        S.DELIVERY_ATTEMPTS,
    )
    cases = spark.createDataFrame([(str(i),) for i in range(len(DELIVERIES))], "event_id string")
    rows = notify.resolve_delivery(cases, attempts, "chan").collect()
    return {r.event_id: (r.slack_notification_status, r.slack_channel_id, r.slack_message_ts, r.slack_error) for r in rows}


@pytest.mark.parametrize("i", range(len(DELIVERIES)))
def test_delivery(delivered, i):
    assert delivered[str(i)] == DELIVERIES[i][1]


def test_last_attempt_counts_and_empty_channel_takes_the_default(spark):
    attempts = spark.createDataFrame(
        [("e", "helper", 1, True, None, None, None), ("e", "helper", 2, False, None, None, "late")], S.DELIVERY_ATTEMPTS
    )
    cases = spark.createDataFrame([("e", "")], "event_id string, channel string")
    row = notify.resolve_delivery(cases, attempts, "chan").first()
    assert row.slack_notification_status == "skipped_missing_slack_config" and row.slack_channel_id == "chan"


def test_latest_reports(spark):
    names = S.REPORTS.fieldNames()
    base = dict.fromkeys(names, "")
    items = [{"event_id": e, "source_job_id": j, "created_at": t} for e, j, t in
             [("a", "1", "2024-01-01T00:00:07+00:00"), ("b", "1", "2024-01-01T00:00:07.000001+00:00"), ("c", "2", "2023")]]
    frame = spark.createDataFrame([tuple({**base, **i}.values()) for i in items], S.REPORTS)
    assert reports.latest_report(frame).first().event_id == "b"
    assert reports.latest_report(frame).columns == reports.REPORT_VIEW
    assert {r.source_job_id: r.event_id for r in reports.latest_report_per_job(frame).collect()} == {"1": "b", "2": "c"}


def test_keys_that_repeat_inside_an_answer(spark):
    """Strict JSON takes them; neither the evidence nor the report may be lost."""
    answer = '{"title": "t", "evidence": [{"a": 1, "a": 2}], "possible_fixes": {"b": 1, "b": 2}, "prompt_metadata": {"c": 0}}'
    added = reports.attach(F.col("report_json"), F.struct(F.lit("n").alias("prompt_name")), F.struct(F.lit("s").alias("status")))
    row = fields(spark, answer).withColumn("whole", added).first()
    assert json.loads(row.evidence_json) == [{"a": 2}]
    assert json.loads(row.possible_fixes) == {"b": 2}
    whole = json.loads(row.whole)
    assert whole["evidence"] == [{"a": 2}]
    assert whole["prompt_metadata"] == {"prompt_name": "n"} and whole["slack_notification"] == {"status": "s"}
