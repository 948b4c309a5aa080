"""Model answers as structured reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import json_text as J
from faultlens.functions.text import first_text, iso_utc, strip
from faultlens.operators.joins import by_case

REPORT_VIEW = [
    "event_id",
    "source_run_id",
    "created_at",
    "error_type",
    "error_description",
    "likely_root_cause",
    "possible_fixes",
    "recommended_fix",
    "confidence",
    "slack_channel_id",
    "slack_notification_status",
    "slack_message_ts",
    "slack_error",
]


def response_content(choices: Column, predictions: Column, outputs: Column) -> Column:
    """Content of the first choice, else the first prediction, else the first output, else empty."""
    return (
        F.when(F.size(choices) > 0, F.coalesce(F.get(choices, 0)["message"]["content"], F.lit("")))
        .when(F.size(predictions) > 0, F.coalesce(F.get(predictions, 0), F.lit("None")))
        .when(F.size(outputs) > 0, F.coalesce(F.get(outputs, 0), F.lit("None")))
        .otherwise("")
    )


def _fixed_report(values: dict, **per_event: Column) -> Column:
    """JSON text of a report with some fields filled per event; fields in alphabetical order."""
    fields = dict(per_event)
    for name, value in values.items():
        if isinstance(value, list):
            fields[name] = F.array(*[F.lit(item) for item in value]).cast("array<string>")
        else:
            fields[name] = F.lit(value)
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def parse_report(answers: DataFrame, text: Column, job_name: Column, task_key: Column) -> DataFrame:
    """Add ``report_json`` (one JSON object) and ``report_source`` for a model answer.

    The whole answer counts when it is an object; an answer that is other JSON, or neither JSON
    nor contains an object between its first and last brace, becomes the fixed report.
    """
    read = (
        answers.withColumn("_text", strip(F.coalesce(text, F.lit(""))))
        .withColumn("_whole", J.strict_value(F.col("_text")))
        .withColumn("_span", F.when(F.col("_whole").isNull(), F.regexp_extract("_text", r"(?s)\{.*\}", 0)))
        .withColumn("_inner", J.strict_value(F.col("_span")))
    )
    whole_is_object = F.col("_whole").isNotNull() & (J.kind_of(F.col("_text")) == "object")
    fixed = _fixed_report(
        V.NON_JSON_REPORT,
        summary=F.substring("_text", 1, V.FALLBACK_SUMMARY_LIMIT),
        failed_job=job_name,
        failed_task=task_key,
    )
    return (
        read.withColumn(
            "report_json",
            F.when(whole_is_object, F.get("_whole", 0))
            .when(F.col("_inner").isNotNull(), F.get("_inner", 0))
            .otherwise(fixed),
        )
        .withColumn(
            "report_source",
            F.when(whole_is_object, "whole").when(F.col("_inner").isNotNull(), "inner").otherwise("fixed"),
        )
        .drop("_text", "_whole", "_span", "_inner")
    )


ANSWER = ["choices", "predictions", "outputs", "error"]


def _response_order(responses: DataFrame) -> Column:
    """By time where the feed tells it, then by text, so that it doesn't depend on the order of arrival."""
    moment = [F.col("answered_at")] if "answered_at" in responses.columns else []
    return F.struct(*moment, F.to_json(F.struct(*ANSWER)))


def first_responses(responses: DataFrame, key: str) -> DataFrame:
    """One response per key: the first; combines before the shuffle."""
    first = F.min_by(F.struct(*ANSWER), _response_order(responses)).alias("first")
    return responses.groupBy(key).agg(first).select(key, *[F.col(f"first.{name}").alias(name) for name in ANSWER])


def surplus_responses(responses: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, n, digest) of the responses beyond the first of each key; all of them where the key is among ``known``.

    The digest is that of the last one's error or content.
    """
    content = response_content(F.col("choices"), F.col("predictions"), F.col("outputs"))
    counted = responses.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.max_by(F.md5(F.coalesce("error", content)), _response_order(responses)).alias("digest"),
    )
    first = F.lit(1)
    if known is not None:
        counted = counted.join(known.select(key, F.lit(0).alias("_first")), key, "left")
        first = F.coalesce("_first", F.lit(1))
    return counted.withColumn("n", F.col("_n") - first).where("n > 0").select(key, "n", "digest")


def model_reports(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Report of every case; a missing or failed response gives the call-failed report.

    ``cases`` needs event_id, source_job_name and failed_task_key. Of several responses for a case the first counts.
    """
    known, key = by_case(cases, responses)
    return answer_reports(cases.join(first_responses(known, key).withColumn("answered", F.lit(True)), key, "left"))


def answer_reports(answers: DataFrame) -> DataFrame:
    """The same for cases that carry their response, and ``answered``, which is null where there is none."""
    content = response_content(F.col("choices"), F.col("predictions"), F.col("outputs"))
    parsed = parse_report(answers, content, F.col("source_job_name"), F.col("failed_task_key"))
    error = F.when(F.col("answered").isNull(), F.lit("LookupError: no model response recorded")).otherwise(
        F.col("error")
    )
    failed = F.col("answered").isNull() | F.col("error").isNotNull()
    call_failed = _fixed_report(
        V.CALL_FAILED_REPORT,
        failed_job=F.col("source_job_name"),
        failed_task=F.col("failed_task_key"),
        primary_error=error,
        error_description=error,
    )
    return (
        parsed.withColumn("report_json", F.when(failed, call_failed).otherwise(F.col("report_json")))
        .withColumn("report_source", F.when(failed, "call_failed").otherwise(F.col("report_source")))
        .drop(*ANSWER, "answered")
    )


_TEXTS = ["error_type", "error_description", "primary_error", "likely_root_cause", "recommended_fix", "confidence"]
_VALUES = ["possible_fixes", "owner_next_steps", "evidence", "missing_context", "databricks_links"]


def report_fields(reports: DataFrame) -> DataFrame:
    """Columns read from ``report_json``, in the forms the report row and the message need.

    ``*_shown`` keep what the model wrote, even when empty, and are null only for an absent field;
    the others are null when the value is empty.
    """
    def struct(kind: str) -> str:
        return f"struct<{', '.join(f'{name}: {kind}' for name in _TEXTS + _VALUES)}>"

    def as_json(name: str) -> Column:
        # A variant can't hold an object that repeats a key; its text can.
        raw = F.col(f"_raw.{name}")
        return F.coalesce(F.to_json(f"_r.{name}"), F.when(raw.rlike(r"^[\[{]"), raw))

    parsed = (
        reports.withColumn("_r", J.parse(F.col("report_json"), struct("variant")))
        .withColumn("_raw", J.parse(F.col("report_json"), struct("string")))
        .select(
            *reports.columns,
            *[as_json(name).alias(f"_j_{name}") for name in _TEXTS + _VALUES],
            *[F.coalesce(F.col(f"_r.{name}").cast("string"), as_json(name)).alias(f"_s_{name}") for name in _TEXTS],
        )
    )
    json = {name: F.col(f"_j_{name}") for name in _TEXTS + _VALUES}
    text = {name: F.col(f"_s_{name}") for name in _TEXTS}
    lists = parsed.withColumn("_fixes", F.coalesce(J.truthy(json["possible_fixes"]), json["recommended_fix"]))
    nothing = F.lit("[]")

    def shown(name: str) -> Column:
        return F.when(json[name] == "null", F.lit("None")).otherwise(text[name])

    return lists.select(
        *reports.columns,
        *[J.truthy(json[name], text[name]).alias(f"model_{name}") for name in _TEXTS],
        shown("error_type").alias("error_type_shown"),
        shown("confidence").alias("confidence_shown"),
        F.coalesce(J.truthy(json["possible_fixes"]), J.truthy(json["owner_next_steps"]), nothing).alias("possible_fixes"),
        F.coalesce(J.truthy(json["evidence"]), nothing).alias("evidence_json"),
        F.coalesce(J.truthy(json["missing_context"]), nothing).alias("missing_context"),
        J.json_lines(F.col("_fixes")).alias("fix_lines"),
        J.json_lines(json["databricks_links"]).alias("link_lines"),
    )


def attach(report_json: Column, prompt: Column, delivery: Column) -> Column:
    """Report with prompt metadata and delivery result added.

    They are appended to the object's text. A model that wrote one of these keys itself loses its
    value, which takes reading the object.
    """
    extra = {"prompt_metadata": F.to_json(prompt), "slack_notification": F.to_json(delivery)}
    clash = F.lit(False)
    for name in extra:
        clash = clash | F.contains(report_json, F.lit(f'"{name}"'))
    kept = F.map_filter(J.parse(report_json, "map<string, variant>"), lambda key, _: ~key.isin(*extra))
    # An object that can't be read as a map, because a key repeats inside it, keeps its text; the keys
    # appended last are the ones that count.
    base = F.when(clash, F.coalesce(F.to_json(kept), report_json)).otherwise(report_json)
    added = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), json) for name, json in extra.items()])
    comma = F.when(base == "{}", F.lit("")).otherwise(F.lit(","))
    return F.concat(F.substring(base, F.lit(1), F.char_length(base) - 1), comma, added, F.lit("}"))


def report_rows(reports: DataFrame) -> DataFrame:
    """Rows of the report table, from report fields, the rule-based class and the delivery result."""
    empty = F.lit("")
    metadata = F.struct("model_endpoint", "prompt_alias", "prompt_name", "prompt_version")
    delivery = F.struct(
        F.col("slack_channel_id").alias("channel_id"),
        F.col("slack_error").alias("error"),
        F.col("slack_message_ts").alias("message_ts"),
        F.col("slack_notification_status").alias("status"),
    )
    return reports.select(
        "event_id",
        "source_job_id",
        "source_run_id",
        "source_job_name",
        "failed_task_key",
        F.coalesce(F.col("task_run_id").cast("string"), empty).alias("failed_task_run_id"),
        F.coalesce(first_text(F.col("model_error_type")), F.col("error_type")).alias("error_type"),
        F.coalesce(
            first_text(F.col("model_error_description"), F.col("model_primary_error")), F.col("error_description")
        ).alias("error_description"),
        F.coalesce("model_likely_root_cause", empty).alias("likely_root_cause"),
        "possible_fixes",
        F.coalesce("model_recommended_fix", empty).alias("recommended_fix"),
        F.coalesce("model_confidence", empty).alias("confidence"),
        "evidence_json",
        "missing_context",
        attach(F.col("report_json"), metadata, delivery).alias("report_json"),
        iso_utc(F.col("event_ts")).alias("created_at"),
        "slack_channel_id",
        "slack_notification_status",
        "slack_message_ts",
        "slack_error",
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report, in the columns of the report view."""
    return reports.select(*REPORT_VIEW).orderBy(F.desc("created_at")).limit(1)


def latest_report_per_job(reports: DataFrame, *tie_break: str) -> DataFrame:
    """Newest report of every job; combines before the shuffle."""
    order = F.struct("created_at", *tie_break)
    return (
        reports.groupBy("source_job_id")
        .agg(F.max_by(F.struct(*REPORT_VIEW), order).alias("latest"))
        .select("source_job_id", "latest.*")
    )
