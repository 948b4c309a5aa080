"""Schemas of the input and output tables.

Struct fields of documents are in alphabetical order, so ``to_json`` writes sorted keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_MAP = T.MapType(_S, _S)


def _row(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STATE = _row(("result_state", _S), ("state_message", _S))
TERMINATION = _row(("code", _S), ("message", _S), ("type", _S))
STATUS = _row(("termination_details", TERMINATION))

TASK = _row(
    ("notebook_task", _MAP),
    ("python_wheel_task", _MAP),
    ("run_id", T.LongType()),
    ("spark_python_task", _MAP),
    ("state", STATE),
    ("status", STATUS),
    ("task_key", _S),
)

TASK_SETTINGS = _row(
    ("notebook_task", _MAP),
    ("python_wheel_task", _MAP),
    ("spark_python_task", _MAP),
    ("task_key", _S),
)

RUN_DETAILS = _row(
    ("job_id", T.LongType()),
    ("run_id", T.LongType()),
    ("run_name", _S),
    ("tasks", T.ArrayType(TASK)),
)

SETTINGS = _row(("name", _S), ("tasks", T.ArrayType(TASK_SETTINGS)))

# Inputs -------------------------------------------------------------------------------------

RUNS = _row(
    ("run_id", T.LongType()),
    ("job_id", T.LongType()),
    ("run_name", _S),
    ("event_ts", T.TimestampType()),
    ("tasks", T.ArrayType(TASK)),
)

# One row per task, for feeds that deliver tasks instead of run documents.
RUN_TASKS = _row(
    ("parent_run_id", T.LongType()),
    ("pos", T.LongType()),
    ("task", TASK),
)

JOB_SETTINGS = _row(("job_id", T.LongType()), ("settings", SETTINGS))

RUN_OUTPUTS = _row(
    ("run_id", T.LongType()),
    ("error", _S),
    ("logs", _S),
    ("notebook_output", _S),
    ("output_json", _S),
)

SOURCE_CODE = _row(("path", _S), ("source", _S))

TABLE_COLUMNS = _row(
    ("table_name", _S),
    ("ordinal", T.IntegerType()),
    ("col_name", _S),
    ("data_type", _S),
    ("comment", _S),
)

TABLE_HISTORY = _row(
    ("table_name", _S),
    ("version", T.LongType()),
    ("ts", T.TimestampType()),
    ("operation", _S),
)

TABLE_DETAILS = _row(
    ("table_name", _S),
    ("format", _S),
    ("num_files", T.LongType()),
)

TABLE_PROBE = _row(("table_name", _S), ("ok", T.BooleanType()), ("error_text", _S))

# Failure families: the smaller priority comes first.
FAILURE_RULES = _row(("priority", T.IntegerType()), ("family", _S), ("pattern", _S))

MODEL_RESPONSES = _row(
    ("event_id", _S),
    ("choices", T.ArrayType(_row(("message", _row(("content", _S)))))),
    ("predictions", T.ArrayType(_S)),
    ("outputs", T.ArrayType(_S)),
    ("error", _S),
)

# A response feed may also carry ``case_id``, which is more exact than the event id, and
# ``answered_at``, by which the first of several responses is known.

DELIVERY_ATTEMPTS = _row(
    ("event_id", _S),
    ("kind", _S),
    ("attempt", T.IntegerType()),
    ("ok", T.BooleanType()),
    ("http_status", T.IntegerType()),
    ("body", _S),
    ("error", _S),
)

# Outputs: every column is text ---------------------------------------------------------------

EVENTS = _row(
    *[
        (name, _S)
        for name in (
            "event_id",
            "source_job_id",
            "source_run_id",
            "source_job_name",
            "failed_task_key",
            "trigger_source",
            "payload_json",
            "created_at",
        )
    ]
)

EVIDENCE = _row(
    *[
        (name, _S)
        for name in (
            "event_id",
            "source_job_id",
            "source_run_id",
            "collector_name",
            "evidence_json",
            "created_at",
        )
    ]
)

REPORTS = _row(
    *[
        (name, _S)
        for name in (
            "event_id",
            "source_job_id",
            "source_run_id",
            "source_job_name",
            "failed_task_key",
            "failed_task_run_id",
            "error_type",
            "error_description",
            "likely_root_cause",
            "possible_fixes",
            "recommended_fix",
            "confidence",
            "evidence_json",
            "missing_context",
            "report_json",
            "created_at",
            "slack_channel_id",
            "slack_notification_status",
            "slack_message_ts",
            "slack_error",
        )
    ]
)

PROMPTS = _row(
    *[
        (name, _S)
        for name in (
            "prompt_name",
            "prompt_alias",
            "prompt_version",
            "is_active",
            "model_endpoint",
            "temperature",
            "max_tokens",
            "system_prompt",
            "user_prompt_template",
            "notes",
            "created_at",
            "updated_at",
        )
    ]
)

# Handed to other services, or kept for tracing --------------------------------------------------

PROMPT_REQUESTS = _row(
    ("case_id", _S),
    ("event_id", _S),
    ("prompt_name", _S),
    ("prompt_alias", _S),
    ("prompt_version", _S),
    ("model_endpoint", _S),
    ("temperature", T.DoubleType()),
    ("max_tokens", T.LongType()),
    ("system_prompt", _S),
    ("user_prompt", _S),
)

NOTIFICATIONS = _row(*[(name, _S) for name in ("case_id", "event_id", "channel", "text", "blocks_json")])

REJECTS = _row(*[(name, _S) for name in ("source_job_id", "source_run_id", "event_id", "reason", "digest")])

# What an analysis writes for each batch, and the prompts, which are kept across batches.
BATCH_TABLES = {
    "events": EVENTS,
    "evidence": EVIDENCE,
    "reports": REPORTS,
    "prompt_requests": PROMPT_REQUESTS,
    "notifications": NOTIFICATIONS,
    "rejects": REJECTS,
}
OUTPUT_TABLES = {"events": EVENTS, "evidence": EVIDENCE, "reports": REPORTS, "prompts": PROMPTS}

COMMITTED_BATCHES = _row(("table_name", _S), ("n_rows", T.LongType()))
