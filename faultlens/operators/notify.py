"""Notification texts and the outcome of their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions.text import bullets, first_text, lines, strip, truncate
from faultlens.operators.joins import by_case


def _job() -> Column:
    return first_text(F.col("source_job_name"), F.col("source_job_id"))


def _fixes() -> Column:
    return bullets(F.col("fix_lines"), V.MAX_FIXES, V.NO_FIXES_LINE)


def _links() -> Column:
    return lines(F.col("link_lines"), V.MAX_LINKS, V.NO_LINKS_LINE)


def _shown(column: str, absent: str) -> Column:
    return F.coalesce(F.col(column), F.lit(absent))


def message_text() -> Column:
    """Plain message over a row with report fields."""
    error = first_text(F.col("model_error_description"), F.col("model_primary_error"))

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    def heading(label: str) -> Column:
        return F.lit(f"\n{label}:")

    return F.concat_ws(
        "\n",
        F.lit(V.MESSAGE_HEADER),
        fact(V.LABEL_JOB, F.coalesce(_job(), F.lit(""))),
        fact(V.LABEL_RUN, F.col("source_run_id")),
        fact(V.LABEL_TASK, F.col("failed_task_key")),
        fact(V.LABEL_TYPE, _shown("error_type_shown", V.UNKNOWN)),
        fact(V.LABEL_CONFIDENCE, _shown("confidence_shown", "unknown")),
        heading(V.LABEL_ERROR),
        truncate(error, V.MESSAGE_ERROR_LIMIT),
        heading(V.LABEL_CAUSE),
        truncate(F.col("model_likely_root_cause"), V.MESSAGE_CAUSE_LIMIT),
        heading(V.LABEL_FIXES),
        _fixes(),
        heading(V.LABEL_LINKS),
        _links(),
        F.lit(""),
    )


def message_blocks() -> Column:
    """The same message as a JSON list of layout blocks."""

    def text(kind: str, value: Column) -> Column:
        return F.struct(value.alias("text"), F.lit(kind).alias("type"))

    no_text = F.lit(None).cast("struct<text string, type string>")
    no_elements = F.lit(None).cast("array<struct<text string, type string>>")

    def block(kind: str, body: Column = no_text, elements: Column = no_elements) -> Column:
        return F.struct(elements.alias("elements"), body.alias("text"), F.lit(kind).alias("type"))

    def code(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"*{label}:* `"), value, F.lit("`"))

    facts = F.concat_ws(
        "\n",
        code(V.LABEL_JOB, F.coalesce(_job(), F.lit(""))),
        code(V.LABEL_RUN, F.col("source_run_id")),
        code(V.LABEL_TASK, F.col("failed_task_key")),
        code(V.LABEL_TYPE, _shown("error_type_shown", V.UNKNOWN)),
        code(V.LABEL_CONFIDENCE, _shown("confidence_shown", "unknown")),
    )
    cause = truncate(F.col("model_likely_root_cause"), V.BLOCK_CAUSE_LIMIT)
    links = F.array(text("mrkdwn", F.concat(F.lit(f"*{V.LABEL_LINKS}:* "), _links())))
    return F.to_json(
        F.array(
            block("header", text("plain_text", F.lit(V.MESSAGE_HEADER))),
            block("section", text("mrkdwn", facts)),
            block("section", text("mrkdwn", F.concat(F.lit(f"*{V.LABEL_CAUSE}:*\n"), cause))),
            block("section", text("mrkdwn", F.concat(F.lit(f"*{V.LABEL_FIXES}:*\n"), _fixes()))),
            block("context", elements=links),
        )
    )


def notifications(reports: DataFrame, channel: str = V.DEFAULT_CHANNEL) -> DataFrame:
    """Outbox rows for a delivery service."""
    return reports.select(
        *[name for name in ("case_id", "event_id") if name in reports.columns],
        _channel(reports, channel).alias("channel"),
        message_text().alias("text"),
        message_blocks().alias("blocks_json"),
    )


def _channel(df: DataFrame, default: str) -> Column:
    return F.coalesce(first_text(F.col("channel")), F.lit(default)) if "channel" in df.columns else F.lit(default)


def latest_attempts(attempts: DataFrame, key: str = "event_id") -> DataFrame:
    """Last attempt of each kind, one row per event or case; combines before the shuffle."""
    attempt = F.struct("ok", "http_status", "body", "error")

    def last(kind: str) -> Column:
        order = F.when(F.col("kind") == kind, F.struct("attempt", "ok", "http_status", "body", "error"))
        return F.max_by(attempt, order).alias(kind)

    return attempts.groupBy(key).agg(last("helper"), last("api"), last("webhook"))


def resolve_delivery(cases: DataFrame, attempts: DataFrame, channel: str = V.DEFAULT_CHANNEL) -> DataFrame:
    """Delivery status of every case.

    The helper decides when it worked or named a channel problem; then an API attempt decides,
    whatever its outcome; only without one does the webhook.
    """
    tried, key = by_case(cases, attempts)
    known = cases.join(latest_attempts(tried, key), key, "left").withColumn(
        "_channel", _channel(cases, channel)
    )
    helper, api, hook = F.col("helper"), F.col("api"), F.col("webhook")
    helper_ok = F.coalesce(helper["ok"], F.lit(False))
    helper_error = F.concat(
        F.lit("helper failed: "), F.coalesce(helper["error"], F.lit("no attempt recorded"))
    )

    def http_failed(attempt: Column) -> Column:
        return ~F.coalesce(attempt["http_status"], F.lit(200)).between(200, 299)

    def http_text(attempt: Column, label: str) -> Column:
        body = truncate(attempt["body"], V.RESPONSE_BODY_LIMIT)
        return F.concat(F.lit(label), attempt["http_status"].cast("string"), F.lit(": "), body)

    api_ok = (
        api["error"].isNull() & ~http_failed(api)
        & F.coalesce(api["ok"], F.get_json_object(api["body"], "$.ok") == "true", F.lit(False))
    )
    api_error = (
        F.when(api["error"].isNotNull(), api["error"])
        .when(http_failed(api), http_text(api, "HTTPError "))
        .otherwise(F.coalesce(first_text(F.get_json_object(api["body"], "$.error")), api["body"], F.lit("")))
    )
    hook_ok = (
        hook["error"].isNull() & ~http_failed(hook)
        & (F.lower(strip(F.coalesce(hook["body"], F.lit("")))) == "ok")
    )
    hook_error = (
        F.when(hook["error"].isNotNull(), F.concat(F.lit("Webhook "), hook["error"]))
        .when(http_failed(hook), http_text(hook, "Webhook HTTPError "))
        .otherwise(
            F.concat(F.lit("Unexpected webhook response: "), truncate(hook["body"], V.RESPONSE_BODY_LIMIT))
        )
    )
    status = (
        F.when(helper_ok, V.STATUS_HELPER)
        .when(F.contains(helper_error, F.lit("not_in_channel")), V.STATUS_NOT_IN_CHANNEL)
        .when(F.contains(helper_error, F.lit("channel_not_found")), V.STATUS_CHANNEL_NOT_FOUND)
        .when(api.isNotNull(), F.when(api_ok, V.STATUS_SENT).otherwise(V.STATUS_FAILED))
        .when(hook.isNotNull(), F.when(hook_ok, V.STATUS_WEBHOOK).otherwise(V.STATUS_FAILED))
        .otherwise(V.STATUS_SKIPPED)
    )
    decided = F.col("slack_notification_status")
    channel_failed = decided.isin(V.STATUS_NOT_IN_CHANNEL, V.STATUS_CHANNEL_NOT_FOUND)
    fallback = F.when(api.isNotNull(), api_error).otherwise(hook_error)
    error = (
        F.when(decided.isin(V.STATUS_HELPER, V.STATUS_SENT, V.STATUS_WEBHOOK), F.lit(""))
        .when(channel_failed, helper_error)
        .when(decided == V.STATUS_FAILED, F.concat(helper_error, F.lit("; fallback "), fallback))
        .otherwise(F.concat(helper_error, F.lit("; no token; no webhook")))
    )

    def from_body(path: str) -> Column:
        return F.when(decided == V.STATUS_SENT, first_text(F.get_json_object(api["body"], path)))

    resolved = known.withColumn("slack_notification_status", status)
    return resolved.select(
        *cases.columns,
        F.coalesce(from_body("$.channel"), F.col("_channel")).alias("slack_channel_id"),
        "slack_notification_status",
        F.coalesce(from_body("$.ts"), F.lit("")).alias("slack_message_ts"),
        error.alias("slack_error"),
    )
