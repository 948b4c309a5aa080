"""Evidence about failed runs: one row per event and collector, and the ordered bundle.

Every collector joins its own document to a narrow row of keys, so a document crosses the network
once for its lookup and once, shortened, for the bundle; it is never carried through the other
lookups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions.json_text import string_values
from faultlens.functions.text import decode_utf8, iso_utc, table_refs, truncate
from faultlens.operators.failures import classify_error, describe_error
from faultlens.operators.joins import asked_for, spread_lookup, unique_lookup

KEYS = ["case_id", "event_id", "source_job_id", "source_run_id", "event_ts"]


def document_refs(document: Column) -> Column:
    """References in the strings of a JSON document, at any depth and under any key."""
    return table_refs(F.array_join(string_values(document), "\n"))


def _row(df: DataFrame, order: int, collector: str, document: Column, refs: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        *KEYS,
        F.lit(order).alias("ord"),
        F.lit("").alias("detail"),
        F.lit(collector).alias("collector_name"),
        document.alias("evidence_json"),
        (none if refs is None else refs).alias("refs"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(None).cast("string").alias("error_description"),
    )


def run_evidence(documents: DataFrame) -> DataFrame:
    """The whole run document; needs no lookup."""
    return _row(documents, 1, V.JOB_RUN, F.col("document"), document_refs(F.col("document")))


def settings_documents(settings: DataFrame) -> DataFrame:
    """Whole settings per job with their references and the texts of their tasks, found once per job."""
    built = F.to_json(F.when(F.col("settings").isNotNull(), F.struct("settings")))
    document = F.coalesce("document", built) if "document" in settings.columns else built
    tasks = F.from_json("document", "settings struct<tasks array<string>>")["settings"]["tasks"]
    return (
        settings.select("job_id", document.alias("document"))
        .withColumn("task_documents", tasks)
        .withColumn("task_keys", F.transform("task_documents", lambda task: F.get_json_object(task, "$.task_key")))
        .withColumn("settings_refs", document_refs(F.col("document")))
    )


def settings_evidence(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Job settings and the first entry for the blamed task; absent ones read as an empty object.

    ``documents`` comes from ``settings_documents``. A job may own a large share of the cases.
    """
    job = F.col("source_job_id").cast("bigint")
    found = spread_lookup(cases.select(*KEYS, "failed_task_key"), documents, job, "job_id", F.col("case_id"))
    position = F.array_position("task_keys", F.col("failed_task_key")).cast("int")
    task = F.when(position > 0, F.get("task_documents", position - 1))
    none = F.array().cast("array<string>")
    both = F.array(
        F.struct(
            F.lit(2).alias("ord"), F.lit(V.JOB_SETTINGS).alias("name"), F.col("document").alias("text"),
            F.coalesce("settings_refs", none).alias("refs"),
        ),
        F.struct(
            F.lit(3).alias("ord"), F.lit(V.FAILED_TASK_SETTINGS).alias("name"), task.alias("text"), none.alias("refs")
        ),
    )
    return found.select(*KEYS, F.explode(both).alias("of")).select(
        *KEYS,
        "of.ord",
        F.lit("").alias("detail"),
        F.col("of.name").alias("collector_name"),
        F.coalesce("of.text", F.lit("{}")).alias("evidence_json"),
        "of.refs",
        F.lit(None).cast("string").alias("error_type"),
        F.lit(None).cast("string").alias("error_description"),
    )


ERROR_FACTS = ["result_state", "state_message", "termination_code", "termination_message"]


def _asked_outputs(cases: DataFrame, outputs: DataFrame, *asked: Column) -> DataFrame:
    """Each case with the outputs that it asks for by run id; a null id asks for none and gets a warning.

    Texts are shortened before the join, which bounds what it moves.
    """
    wanted = cases.select(*KEYS, *ERROR_FACTS, F.explode(F.array(*asked)).alias("asked"))

    def part(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), truncate(F.col(name), V.RUN_OUTPUT_LIMIT)).alias(name)

    short = outputs.select(
        "run_id", part("error"), part("logs"), part("notebook_output"), "output_json", F.lit(True).alias("present")
    )
    found = unique_lookup(wanted, short, F.col("asked.id"), "run_id")
    asked_id = F.col("asked.id").cast("string")
    missing = F.concat(F.lit("LookupError: no output recorded for run "), asked_id)
    absent = F.col("present").isNull() & asked_id.isNotNull()
    document = F.struct(
        F.when(absent, missing).otherwise(F.col("error")).alias("error"),
        "logs",
        "notebook_output",
        "output_json",
        F.when(asked_id.isNull(), F.lit(V.NO_TASK_RUN_ID)).alias("warning"),
    )
    return found.withColumn("doc", document).withColumn("text", F.to_json("doc"))


def _asked(order: int, run_id: Column) -> Column:
    return F.struct(F.lit(order).alias("ord"), run_id.alias("id"))


def _error_class() -> Column:
    return classify_error(F.col("text"), F.col("termination_code"), F.col("result_state"))


def _error_text() -> Column:
    return describe_error(
        F.col("doc.error"), F.col("doc.notebook_output"), F.col("termination_message"),
        F.col("state_message"), F.col("text"),
    )


def outputs_between(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """The outputs whose run ids lie in the span that the runs and their tasks ask for.

    Run ids are given in order, so of an archive that is sorted by them a batch of new runs reads the end.
    """
    task_ids = F.transform("tasks", lambda task: task["run_id"])
    ids = F.concat(F.array("run_id"), F.coalesce(task_ids, F.array().cast("array<bigint>")))
    span = runs.select(F.array_min(ids).alias("low"), F.array_max(ids).alias("high"))
    # One row: the bounds.
    low, high = span.agg(F.min("low"), F.max("high")).first()
    return outputs.where(F.lit(False) if low is None else F.col("run_id").between(low, high))


def output_evidence(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of the root run and of the blamed task, found with one join.

    The row of the blamed task also carries the error class and description.
    """
    shown = _asked_outputs(
        cases, outputs, _asked(4, F.col("source_run_id").cast("bigint")), _asked(5, F.col("task_run_id"))
    )
    is_task = F.col("asked.ord") == 5
    refs = table_refs(F.concat_ws("\n", "doc.error", "doc.logs", "doc.notebook_output", "doc.output_json"))
    none = F.array().cast("array<string>")
    return shown.select(
        *KEYS,
        F.col("asked.ord").alias("ord"),
        F.lit("").alias("detail"),
        F.when(is_task, V.FAILED_TASK_OUTPUT).otherwise(V.ROOT_RUN_OUTPUT).alias("collector_name"),
        F.col("text").alias("evidence_json"),
        F.when(is_task, refs).otherwise(none).alias("refs"),
        F.when(is_task, _error_class()).alias("error_type"),
        F.when(is_task, _error_text()).alias("error_description"),
    )


def error_summaries(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Error class and description of every case, without the rest of the evidence."""
    shown = _asked_outputs(cases, outputs, _asked(5, F.col("task_run_id")))
    return shown.select(*KEYS, _error_class().alias("error_type"), _error_text().alias("error_description"))


def code_evidence(cases: DataFrame, source_code: DataFrame) -> DataFrame:
    """Source of the blamed task; one path may serve a large share of the cases.

    Shortening and the search for references happen once per path, before the lookup.
    """
    path = F.nullif(F.col("failure_code_path"), F.lit(""))
    text = truncate(_as_text(source_code), V.SOURCE_CODE_LIMIT).alias("source")
    shown = asked_for(source_code, "path", cases, path).select("path", text)
    source = shown.withColumn("source_refs", table_refs(F.concat_ws("\n", "path", "source")))
    found = spread_lookup(cases.select(*KEYS, "failure_code_path"), source, path, "path", F.col("case_id"))
    missing = F.concat(F.lit("LookupError: no source recorded for "), path)
    document = F.struct(
        F.when(path.isNotNull() & F.col("source").isNull(), missing).alias("error"),
        path.alias("path"),
        F.col("source"),
        F.when(path.isNull(), F.lit(V.NO_CODE_PATH)).alias("warning"),
    )
    refs = F.coalesce(F.col("source_refs"), table_refs(path))
    return _row(found, 6, V.FAILURE_CODE, F.to_json(document), refs)


def _as_text(source_code: DataFrame) -> Column:
    kind = dict(source_code.dtypes)["source"]
    return decode_utf8(F.col("source")) if kind == "binary" else F.col("source")


def event_refs(rows: DataFrame) -> DataFrame:
    """Sorted distinct references per event over the rows of its (at most six) collectors."""
    return rows.groupBy("case_id").agg(
        *[F.max(name).alias(name) for name in KEYS if name != "case_id"],
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
    )


def recent_history(history: DataFrame, limit: int = V.MAX_HISTORY_PER_TABLE) -> DataFrame:
    """Newest entries per table. The rank limit is applied before the shuffle as well."""
    newest = Window.partitionBy("table_name").orderBy(
        F.desc("version"), F.desc("ts"), F.desc("operation")
    )
    return (
        history.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    )


def _row_json(columns: list[str], **shown: Column) -> Column:
    """JSON of a snapshot row with every column but the table's name, in alphabetical order."""
    fields = {name: F.col(name) for name in columns if name != "table_name"} | shown
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def table_documents(
    columns: DataFrame, history: DataFrame, details: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """One document per table from three independent snapshots; absent parts are named.

    Snapshots may have any further columns, all are kept. Rows become JSON before a single
    aggregation merges the snapshots. Its groups are as large as a table is wide, plus at most five
    history entries and the detail row. ``wanted`` with a column ``ref`` names the only tables that a
    document is made for. History is ranked before it is cut to them: that way a table with
    a very long history is reduced where its rows are read.
    """
    newest = recent_history(history)
    if wanted is not None:
        columns, newest, details = (
            asked_for(part, "table_name", wanted, F.col("ref")) for part in (columns, newest, details)
        )
    # To the second, in UTC whatever the session's zone.
    moment = {"timestamp": F.replace(F.left(iso_utc(F.col("ts")), F.lit(19)), F.lit("T"), F.lit(" "))}
    of_column = F.struct("ordinal", _row_json([c for c in columns.columns if c != "ordinal"]).alias("text"))
    of_entry = F.struct("rank", _row_json([c for c in history.columns if c != "ts"], **moment).alias("text"))
    parts = [
        columns.select("table_name", of_column.alias("column")),
        newest.select("table_name", of_entry.alias("entry")),
        details.select("table_name", _row_json(details.columns).alias("detail")),
    ]
    merged = (
        reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
        .groupBy("table_name")
        .agg(
            F.sort_array(F.collect_list("column"))["text"].alias("columns"),
            F.sort_array(F.collect_list("entry"))["text"].alias("entries"),
            F.sort_array(F.collect_list("detail")).alias("details"),
        )
    )
    missing = F.array_compact(
        F.array(
            F.when(F.size("details") == 0, F.lit("detail")),
            F.when(F.size("entries") == 0, F.lit("recent_history")),
            F.when(F.size("columns") == 0, F.lit("schema")),
        )
    )

    def listed(name: str, items: str) -> Column:
        return F.concat(F.lit(f'"{name}":['), F.array_join(items, ","), F.lit("]"))

    named = F.to_json(F.struct(F.col("table_name").alias("table")))
    document = F.concat_ws(
        ",",
        listed("detail", "details"),
        F.when(F.size(missing) > 0, F.concat(F.lit('"missing_parts":'), F.to_json(missing))),
        listed("recent_history", "entries"),
        listed("schema", "columns"),
        F.substring(named, F.lit(2), F.char_length(named) - 2),
    )
    return merged.select("table_name", F.concat(F.lit("{"), document, F.lit("}")).alias("table_json"))


def top_refs() -> Column:
    return F.slice("refs", 1, V.MAX_TABLES_PER_EVENT)


def table_evidence(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """Table documents of the first ten references of an event; a table may be referenced by many."""
    asked = refs.select(*KEYS, F.explode(top_refs()).alias("ref"))
    found = spread_lookup(asked, tables, F.col("ref"), "table_name", F.col("case_id"))
    missing = F.to_json(
        F.struct(
            F.concat(F.lit("LookupError: no snapshot of table "), F.col("ref")).alias("error"),
            F.col("ref").alias("table"),
        )
    )
    return found.select(
        *KEYS,
        F.lit(7).alias("ord"),
        F.col("ref").alias("detail"),
        F.lit(V.DISCOVERED_TABLE_SCHEMA).alias("collector_name"),
        F.coalesce(F.col("table_json"), missing).alias("evidence_json"),
    )


def summary_evidence(rows: DataFrame) -> DataFrame:
    """The error class and description found with the blamed task's output."""
    return rows.where(F.col("collector_name") == V.FAILED_TASK_OUTPUT).select(
        *KEYS,
        F.lit(8).alias("ord"),
        F.lit("").alias("detail"),
        F.lit(V.ERROR_SUMMARY).alias("collector_name"),
        F.to_json(F.struct("error_description", "error_type")).alias("evidence_json"),
    )


def bundle(evidence: DataFrame) -> DataFrame:
    """Evidence of an event as one JSON list in collector order; 7 to 17 bounded excerpts each."""
    item = F.struct(
        "ord", "detail", "collector_name",
        truncate(F.col("evidence_json"), V.PROMPT_EXCERPT_LIMIT).alias("evidence_json_excerpt"),
    )
    return (
        evidence.groupBy("case_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "case_id",
            F.to_json(F.transform("items", lambda i: i.dropFields("ord", "detail"))).alias("evidence_bundle_json"),
        )
    )
