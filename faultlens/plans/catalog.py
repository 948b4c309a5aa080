"""The queries registered for the driver, each over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import schemas, session
from faultlens.functions import json_text as J
from faultlens.functions import text as T
from faultlens.operators import evidence as E
from faultlens.operators import failures, health, notify, prompts, reports
from faultlens.operators.joins import spread_lookup
from faultlens.plans import analysis
from faultlens.sinks import batches
from faultlens.sinks import tables as sink
from faultlens.sources import readers, samples
from faultlens.sources.readers import (
    outputs_from_documents,
    runs_from_documents,
    settings_from_documents,
    split_documents,
)
from faultlens.streaming import answers, failed_runs

AS_OF = "2001-08-01"
DATA_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.tune(spark)
        loaded: dict[str, DataFrame] = {}

        def table(name: str) -> DataFrame:
            if name not in loaded:
                loaded[name] = samples.load(spark, folder, name)
            return loaded[name]

        return function(table)

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


# Failed runs and tasks -------------------------------------------------------------------------


@query
def qualifying_runs(table) -> DataFrame:
    ids = failures.qualifying_run_ids(samples.line_tasks(table("lineitem")))
    return (
        samples.order_runs(table("orders"))
        .join(ids, F.col("run_id") == F.col("parent_run_id"))
        .select("run_id", "job_id", "run_name", "failed_tasks")
    )


def _order_heads(table) -> DataFrame:
    blamed = failures.blamed_tasks(samples.line_tasks(table("lineitem")))
    runs = samples.order_runs(table("orders"))
    with_task = runs.join(blamed, F.col("run_id") == F.col("parent_run_id"), "left").drop("parent_run_id")
    return failures.with_event_id(
        with_task.withColumn("is_fallback", F.coalesce("is_fallback", F.lit(True)))
    )


@query
def first_failed_task(table) -> DataFrame:
    return _order_heads(table).select(
        "run_id", "job_id", "event_id", "failed_task_key", "is_fallback",
        F.coalesce(F.col("task.run_id").cast("string"), F.lit("")).alias("failed_task_run_id"),
        F.col("task.state.result_state").alias("result_state"),
    )


@query
def task_settings_lookup(table) -> DataFrame:
    cases = failures.identify(_order_heads(table), samples.customer_settings(table("customer")))
    return cases.select(
        "event_id", "source_job_id", "source_run_id", "source_job_name", "failed_task_key", "failure_code_path",
        F.col("task_settings").isNotNull().alias("has_task_settings"),
    )


def _event_cases(table) -> DataFrame:
    runs = failures.qualifying_runs(samples.event_runs(table("events")))
    return failures.identify(failures.heads(runs), samples.customer_settings(table("customer")))


def _error_summaries(table) -> DataFrame:
    runs = failures.qualifying_runs(samples.event_runs(table("events")))
    return E.error_summaries(failures.bare_cases(failures.heads(runs)), samples.event_outputs(table("events")))


@query
def classify_errors(table) -> DataFrame:
    return _error_summaries(table).select("event_id", "source_run_id", "error_type")


@query
def error_descriptions(table) -> DataFrame:
    return _error_summaries(table).select("event_id", "error_description")


@query
def archived_outputs(table) -> DataFrame:
    """Errors of the failed runs, found in an archive of all outputs that is kept bucketed by run."""
    events = table("events")
    spark, archive = events.sparkSession, f"outputs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for half in (0, 1):
        sink.append_archive(samples.event_outputs(events.where(F.col("event_id") % 2 == half)), archive, "run_id", buckets)
    runs = failures.qualifying_runs(samples.event_runs(events))
    outputs = E.outputs_between(spark.table(archive), runs)
    found = E.error_summaries(failures.bare_cases(failures.heads(runs)), outputs)
    out = session.stage(found.select("event_id", "source_run_id", "error_type", "error_description"), "archived")
    sink.drop_table(spark, archive)
    return out


# Text ------------------------------------------------------------------------------------------


@query
def truncate_text(table) -> DataFrame:
    text = F.col("text")
    return table("documents").select(
        "doc_id",
        T.truncate(text, V.ERROR_DESCRIPTION_LIMIT).alias("description"),
        T.truncate(text, V.RUN_OUTPUT_LIMIT).alias("output"),
    )


@query
def discover_table_refs(table) -> DataFrame:
    return table("pages").select("page_id", F.array_join(T.table_refs(F.col("html")), ",").alias("refs"))


@query
def table_refs_in_documents(table) -> DataFrame:
    refs = table("documents").select(F.explode(T.table_refs(F.col("text"))).alias("ref"))
    return refs.groupBy("ref").agg(F.count("*").alias("documents"))


@query
def text_scalars(table) -> DataFrame:
    text = F.col("text")
    dates = table("conversations").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))
    )
    return dates.select(
        "conv_id",
        "turn",
        T.strip(F.concat(F.lit(" \n\t"), text, F.lit(" \r\n"))).alias("stripped"),
        F.lower("role").alias("role_lower"),
        F.regexp_extract(F.concat(F.lit("a {"), text, F.lit("} b")), r"(?s)\{.*\}", 0).alias("braces"),
        F.substring(text, 1, V.FALLBACK_SUMMARY_LIMIT).alias("prefix"),
        T.iso_utc(F.timestamp_micros(F.lit(1700000000000000) + F.col("turn") * 250000)).alias("iso"),
        F.date_sub("day", 1).cast("string").alias("day_before"),
        T.list_of_path(F.when(F.col("turn") == 0, "").otherwise(F.col("role"))).alias("paths"),
        T.first_text(F.lit(""), F.nullif("role", F.lit("user")), F.lit("nobody")).alias("speaker"),
    )


def _answers(table) -> DataFrame:
    said = table("conversations").where(F.col("role") == "assistant")
    return samples.with_answer(said, (F.col("conv_id") + F.col("turn")) % 8, F.col("text"))


@query
def strict_json_kinds(table) -> DataFrame:
    return _answers(table).select("conv_id", "turn", J.strict_kind(F.col("answer")).alias("kind"))


@query
def as_lines(table) -> DataFrame:
    lines = J.text_lines(F.col("lines"))
    listed = F.to_json(F.array(F.lit("first"), F.col("text"), F.lit("third"), F.lit("fourth")))
    kinds = F.when(F.col("turn") % 3 == 0, listed).when(F.col("turn") % 3 == 1, F.col("text")).otherwise("")
    return (
        table("conversations")
        .withColumn("lines", kinds)
        .select(
            "conv_id", "turn",
            F.size(lines).alias("n_lines"),
            T.bullets(lines, V.MAX_FIXES, V.NO_FIXES_LINE).alias("fixes"),
            T.lines(lines, V.MAX_LINKS, V.NO_LINKS_LINE).alias("links"),
        )
    )


# Evidence and prompts --------------------------------------------------------------------------


def _inputs(table) -> analysis.Inputs:
    return analysis.Inputs(
        runs=samples.event_runs(table("events")),
        settings=samples.customer_settings(table("customer")),
        outputs=samples.event_outputs(table("events")),
        source_code=samples.page_and_document_sources(table("pages"), table("documents")),
        table_columns=samples.snapshot_columns(table("pages"), table("customer")),
        table_history=samples.snapshot_history(table("pages"), table("orders")),
        table_details=samples.snapshot_details(table("customer")),
        prompts=_seeded(samples.part_prompts(table("part"))),
    )


def _seeded(known: DataFrame) -> DataFrame:
    """Known prompts and the default one, when they lack it."""
    default = prompts.default_prompt(known.sparkSession)
    return known.drop("part_key").unionByName(prompts.missing_prompts(default, known))


def _collected(table, which: Column | None = None) -> analysis.Collected:
    """The first phase over the events, or over those that a condition picks."""
    given = _inputs(table)
    if which is not None:
        given = replace(given, runs=samples.event_runs(table("events").where(which)))
    return analysis.collect(given)


@query
def event_rows(table) -> DataFrame:
    return analysis.event_rows(_event_cases(table))


@query
def refs_per_event_top10(table) -> DataFrame:
    refs = _collected(table).refs
    return refs.select(
        "event_id",
        F.size("refs").alias("n_refs"),
        F.array_join(F.slice("refs", 1, V.MAX_TABLES_PER_EVENT), ",").alias("top_refs"),
    )


@query
def recent_history_top5(table) -> DataFrame:
    entries = E.recent_history(samples.line_history(table("lineitem")))
    return entries.select(
        "table_name", "rank", "version", "operation", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )


@query
def ref_schema_join(table) -> DataFrame:
    tables = E.table_documents(
        samples.snapshot_columns(table("pages"), table("customer")),
        samples.snapshot_history(table("pages"), table("orders")),
        samples.snapshot_details(table("customer")),
    )
    refs = samples.page_refs(table("pages"))
    return spread_lookup(refs, tables, F.col("table_name"), "table_name", F.col("page_id"))


@query
def evidence_rows(table) -> DataFrame:
    return _collected(table).evidence.select("event_id", "collector_name", "detail", "evidence_json")


@query
def evidence_bundle_order(table) -> DataFrame:
    evidence = _collected(table).evidence
    ids = evidence.where(F.col("collector_name") == V.JOB_RUN).select("case_id", "event_id")
    bundles = E.bundle(evidence).join(ids, "case_id")
    names = F.get_json_object("evidence_bundle_json", "$[*].collector_name")
    return bundles.select(
        "event_id",
        F.array_join(F.from_json(names, "array<string>"), ",").alias("collectors"),
        F.char_length("evidence_bundle_json").alias("bundle_chars"),
    )


@query
def active_prompt(table) -> DataFrame:
    chosen = prompts.active_prompts(samples.part_prompts(table("part")), tie_break="part_key")
    return chosen.select("prompt_name", "prompt_alias", "prompt_version", "updated_at", "notes")


@query
def active_prompt_numeric(table) -> DataFrame:
    chosen = prompts.active_prompts(samples.part_prompts(table("part")), numeric_version=True, tie_break="part_key")
    return chosen.select("prompt_name", "prompt_alias", "prompt_version", "updated_at", "notes")


@query
def prompt_seed_missing(table) -> DataFrame:
    part = samples.part_prompts(table("part"))
    wanted = part.select("prompt_name", "prompt_alias").distinct().withColumn("prompt_version", F.lit("2"))
    return prompts.missing_prompts(wanted, part, least_version=48)


@query
def prompt_numeric_defaults(table) -> DataFrame:
    settings = prompts.model_settings(samples.part_prompts(table("part")))
    return settings.select("part_key", "temperature", "max_tokens", "settings_error")


@query
def required_key_split(table) -> DataFrame:
    keyed = table("orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("source_job_id"),
        F.nullif("o_orderstatus", F.lit("P")).alias("source_run_id"),
    )
    complete, rejected = failures.require_keys(keyed, "source_job_id", "source_run_id")
    return complete.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query
def render_prompt(table) -> DataFrame:
    return _collected(table).requests.drop("case_id")


# Reports and notifications ---------------------------------------------------------------------


@query
def response_content(table) -> DataFrame:
    responses = reports.first_responses(samples.responses_for(_event_cases(table)), "event_id")
    return responses.select(
        "event_id",
        reports.response_content(F.col("choices"), F.col("predictions"), F.col("outputs")).alias("content"),
    )


def _conversation_reports(table) -> DataFrame:
    """Reports parsed from assistant turns, each standing for one event."""
    answers = _answers(table).select(
        "conv_id", "turn", "answer",
        samples.join_text(F.col("conv_id"), ":", F.col("turn")).alias("event_id"),
        samples.text(F.col("conv_id")).alias("source_job_id"),
        samples.text(F.col("turn")).alias("source_run_id"),
        F.when(F.col("turn") % 2 == 0, samples.join_text("talk ", F.col("conv_id"))).otherwise("").alias("source_job_name"),
        samples.join_text("task_", F.col("turn")).alias("failed_task_key"),
    )
    parsed = reports.parse_report(answers, F.col("answer"), F.col("source_job_name"), F.col("failed_task_key"))
    return reports.report_fields(parsed)


@query
def parse_report(table) -> DataFrame:
    return _conversation_reports(table).select("event_id", "report_source", "report_json")


@query
def report_rows(table) -> DataFrame:
    rows = _conversation_reports(table).select(
        "*",
        F.lit(None).cast("bigint").alias("task_run_id"),
        F.lit("RULE").alias("error_type"),
        F.lit("by rule").alias("error_description"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("turn")).alias("event_ts"),
        *[F.lit(name).alias(name) for name in ("prompt_name", "prompt_alias", "prompt_version", "model_endpoint")],
    )
    resolved = notify.resolve_delivery(rows, samples.attempts_for(rows, F.col("conv_id") + F.col("turn")))
    return reports.report_rows(resolved)


@query
def notification_text(table) -> DataFrame:
    return notify.notifications(_conversation_reports(table)).select("event_id", "channel", "text")


@query
def notification_blocks(table) -> DataFrame:
    return notify.notifications(_conversation_reports(table)).select("event_id", "blocks_json")


@query
def delivery_status(table) -> DataFrame:
    events = table("events").select(samples.text(F.col("event_id")).alias("event_id"), "user_id")
    attempts = samples.attempts_for(events, F.col("event_id").cast("bigint"))
    return notify.resolve_delivery(events.drop("user_id"), attempts)


@query
def latest_report(table) -> DataFrame:
    return reports.latest_report(samples.order_reports(table("orders")))


@query
def latest_report_per_job(table) -> DataFrame:
    return reports.latest_report_per_job(samples.order_reports(table("orders")))


def _analysed(table, which: Column | None = None) -> tuple[analysis.Collected, analysis.Reported]:
    collected = _collected(table, which)
    responses = samples.responses_for(collected.asked)
    attempts = samples.attempts_for(collected.asked, F.col("source_run_id").cast("bigint") / 10)
    return collected, analysis.report(collected.asked, responses, attempts)


@query
def analysis_reports(table) -> DataFrame:
    """Whole analysis of the failed runs among the events: the report table."""
    return _analysed(table)[1].reports


def _content(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Number of rows and a sum over the digests of all their columns, which no order of rows changes."""
    whole = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    number = F.conv(F.left(F.md5(whole), F.lit(8)), 16, 10).cast("bigint")
    return rows.agg(
        F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).alias("content")
    )


@query
def sink_round_trip(table) -> DataFrame:
    """All tables after batches that were repeated, broken off, retried and replaced: their content, read back.

    The even events are one batch, which breaks off after two tables before it is written in full; the odd ones are
    written, written again and replaced. Prompts are appended by name, seeded twice; a table is replaced twice, one dropped.
    """
    spark = table("events").sparkSession
    database = f"triage_{uuid.uuid4().hex}"
    frames = []
    for rest in (0, 1):
        collected, reported = _analysed(table, F.col("event_id") % 2 == rest)
        # The rows are written two or three times below, but gathered once.
        rows = analysis.output_frames(collected, reported)
        frames.append({name: session.stage(frame, f"batch-{name}") for name, frame in rows.items()})
    batches.ensure_batch_tables(spark, database)
    batches.begin_batch({name: frames[0][name] for name in ("events", "evidence")}, database, "even")
    nothing_yet = batches.committed(spark, database, "events").count()
    batches.write_batch(frames[0], database, "even")
    for replace_it in (False, False, True):
        batches.write_batch(frames[1], database, "odd", replace=replace_it)

    sink.ensure_tables(spark, database)
    sink.append_table(samples.part_prompts(table("part")).drop("part_key"), f"{database}.prompts")
    for _ in range(2):
        sink.seed_default_prompt(spark, f"{database}.prompts")
    regions = table("region").select(F.col("r_name").alias("region"))
    for name in ("snapshot", "dropped"):
        sink.replace_table(regions, f"{database}.{name}")
    sink.replace_table(regions.where("region <> 'ASIA'"), f"{database}.snapshot")
    sink.drop_table(spark, f"{database}.dropped")

    def told(name: str, rows: DataFrame, columns: list[str]) -> DataFrame:
        return _content(rows, name, [c for c in columns if c != "case_id"])

    found = [
        told(name, batches.committed(spark, database, name), schema.fieldNames())
        for name, schema in schemas.BATCH_TABLES.items()
    ]
    found.append(told("prompts", spark.table(f"{database}.prompts"), list(prompts.DEFAULT_PROMPT)))
    found.append(told("snapshot", spark.table(f"{database}.snapshot"), ["region"]))
    left = spark.sql(f"SHOW TABLES IN {database}").where("tableName = 'dropped'")
    found.append(told("dropped", left, ["tableName"]))
    before = spark.range(nothing_yet).select(F.col("id").cast("string").alias("id"))
    found.append(told("events before the commit", before, ["id"]))
    out = session.stage(reduce(DataFrame.unionByName, found), "content")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


# Health ----------------------------------------------------------------------------------------


@query
def feed_freshness(table) -> DataFrame:
    feed = samples.vendor_feed(table("orders"), table("customer"))
    expected = table("nation").select(F.col("n_nationkey").alias("vendor_id"))
    status = health.feed_status(expected, feed, "vendor_id", "feed_date", F.lit(AS_OF).cast("date"))
    return status.withColumn("newest_day", F.col("newest_day").cast("string"))


@query
def rows_on_day(table) -> DataFrame:
    feed = table("orders").select(F.to_date("o_orderdate").alias("feed_date"))
    return health.rows_on_day(feed, "feed_date", F.lit(AS_OF).cast("date"))


@query
def recency_filter(table) -> DataFrame:
    orders = table("orders").withColumn("order_date", F.to_date("o_orderdate"))
    return orders.where(health.recent(F.col("order_date"), F.lit(AS_OF).cast("date"))).select(
        F.col("o_custkey").alias("merchant_id"),
        F.col("order_date").cast("string").alias("order_date"),
        F.col("o_totalprice").alias("gross_sales"),
    )


@query
def amount_cents(table) -> DataFrame:
    return table("orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        health.cents(F.col("o_totalprice")).alias("amount_cents"),
        F.to_date("o_orderdate").cast("string").alias("transaction_date"),
    )


@query
def schema_drift(table) -> DataFrame:
    """Expected columns follow an older layout of the sales tables than the snapshot."""
    customer = table("customer")
    expected = customer.select(
        samples.join_text("lake.sales.t", F.col("c_custkey")).alias("table_name"),
        F.explode(F.array(F.lit("c1"), F.lit("c2"), F.lit("amount"))).alias("col_name"),
    ).withColumn("data_type", F.lit("string"))
    return health.schema_drift(expected, samples.snapshot_columns(table("pages"), customer))


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """Details of the tables of the data folder, from their files; sizes and times only as far as they are known to be."""
    session.tune(spark)
    found = readers.table_files(spark, {f"lake.data.{name}": f"{folder}/{name}.parquet" for name in DATA_TABLES})
    return found.select(
        "table_name", "format", "num_rows",
        ((F.col("num_files") > 0) & (F.col("size_in_bytes") > F.col("num_files"))).alias("has_files"),
        F.col("last_modified").rlike(r"^\d{4}-\d\d-\d\dT.*\+00:00$").alias("has_time"),
    )


QUERIES["table_files"] = table_files


@query
def missing_tables(table) -> DataFrame:
    refs = samples.page_refs(table("pages"))
    return health.missing_tables(refs, samples.snapshot_columns(table("pages"), table("customer")))


def _output_texts(table) -> DataFrame:
    outputs = samples.event_outputs(table("events"))
    return outputs.where(F.col("error").isNotNull())


@query
def failure_pattern_tags(table) -> DataFrame:
    """Families by a rule table: the shipped one, with rules of the users' own that name regions and a new family."""
    errors = _output_texts(table)
    own = table("region").select(
        (5 + F.col("r_regionkey")).cast("int").alias("priority"),
        F.when(F.col("r_regionkey") == 0, "vendor").otherwise("data_quality").alias("family"),
        F.when(F.col("r_regionkey") == 0, "vendor_lib|/mnt/vendor").otherwise(F.concat(F.col("r_name"), F.lit(" feed"))).alias("pattern"),
    )
    rules = health.read_rules(health.shipped_rules(errors.sparkSession).unionByName(own))
    tagged = errors.select("run_id", health.failure_families(F.col("error"), rules).alias("found"))
    return tagged.select(
        "run_id",
        health.failure_family(F.col("found")).alias("family"),
        F.array_join("found", ",").alias("families"),
    )


@query
def access_check(table) -> DataFrame:
    probes = _output_texts(table).select(
        samples.join_text("lake.sales.t", F.col("run_id")).alias("table_name"),
        (F.col("error") == "").alias("ok"),
        F.col("error").alias("error_text"),
    )
    return health.access_failures(probes)


# Streaming -------------------------------------------------------------------------------------


def stream_failed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Failed runs found by a stream over the event file; equals the batch result."""
    session.tune(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = session.fresh_folder(spark, "stream")
    failed_runs.keep_state_on_disk(spark)
    found = failed_runs.distinct_heads(samples.event_runs(events), "1 day")
    write = failed_runs.batch_writer(
        f"{out}/batches", lambda batch: batch.select("event_id", "run_id", "job_id", "failed_task_key", "is_fallback")
    )
    failed_runs.on_batches(found, write, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/batches").drop("batch_id")


QUERIES["stream_failed_runs"] = stream_failed_runs


def _streamed_runs(spark: SparkSession, folder: str, out: str, database: str) -> None:
    """The first phase run by a stream over the event file."""
    stored = partial(samples.load, spark, folder)
    events = spark.readStream.schema(stored("events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    write = failed_runs.analysis_writer(_inputs(stored), database, f"{out}/asked")
    failed_runs.on_failures(samples.event_runs(events), write, f"{out}/runs-checkpoint").awaitTermination()


def stream_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """The first phase run by a stream over the event file; the written tables are read back.

    Every failed run once: its event row, the number and digest of its evidence rows, and its request.
    """
    session.tune(spark)
    out, database = session.fresh_folder(spark, "stream"), f"streamed_{uuid.uuid4().hex}"
    _streamed_runs(spark, folder, out, database)
    found, evidence, requests = (
        batches.committed(spark, database, name).drop("batch_id") for name in ("events", "evidence", "prompt_requests")
    )
    gathered = evidence.groupBy("event_id").agg(
        F.count("*").alias("n_evidence"), F.sum(F.char_length("evidence_json")).alias("evidence_chars")
    )
    asked = requests.select("event_id", F.md5("user_prompt").alias("prompt_md5"))
    whole = session.stage(found.join(gathered, "event_id", "left").join(asked, "event_id", "left"), "streamed")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return whole


QUERIES["stream_analysis"] = stream_analysis


def stream_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Both phases as streams: events, requests, the answers to them, and the report table they end in.

    Answers come within an hour or not at all; a tick in both feeds lets the time of the last requests run out.
    """
    session.tune(spark)
    failed_runs.keep_state_on_disk(spark)
    out, database = session.fresh_folder(spark, "stream"), f"streamed_{uuid.uuid4().hex}"
    _streamed_runs(spark, folder, out, database)
    asked = spark.read.parquet(f"{out}/asked").drop("batch")
    samples.responses_for(asked).write.parquet(f"{out}/responses")
    responses = spark.read.parquet(f"{out}/responses")
    # One row: the time of the last request, two hours on.
    over = asked.agg((F.max("asked_at") + F.make_dt_interval(hours=F.lit(2))).alias("over")).first()["over"]
    answers.tick(asked, "asked_at", over).write.parquet(f"{out}/asked/batch=tick")
    answers.tick(responses, "answered_at", over).write.mode("append").parquet(f"{out}/responses")

    feeds = [spark.readStream.schema(frame.schema).parquet(f"{out}/{name}") for frame, name in ((asked, "asked"), (responses, "responses"))]
    attempts = samples.attempts_for(asked, F.col("source_run_id").cast("bigint") / 10)
    awaited = answers.awaited(*feeds, patience="1 hour", lateness="10 minutes")
    failed_runs.on_batches(awaited, answers.report_writer(attempts, database), f"{out}/answers-checkpoint").awaitTermination()
    reported = session.stage(batches.committed(spark, database, "reports").drop("batch_id"), "streamed")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return reported


QUERIES["stream_reports"] = stream_reports


@query
def repeated_deliveries(table) -> DataFrame:
    """Runs of the events, those of every third event delivered one to three times more: the rejects.

    The second delivery is spaced otherwise than the first; the third and fourth have a key more.
    """
    n = (F.col("run_id") / 10).cast("bigint")
    copies = F.when(n % 3 == 0, 2 + (n / 3).cast("bigint") % 3).otherwise(1).cast("int")
    runs = samples.event_runs(table("events"))
    again = runs.withColumn("turn", F.explode(F.sequence(F.lit(1), copies)))
    inner = F.substring("document", F.lit(2), F.char_length("document") - 2)
    text = (
        F.when(F.col("turn") == 2, F.concat(F.lit("{ "), inner, F.lit(" }")))
        .when(F.col("turn") > 2, F.concat(F.lit('{"added": 1,'), inner, F.lit("}")))
        .otherwise(F.col("document"))
    )
    return analysis.collect(replace(_inputs(table), runs=again.withColumn("document", text).drop("turn"))).rejects


@query
def source_bytes(table) -> DataFrame:
    """Code that is delivered as bytes, with bytes that are no text in front, behind and in the middle."""
    text = F.col("source")
    cut = F.floor(F.char_length(text) / 2).cast("int")
    stray = [F.unhex(F.lit(code)) for code in ("FF", "E282", "C0")]
    halves = [F.encode(part, "UTF-8") for part in (F.left(text, cut), F.substring(text, cut + 1, F.char_length(text)))]
    content = F.concat(stray[0], halves[0], stray[1], halves[1], stray[2])
    given = replace(_inputs(table), source_code=samples.page_and_document_sources(table("pages"), table("documents")).select(
        "path", content.alias("source")
    ))
    cases = analysis.collect(given).cases
    return E.code_evidence(cases, given.source_code).select("event_id", "evidence_json")


@query
def unreadable_documents(table) -> DataFrame:
    """Documents of runs, jobs and outputs, some of them damaged: what was read of each, or why it wasn't.

    Of the runs also the analysis: no event is made for what can't be read, and its rejects name all of them.
    """
    events, customer = table("events"), table("customer")
    run_texts = samples.damaged(samples.event_documents(events), "details", F.col("run.run_id") / 10).select("event_ts", "details")
    run_objects, bad_runs = split_documents(run_texts, "details", "run")
    # Read by several outputs, and filtered by what was parsed.
    runs = session.stage(runs_from_documents(run_objects, "details", F.col("event_ts")), "read-runs")
    job_texts = samples.damaged(samples.customer_documents(customer), "details", F.col("job_id"))
    job_objects, bad_jobs = split_documents(job_texts, "details", "settings", source_job_id=F.col("job_id"))
    settings = session.stage(settings_from_documents(job_objects, "job_id", "details"), "read-settings")
    output_texts = samples.damaged(samples.output_documents(events), "details", F.col("run_id") / 10)
    output_objects, bad_outputs = split_documents(output_texts, "details", "output", source_run_id=F.col("run_id"))
    outputs = outputs_from_documents(output_objects, F.col("run_id"), "details")

    unreadable = bad_runs.unionByName(bad_jobs).unionByName(bad_outputs)
    rejects = analysis.collect(replace(_inputs(table), runs=runs, settings=settings, unreadable=unreadable)).rejects
    nothing = F.lit(None).cast("string")
    read = [
        runs.select(F.lit("run").alias("kind"), "job_id", "run_id", F.size("tasks").cast("string").alias("said")),
        settings.select(F.lit("settings").alias("kind"), "job_id", F.lit(None).cast("bigint").alias("run_id"), F.col("settings.name").alias("said")),
        outputs.select(
            F.lit("output").alias("kind"), F.lit(None).cast("bigint").alias("job_id"), "run_id",
            F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ("error", "logs", "notebook_output", "output_json")]).alias("said"),
        ),
    ]
    told = reduce(DataFrame.unionByName, read).select(
        "kind", F.col("job_id").cast("string").alias("source_job_id"), F.col("run_id").cast("string").alias("source_run_id"), "said",
        nothing.alias("reason"), nothing.alias("digest"),
    )
    return told.unionByName(
        rejects.select(F.lit("reject").alias("kind"), "source_job_id", "source_run_id", nothing.alias("said"), "reason", "digest")
    )


@query
def run_documents(table) -> DataFrame:
    """Run documents read from JSON: what was parsed, and the references anywhere in the text."""
    runs = runs_from_documents(samples.event_documents(table("events")), "details", F.col("event_ts"))
    return runs.select(
        "run_id", "job_id", "run_name", F.size("tasks").alias("n_tasks"), "document",
        F.array_join(E.document_refs(F.col("document")), ",").alias("refs"),
    )


@query
def settings_documents(table) -> DataFrame:
    """Job settings read from JSON: whole text, texts of the tasks and references anywhere in it."""
    found = E.settings_documents(samples.customer_settings(table("customer")))
    return found.select(
        "job_id", "document",
        F.array_join("task_keys", ",").alias("task_keys"),
        F.array_join("task_documents", "\n").alias("task_documents"),
        F.array_join("settings_refs", ",").alias("refs"),
    )
