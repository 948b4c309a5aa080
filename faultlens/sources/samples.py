"""Input tables derived from the star-schema test tables.

The test data holds no run log. Every adapter is a row-by-row mapping of a whole table, so the
derived tables grow with the data and no rows are grouped to build a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.functions.text import iso_utc, table_refs
from faultlens.operators.joins import spread_lookup
from faultlens.sources.readers import settings_from_documents

# Error texts by event number; one text carries two markers to show which rule comes first.
ERROR_TEXTS = [
    "AnalysisException: [UNRESOLVED_COLUMN.WITH_SUGGESTION] column amount cannot be resolved",
    "PERMISSION_DENIED: user lacks USE SCHEMA; also [TABLE_OR_VIEW_NOT_FOUND]",
    "[TABLE_OR_VIEW_NOT_FOUND] The table or view cannot be found",
    "ModuleNotFoundError: No module named vendor_lib",
    "ValueError: data quality rule orders_complete is broken, found 0 rows",
    "PermissionError: permission denied on /mnt/vendor/daily",
    "java.io.IOException: Path Not Found: /mnt/raw",
    "",
]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(value: Column) -> Column:
    return value.cast("string")


def join_text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Runs and tasks from orders and lineitem: one row per task ------------------------------------

def order_runs(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("job_id"),
        join_text("job_", F.col("o_custkey")).alias("run_name"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"),
    )


def line_tasks(lineitem: DataFrame) -> DataFrame:
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    result = F.when(flag == "R", "FAILED").when(flag == "A", "SUCCESS")
    none = F.lit(None).cast("map<string,string>")
    task = F.struct(
        F.create_map(F.lit("notebook_path"), join_text("/lines/", F.col("l_partkey"))).alias("notebook_task"),
        none.alias("python_wheel_task"),
        (F.col("l_orderkey") * 100 + number).cast("bigint").alias("run_id"),
        none.alias("spark_python_task"),
        F.struct(result.alias("result_state"), F.lit(None).cast("string").alias("state_message")).alias("state"),
        F.struct(
            F.struct(
                F.when((flag == "A") & (number == 7), "RUN_EXECUTION_ERROR").alias("code"),
                F.lit(None).cast("string").alias("message"),
                F.when((flag == "N") & (status == "F"), "CLIENT_ERROR").alias("type"),
            ).alias("termination_details")
        ).alias("status"),
        join_text("task_", number).alias("task_key"),
    )
    # Line numbers repeat; part and supplier tell such lines apart.
    place = F.shiftleft(number.cast("bigint"), 57) + F.shiftleft("l_partkey", 26) + F.col("l_suppkey")
    return lineitem.select(F.col("l_orderkey").alias("parent_run_id"), place.alias("pos"), task.alias("task"))


# Run documents from events ---------------------------------------------------------------------


def event_documents(events: DataFrame) -> DataFrame:
    """JSON documents of runs with one to three tasks each, built within the row.

    They hold keys that the run schema does not know, among them the only mention of some tables.
    """
    n = F.col("event_id")
    is_error = F.col("event_type") == "error"

    def block(position: Column, turn: int, key: str, *path: Column | str) -> Column:
        return F.when((n + position) % 3 == turn, F.create_map(F.lit(key), join_text(*path)))

    def task(i: Column) -> Column:
        i = i.cast("bigint")
        hit = is_error & (i == n % 3)
        return F.struct(
            F.when(i > 0, F.array(F.struct(join_text("task_", i - 1).alias("task_key")))).alias("depends_on"),
            block(i, 0, "notebook_path", "/jobs/page_", n % 300).alias("notebook_task"),
            block(i, 2, "package_name", "pkg_", F.col("user_id")).alias("python_wheel_task"),
            F.when((n + i) % 13 != 0, n * 10 + i + 1).alias("run_id"),
            block(i, 1, "python_file", "/src/etl_", F.col("user_id"), ".py").alias("spark_python_task"),
            F.when(
                i == 1,
                F.struct(join_text('select "id"\nfrom `lake`.raw.orders_', n % 50, " -- \\").alias("query")),
            ).alias("sql_task"),
            F.struct(
                F.when(hit, "FAILED").when(n % 5 != 0, "SUCCESS").alias("result_state"),
                F.when(hit, join_text("failed reading `lake`.sales.t", F.col("user_id"))).alias("state_message"),
            ).alias("state"),
            F.struct(
                F.struct(
                    F.when(hit & (n % 5 != 0), "RUN_EXECUTION_ERROR").alias("code"),
                    F.when(hit, join_text("run ", n, " ended with ", F.col("props"))).alias("message"),
                    F.when(is_error & (n % 7 == 1), "CLIENT_ERROR").alias("type"),
                ).alias("termination_details")
            ).alias("status"),
            join_text("task_", (n + i * i) % 4).alias("task_key"),
        )

    details = F.struct(
        (F.col("user_id") * 11).alias("job_id"),
        (n * 10).alias("run_id"),
        F.when(n % 4 != 0, join_text("run of job ", F.col("user_id"))).alias("run_name"),
        join_text("https://runs.example/", n * 10).alias("run_page_url"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), n % 3), task).alias("tasks"),
    )
    moment = F.col("ts").cast("timestamp").alias("event_ts")
    return events.select(moment, details.alias("run"), F.to_json(details).alias("details"))


def event_runs(events: DataFrame) -> DataFrame:
    """The same as parsed rows beside the text, so that a filter on them does not parse it again."""
    tasks = F.transform("run.tasks", lambda task: task.dropFields("depends_on", "sql_task")).alias("tasks")
    return event_documents(events).select(
        "run.run_id", "run.job_id", "run.run_name", "event_ts", tasks, F.col("details").alias("document")
    )


def event_outputs(events: DataFrame) -> DataFrame:
    """Outputs of the root run and of the task that failed; one event in six has no root output."""
    n = F.col("event_id")
    error = F.get(F.array(*[F.lit(t) for t in ERROR_TEXTS]), (n % 8).cast("int"))
    ids = F.array(F.when(n % 6 != 0, n * 10), n * 10 + n % 3 + 1)
    return (
        events.withColumn("id", F.explode(F.array_compact(ids)))
        .select(
            F.col("id").alias("run_id"),
            F.when(F.col("id") % 10 != 0, error).alias("error"),
            join_text("INFO start\nread from `raw`.orders.day_", F.col("user_id") % 20, "\ndone").alias("logs"),
            F.when(n % 2 == 0, join_text("cell ", n)).alias("notebook_output"),
            join_text('{"attempt": ', n % 3, "}").alias("output_json"),
        )
    )


def output_documents(events: DataFrame) -> DataFrame:
    """JSON documents of run outputs, with keys that only some of them have."""
    n = F.col("event_id")
    cell = F.struct(join_text("cell ", n).alias("result"), F.lit(False).alias("truncated"))
    details = F.struct(
        F.when(n % 3 != 0, F.get(F.array(*[F.lit(t) for t in ERROR_TEXTS]), (n % 8).cast("int"))).alias("error"),
        join_text("read \"raw\".orders.day_", F.col("user_id") % 20, "\ndone").alias("logs"),
        F.when(n % 4 == 1, n % 3).alias("attempt"),
        F.when(n % 2 == 0, cell).alias("notebook_output"),
    )
    return events.select((n * 10).alias("run_id"), F.to_json(details).alias("details"))


def damaged(documents: DataFrame, text: str, number: Column) -> DataFrame:
    """The same documents, of seven four not readable as an object: absent, cut off, in a list, with something behind."""
    whole = F.col(text)
    half = F.left(whole, (F.char_length(whole) / 2).cast("int"))
    form = number % 7
    broken = (
        F.when(form == 1, half)
        .when(form == 2, F.concat(F.lit("["), whole, F.lit("]")))
        .when(form == 3, F.concat(whole, F.lit(" and more")))
        .when(form != 4, whole)
    )
    return documents.withColumn(text, broken)


def customer_documents(customer: DataFrame) -> DataFrame:
    """JSON documents of job settings, with keys that the settings schema does not know."""
    c = F.col("c_custkey")
    none = F.lit(None).cast("map<string,string>")

    def entry(key: Column, notebook: Column = none, wheel: Column = none, script: Column = none) -> Column:
        return F.struct(
            (c % 4).alias("max_retries"), notebook.alias("notebook_task"), wheel.alias("python_wheel_task"),
            script.alias("spark_python_task"), key.alias("task_key"),
        )

    tasks = F.array(
        entry(join_text("task_", c % 3), notebook=F.create_map(F.lit("notebook_path"), join_text("/jobs/page_", c % 400))),
        entry(join_text("task_", c % 5), script=F.create_map(F.lit("python_file"), join_text("/src/etl_", c, ".py"))),
        entry(F.lit("task_7"), wheel=F.create_map(F.lit("package_name"), join_text("pkg_", c % 10))),
        entry(F.lit("task_1"), notebook=F.create_map(F.lit("notebook_path"), F.lit(""))),
    )
    settings = F.struct(
        F.col("c_name").alias("name"),
        F.struct(join_text("after lake.ref.calendar_", c % 7).alias("note")).alias("schedule"),
        F.when(c % 10 != 9, tasks).alias("tasks"),
    )
    details = F.struct(F.col("c_mktsegment").alias("creator"), settings.alias("settings"))
    return customer.select(c.alias("job_id"), F.to_json(details).alias("details"))


def customer_settings(customer: DataFrame) -> DataFrame:
    """The same read back from the documents."""
    return settings_from_documents(customer_documents(customer), "job_id", "details")


def page_and_document_sources(pages: DataFrame, documents: DataFrame) -> DataFrame:
    return pages.select(join_text("/jobs/page_", F.col("page_id")).alias("path"), F.col("html").alias("source")).unionByName(
        documents.select(join_text("/src/etl_", F.col("doc_id"), ".py").alias("path"), F.col("text").alias("source"))
    )


# Table snapshots -------------------------------------------------------------------------------


def page_refs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(table_refs(F.col("html"))).alias("table_name"))


def snapshot_columns(pages: DataFrame, customer: DataFrame) -> DataFrame:
    """Columns of three quarters of the tables that pages name, by a digest of the name, and of one sales table per customer."""
    named = page_refs(pages).groupBy("table_name").agg(F.min("page_id").alias("first_page"))
    width = 1 + F.col("first_page") % 3
    of_pages = named.where(F.left(F.md5("table_name"), F.lit(1)) < "c").select(
        "table_name", F.explode(F.sequence(F.lit(1).cast("bigint"), width)).alias("ordinal")
    )
    of_sales = customer.select(
        join_text("lake.sales.t", F.col("c_custkey")).alias("table_name"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("c_custkey") % 4)).alias("ordinal"),
    )
    ordinal = F.col("ordinal")
    return of_pages.unionByName(of_sales).select(
        "table_name",
        ordinal.cast("int").alias("ordinal"),
        join_text("c", ordinal).alias("col_name"),
        F.when(ordinal % 2 == 0, "double").otherwise("string").alias("data_type"),
        F.when(ordinal == 1, "key").alias("comment"),
    )


def snapshot_history(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Every page that names a table is a version of it; every order one of a sales table."""
    of_pages = page_refs(pages).select(
        "table_name", F.col("page_id").alias("version"),
        F.timestamp_seconds(F.col("page_id") * 60).alias("ts"), F.lit("WRITE").alias("operation"),
        join_text("writer_", F.col("page_id") % 3).alias("user_name"),
    )
    of_sales = orders.select(
        join_text("lake.sales.t", F.col("o_custkey")).alias("table_name"), F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("operation"),
        F.col("o_orderpriority").alias("user_name"),
    )
    return of_pages.unionByName(of_sales)


def snapshot_details(customer: DataFrame) -> DataFrame:
    return customer.select(
        join_text("lake.sales.t", F.col("c_custkey")).alias("table_name"),
        F.lit("parquet").alias("format"),
        F.col("c_nationkey").cast("bigint").alias("num_files"),
        join_text("/lake/sales/t", F.col("c_custkey")).alias("location"),
        F.array(F.lit("day")).alias("partition_columns"),
    )


def line_history(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        join_text("lake.parts.p", F.col("l_partkey")).alias("table_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_returnflag").alias("operation"),
    )


# Prompts ---------------------------------------------------------------------------------------

PART_TEMPLATE = (
    "{{job}} {source_job_id} run {source_run_id} of {source_job_name}: {failed_task_key} "
    "({failed_task_run_id})\ncode {discovered_code_paths}\ntables {discovered_tables}\n{evidence_bundle_json}"
)


def part_prompts(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    active = F.when(p % 3 == 0, "true").when(p % 3 == 1, "TRUE").otherwise("false")
    temperature = F.when(p % 5 == 0, "").when(p % 5 == 1, "0.25").when(p % 5 == 2, "1e-1").when(p % 5 == 3, "warm")
    tokens = F.when(p % 4 == 0, "").when(p % 4 == 1, "800").when(p % 4 == 2, " 900 ").otherwise("many")
    day = join_text("2026-01-", F.lpad(text(1 + p % 28), 2, "0"))
    return part.select(
        F.col("p_type").alias("prompt_name"),
        F.col("p_brand").alias("prompt_alias"),
        text(F.col("p_size")).alias("prompt_version"),
        active.alias("is_active"),
        F.col("p_name").alias("model_endpoint"),
        temperature.alias("temperature"),
        tokens.alias("max_tokens"),
        F.lit("Explain the failure.").alias("system_prompt"),
        F.lit(PART_TEMPLATE).alias("user_prompt_template"),
        join_text("part ", p).alias("notes"),
        day.alias("created_at"),
        day.alias("updated_at"),
        p.alias("part_key"),
    )


# Model answers and delivery attempts -----------------------------------------------------------


# Answers by form; ``said`` is quoted as JSON where the form is an object around it.
ANSWER_HEAD = '{"title": "T", "error_type": "DATA", "error_description": '
ANSWER_TAIL = (
    ', "possible_fixes": ["check input", "rerun", null, "page owner"], "confidence": "high",'
    ' "likely_root_cause": "late feed", "evidence": [{"line": 1}], "databricks_links": "[\\"a\\", \\"b\\", \\"c\\"]"}'
)
ANSWER_WRAPPED = {0: ("", ""), 1: ("```json\n", "\n```"), 2: ("Here it is: ", " - as asked."), 3: ("[", "]")}
ANSWER_FIXED = {
    4: "{'title': 'single quotes'}",
    6: '\n {"error_type": "", "possible_fixes": "restart", "recommended_fix": "restart twice",'
       ' "owner_next_steps": ["ask"], "confidence": null, "missing_context": [{"log": 1, "log": 2}]}\t',
    7: '{"primary_error": "boom", "possible_fixes": [], "owner_next_steps": ["ask owner"], "evidence": 0}',
}


# What a second answer to one case says; it comes too late to count.
SECOND_ANSWER = '{"error_type": "SECOND", "confidence": "high"}'


def with_answer(df: DataFrame, form: Column, said: Column) -> DataFrame:
    """Add ``answer``: one of eight forms, most of them around a JSON object."""
    listed = F.to_json(F.array(said))
    body = F.concat(
        F.lit(ANSWER_HEAD), F.substring(listed, F.lit(2), F.char_length(listed) - 2), F.lit(ANSWER_TAIL)
    )
    before = F.create_map(*[F.lit(v) for f, (v, _) in ANSWER_WRAPPED.items() for v in (f, v)])
    after = F.create_map(*[F.lit(v) for f, (_, v) in ANSWER_WRAPPED.items() for v in (f, v)])
    fixed = F.create_map(*[F.lit(v) for pair in ANSWER_FIXED.items() for v in pair])
    form = form.cast("int")
    return df.withColumn(
        "answer",
        F.when(form < 4, F.concat(before[form], body, after[form])).when(form == 5, said).otherwise(fixed[form]),
    )


def responses_for(cases: DataFrame) -> DataFrame:
    """Responses to every case with a known job name; the place of the content and errors vary.

    They come a minute after the run. One case in five has a second, other answer half a minute later; of the rest one in
    seven has the same answer twice.
    """
    n = (F.col("source_run_id").cast("bigint") / 10).cast("bigint")
    known = cases.where(F.col("source_job_name") != "").select("case_id", "event_id", "event_ts", n.alias("n"), "source_job_name")
    said = join_text("run ", F.col("n"), " of \"", F.col("source_job_name"), "\"")
    n = F.col("n")
    turns = F.when(n % 5 == 0, F.array(F.lit(0), F.lit(1))).when(n % 7 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    told = with_answer(known, n % 8, said).withColumn("turn", F.explode(turns))
    answer = F.when(F.col("turn") == 0, F.col("answer")).otherwise(F.lit(SECOND_ANSWER))
    message = F.struct(F.struct(answer.alias("content")).alias("message"))
    failed = (n % 10 == 0) & (F.col("turn") == 0)
    return told.select(
        "case_id",
        "event_id",
        (F.col("event_ts") + F.make_dt_interval(secs=60 + 30 * F.col("turn"))).alias("answered_at"),
        F.when(n % 3 == 0, F.array(message)).alias("choices"),
        F.when(n % 3 == 1, F.array(answer)).alias("predictions"),
        F.when(n % 3 == 2, F.array(answer)).alias("outputs"),
        F.when(failed, join_text("TimeoutError: no answer for run ", n)).alias("error"),
    )


# Attempts by form, in SQL: kind, attempt, ok, HTTP status, body, error. The first try of the
# helper is superseded by its second.
_FIRST = "('helper', 1, false, null, null, 'first try')"
_NO_HELPER = f"{_FIRST}, ('helper', 2, false, null, null, 'ImportError: helper')"
ATTEMPT_FORMS = [
    f"{_FIRST}, ('helper', 2, true, null, null, null)",
    f"{_FIRST}, ('helper', 2, false, null, null, 'SlackApiError: not_in_channel')",
    f"{_FIRST}, ('helper', 2, false, null, null, 'SlackApiError: channel_not_found')",
    f"""{_NO_HELPER}, ('api', 1, true, 200, '{{"ok": true, "channel": "C42", "ts": "17.5"}}', null)""",
    f"""{_NO_HELPER}, ('api', 1, false, 200, '{{"ok": false, "error": "invalid_auth"}}', null),
        ('webhook', 1, true, 200, 'ok', null)""",
    f"{_NO_HELPER}, ('webhook', 1, null, 200, ' OK\\n', null)",
    f"{_NO_HELPER}, ('webhook', 1, null, 500, 'down', null)",
    "",
]
_ATTEMPT = "struct<kind string, attempt int, ok boolean, http_status int, body string, error string>"


def attempts_for(cases: DataFrame, number: Column, key: str = "event_id") -> DataFrame:
    """Delivery attempts of every case in one of eight forms."""
    forms = ", ".join(f"cast(array({rows}) as array<{_ATTEMPT}>)" for rows in ATTEMPT_FORMS)
    tried = F.get(F.expr(f"array({forms})"), (number % 8).cast("int"))
    exploded = cases.select(F.col(key).cast("string").alias("event_id"), F.explode(tried).alias("a"))
    return exploded.select("event_id", "a.*").select(*S.DELIVERY_ATTEMPTS.fieldNames())


# Feeds -----------------------------------------------------------------------------------------


def vendor_feed(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as rows of a feed per nation of the customer, who may own many orders."""
    nation = customer.select("c_custkey", F.col("c_nationkey").alias("vendor_id"))
    dated = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("feed_date"))
    found = spread_lookup(dated, nation, F.col("o_custkey"), "c_custkey", F.col("o_orderkey"))
    return found.select("vendor_id", "feed_date")


# Reports ---------------------------------------------------------------------------------------


def order_reports(orders: DataFrame) -> DataFrame:
    """One report per order; the creation time is unique."""
    created = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    return orders.select(
        join_text(F.col("o_custkey"), ":", F.col("o_orderkey")).alias("event_id"),
        text(F.col("o_custkey")).alias("source_job_id"),
        text(F.col("o_orderkey")).alias("source_run_id"),
        iso_utc(created).alias("created_at"),
        F.col("o_orderpriority").alias("error_type"),
        join_text("order ", F.col("o_orderkey")).alias("error_description"),
        join_text("status ", F.col("o_orderstatus")).alias("likely_root_cause"),
        F.to_json(F.array(join_text("retry ", F.col("o_orderkey")))).alias("possible_fixes"),
        F.lit("retry").alias("recommended_fix"),
        F.lit("low").alias("confidence"),
        F.lit("C1").alias("slack_channel_id"),
        F.lit("sent").alias("slack_notification_status"),
        text(F.col("o_orderkey")).alias("slack_message_ts"),
        F.lit("").alias("slack_error"),
    )
