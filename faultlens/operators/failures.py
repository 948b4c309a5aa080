"""Failed runs: which task failed, where its code is and what kind of error it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions.json_text import canonical
from faultlens.functions.text import first_text, truncate
from faultlens.operators.joins import spread_lookup


def task_failed(task: Column) -> Column:
    """True when state or termination says so; missing fields count as no."""
    termination = task["status"]["termination_details"]
    return (
        task["state"]["result_state"].eqNullSafe(V.FAILED_RESULT_STATE)
        | termination["type"].eqNullSafe(V.FAILED_TERMINATION_TYPE)
        | termination["code"].eqNullSafe(V.FAILED_TERMINATION_CODE)
    )


def any_task_failed(tasks: Column) -> Column:
    return F.coalesce(F.exists(tasks, task_failed), F.lit(False))


def blamed_task(tasks: Column) -> Column:
    """First failed task, else the first task, else null."""
    return F.coalesce(F.get(F.filter(tasks, task_failed), 0), F.get(tasks, 0))


def task_key_or_unknown(task: Column) -> Column:
    return F.coalesce(first_text(task["task_key"]), F.lit(V.UNKNOWN_TASK))


def settings_of_task(settings: Column, task_key: Column) -> Column:
    """First entry of the job settings with that key, else null."""
    return F.get(F.filter(settings["tasks"], lambda entry: entry["task_key"] == task_key), 0)


def code_path(task: Column) -> Column:
    """Path of the first kind of code a task declares; an empty path does not try the next kind."""

    def path_in(block: str, key: str) -> tuple[Column, Column]:
        return F.cardinality(task[block]) > 0, F.coalesce(task[block][key], F.lit(""))

    notebook, notebook_path = path_in("notebook_task", "notebook_path")
    script, script_path = path_in("spark_python_task", "python_file")
    wheel, wheel_path = path_in("python_wheel_task", "package_name")
    return F.when(notebook, notebook_path).when(script, script_path).when(wheel, wheel_path).otherwise("")


def qualifying_runs(runs: DataFrame) -> DataFrame:
    """Runs with at least one failed task."""
    return runs.where(any_task_failed(F.col("tasks")))


def qualifying_run_ids(tasks: DataFrame) -> DataFrame:
    """The same for a feed with one row per task: ids of runs with a failed task.

    The comparison is on plain columns, so it can reach the file scan, and the ids are reduced
    before the shuffle.
    """
    termination = F.col("task.status.termination_details")
    failed = (
        (F.col("task.state.result_state") == V.FAILED_RESULT_STATE)
        | (termination["type"] == V.FAILED_TERMINATION_TYPE)
        | (termination["code"] == V.FAILED_TERMINATION_CODE)
    )
    return tasks.where(failed).groupBy("parent_run_id").agg(F.count("*").alias("failed_tasks"))


# Ranks of tasks: positions below, and all that did not fail behind all that did.
_LAST_POSITION = (1 << 61) - 1
_PASSED = 1 << 61


def blamed_tasks(tasks: DataFrame) -> DataFrame:
    """One row per run of a feed with one row per task: the first failed task, else the first.

    ``pos`` is the task's place in its run, a whole number below 2^61; tasks without one come last. Whether a task
    passed and its place are one number, so the least is found by hashing in a buffer of fixed width, from a few
    columns, and combined before the shuffle: a run that holds a large share of all tasks is reduced where its rows
    are read. Only then is the task itself fetched. Of tasks that share a place the one with the least run id, then key, is taken.
    """
    passed = F.when(task_failed(F.col("task")), F.lit(0)).otherwise(F.lit(_PASSED))
    place = F.coalesce(F.col("pos"), F.lit(_LAST_POSITION)).cast("bigint")
    ranked = tasks.select("parent_run_id", "task", (place + passed).alias("_rank"))
    least = ranked.groupBy("parent_run_id").agg(F.min("_rank").alias("_least"))
    # Not an equality, so that the join deals rows by run alone and what follows needs no other shuffle.
    found = ranked.join(least, "parent_run_id").where(F.col("_rank") <= F.col("_least"))
    turn = F.row_number().over(Window.partitionBy("parent_run_id").orderBy("task.run_id", "task.task_key"))
    return found.withColumn("_turn", turn).where("_turn = 1").select(
        "parent_run_id", "task", (F.col("_least") >= _PASSED).alias("is_fallback")
    )


def require_keys(runs: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Split into rows that have every key and rejected rows with the reason."""
    missing = [F.when(first_text(F.trim(F.col(key).cast("string"))).isNull(), F.lit(key)) for key in keys]
    reason = F.array_compact(F.array(*missing))
    complete = runs.where(F.size(reason) == 0)
    rejected = runs.where(F.size(reason) > 0).withColumn(
        "reason", F.concat(F.lit("required: "), F.array_join(reason, ", "))
    )
    return complete, rejected


def with_document(runs: DataFrame) -> DataFrame:
    """Runs with their whole JSON text; feeds without one get the text of their columns."""
    built = F.to_json(F.struct("job_id", "run_id", "run_name", "tasks"))
    return runs.withColumn("document", F.coalesce("document", built) if "document" in runs.columns else built)


def delivery_rank(tasks: Column, document: Column) -> Column:
    """Which of several deliveries of a run counts: the one with most tasks, then the longest text, then by digest.

    Length and digest are those of the canonical text, so a document that comes back with its keys in another order is
    the same delivery.
    """
    text = canonical(document)
    return F.struct(
        (-F.coalesce(F.size(tasks), F.lit(0))).alias("tasks"),
        (-F.char_length(text)).alias("length"),
        F.md5(text).alias("digest"),
    )


def first_deliveries(runs: DataFrame, *order: Column | str) -> DataFrame:
    """One row per case of a feed that may deliver a run again: the one least by ``order``.

    The rank limit is applied before the shuffle as well, so a run that was delivered very often is
    reduced where its rows are read.
    """
    turn = F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    return runs.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def counted_deliveries(run_heads: DataFrame) -> DataFrame:
    """One row per case: the delivery least by ``_rank``, that rank as ``first_rank``, and the number of all as ``_n``.

    Texts are ranked for it once; it combines before the shuffle, so a run that was delivered very often is reduced where
    its rows are read.
    """
    facts = [name for name in run_heads.columns if name not in ("case_id", "_rank")]
    first = F.min_by(F.struct("_rank", *facts), F.col("_rank")).alias("first")
    counted = run_heads.groupBy("case_id").agg(F.count("*").alias("_n"), first)
    return counted.select("case_id", *[f"first.{name}" for name in facts], "_n", F.col("first._rank").alias("first_rank"))


def delivered_again(counted: DataFrame) -> DataFrame:
    """(case_id, first_rank) of the cases of ``counted_deliveries`` that have more than one row.

    Each case once, also where a lookup that repeats its key has made several rows of it since.
    """
    return counted.where("_n > 1").select("case_id", "first_rank").dropDuplicates(["case_id"])


def repeated_deliveries(run_heads: DataFrame, again: DataFrame) -> DataFrame:
    """Rejects for all deliveries but the one that counts: a row for each text, with the number of its surplus rows.

    ``again`` comes from ``delivered_again``, with a null rank for cases of which no delivery counts; all other
    cases are left out before anything is grouped by text.
    """
    keys = {"source_job_id": F.col("job_id").cast("string"), "source_run_id": F.col("run_id").cast("string")}
    texts = run_heads.join(again, "case_id").groupBy(
        "case_id", "first_rank", "_rank", *[value.alias(name) for name, value in keys.items()]
    ).agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    counts = F.coalesce(F.col("_rank") == F.col("first_rank"), F.lit(False))
    surplus = F.col("n") - counts.cast("int")
    return texts.withColumn("surplus", surplus).where("surplus > 0").select(
        *keys, "event_id",
        F.concat(F.lit("delivered again: "), F.col("surplus").cast("string")).alias("reason"),
        F.col("_rank.digest").alias("digest"),
    )


def heads(runs: DataFrame) -> DataFrame:
    """One narrow row per run document: keys, blamed task and event id; tasks and text are dropped."""
    return with_event_id(
        runs.select(
            "*", blamed_task(F.col("tasks")).alias("task"), (~any_task_failed(F.col("tasks"))).alias("is_fallback")
        ).drop("tasks", "document")
    )


def with_event_id(runs: DataFrame) -> DataFrame:
    """Add task key, event id and case id to runs that carry their blamed ``task``.

    The event id shows whole seconds, so two runs may share it; the case id tells them apart.
    """
    keys = [F.col("job_id").cast("string"), F.col("run_id").cast("string"), F.unix_micros("event_ts").cast("string")]
    cases = runs.withColumn("failed_task_key", task_key_or_unknown(F.col("task")))
    return cases.withColumn("case_id", F.concat_ws(":", *keys)).withColumn(
        "event_id",
        F.concat_ws(
            ":",
            F.col("job_id").cast("string"),
            F.col("run_id").cast("string"),
            F.col("failed_task_key"),
            F.unix_timestamp("event_ts").cast("string"),
        ),
    )


def case_facts() -> list[Column]:
    """What a case takes from its run and blamed task alone."""
    return [
        F.col("job_id").cast("string").alias("source_job_id"),
        F.col("run_id").cast("string").alias("source_run_id"),
        F.nullif(F.col("task.run_id"), F.lit(0).cast("bigint")).alias("task_run_id"),
        F.col("task.state.result_state").alias("result_state"),
        F.col("task.state.state_message").alias("state_message"),
        F.col("task.status.termination_details.code").alias("termination_code"),
        F.col("task.status.termination_details.message").alias("termination_message"),
    ]


def bare_cases(run_heads: DataFrame) -> DataFrame:
    """Cases without what only the job settings know; enough to find outputs and classify errors."""
    return run_heads.select("case_id", "event_id", "event_ts", "failed_task_key", *case_facts())


def identify(run_heads: DataFrame, settings: DataFrame) -> DataFrame:
    """Look up the job settings: code path, job name and the task's own settings.

    A job may own a large share of the runs, hence the spread lookup.
    """
    keep = {"run_id", "job_id", "run_name", "task"}
    joined = spread_lookup(run_heads, settings, F.col("job_id"), "job_id", F.col("run_id")).withColumn(
        "task_settings", settings_of_task(F.col("settings"), F.col("failed_task_key"))
    )
    path = F.coalesce(
        first_text(code_path(F.col("task_settings"))), first_text(code_path(F.col("task"))), F.lit("")
    )
    return joined.select(
        *case_facts(),
        F.coalesce(first_text(F.col("run_name"), F.col("settings.name")), F.lit("")).alias("source_job_name"),
        path.alias("failure_code_path"),
        "task_settings",
        *[name for name in settings.columns if name != "job_id"],
        *[name for name in run_heads.columns if name not in keep],
    )


def classify_error(output_text: Column, termination_code: Column, result_state: Column) -> Column:
    """Error class by ordered rules over the whole output document."""

    def has(marker: str, text: Column = output_text) -> Column:
        return F.contains(text, F.lit(marker))

    return (
        F.when(has(V.UNRESOLVED_COLUMN), V.UNRESOLVED_COLUMN)
        .when(has(V.PERMISSION_DENIED) | has(V.PERMISSION_DENIED_NAME), V.PERMISSION_DENIED)
        .when(has(V.TABLE_NOT_FOUND) | has(V.NOT_FOUND_WORDS, F.lower(output_text)), V.NOT_FOUND)
        .otherwise(F.coalesce(first_text(termination_code, result_state), F.lit(V.UNKNOWN)))
    )


def describe_error(
    error: Column,
    notebook_output: Column,
    termination_message: Column,
    state_message: Column,
    output_text: Column,
) -> Column:
    """First text at hand that describes the error, bounded in length."""
    return truncate(
        first_text(error, notebook_output, termination_message, state_message, output_text),
        V.ERROR_DESCRIPTION_LIMIT,
    )
