"""The whole analysis of a batch of failed runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import session
from faultlens.functions.text import iso_utc
from faultlens.operators import evidence as E
from faultlens.operators import failures, notify, prompts, reports
from faultlens.operators.joins import asked_for, by_case
from faultlens.schemas import BATCH_TABLES, EVENTS, EVIDENCE, REJECTS, REPORTS
from faultlens.sinks import batches
from faultlens.sinks.tables import align

Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """Input tables; ``responses`` and ``attempts`` come from the services outside.

    ``unreadable`` has the rejects of ``readers.split_documents``, where the feeds deliver documents.
    """

    runs: DataFrame
    settings: DataFrame
    outputs: DataFrame
    source_code: DataFrame
    table_columns: DataFrame
    table_history: DataFrame
    table_details: DataFrame
    prompts: DataFrame
    unreadable: DataFrame | None = None


@dataclass(frozen=True)
class Collected:
    """Outcome of the first phase: what is known before the model is asked.

    Outputs are built when they are first read, so a caller that wants only some of them does not
    pay for the others; what several share is written once by ``keep``. ``cases`` holds one narrow
    row of keys per failed run, ``counted`` the same with the number of its deliveries and the rank of the one that
    counts, ``delivered`` a row for each delivery.
    """

    inputs: Inputs
    runs: DataFrame
    delivered: DataFrame
    incomplete: DataFrame
    cases: DataFrame
    counted: DataFrame
    prompt_name: str
    prompt_alias: str
    channel: str
    keep: Stage
    stored: DataFrame | None = None

    @property
    def events(self) -> DataFrame:
        return align(event_rows(self.cases, self.channel), EVENTS)

    @cached_property
    def outputs(self) -> DataFrame:
        """Output evidence, with the error class and description beside the blamed task's row."""
        return self.keep(E.output_evidence(self.cases, self.inputs.outputs), "outputs")

    @cached_property
    def summaries(self) -> DataFrame:
        """Error class and description per case; without the rest of the evidence where nobody has read that."""
        if "outputs" in self.__dict__:
            task = self.outputs.where(F.col("collector_name") == V.FAILED_TASK_OUTPUT)
            return task.select(*E.KEYS, "error_type", "error_description")
        return E.error_summaries(self.cases, self.inputs.outputs)

    @cached_property
    def again(self) -> DataFrame:
        """Cases that were delivered more than once, with the rank of the delivery that counts.

        None counts for a case that was analysed before.
        """
        again = failures.delivered_again(self.counted)
        if self.stored is not None:
            none = F.lit(None).cast(again.schema["first_rank"].dataType).alias("first_rank")
            again = again.join(self.stored, "case_id", "left_anti").unionByName(self.stored.select("case_id", none))
        return self.keep(again, "again")

    def _documents(self) -> DataFrame:
        """The run document of every case. Only documents of repeated cases are ranked and moved for it."""
        documents = failures.with_event_id(
            self.runs.withColumn("task", failures.blamed_task(F.col("tasks")))
        ).select(
            "case_id",
            "event_id",
            F.col("job_id").cast("string").alias("source_job_id"),
            F.col("run_id").cast("string").alias("source_run_id"),
            "event_ts", "document", "_rank",
        )
        if self.again.isEmpty():
            return documents
        repeated = documents.join(self.again.where("first_rank is not null"), "case_id", "left_semi")
        return documents.join(self.again, "case_id", "left_anti").unionByName(
            failures.first_deliveries(repeated, "_rank", F.md5("document"))
        )

    @cached_property
    def found(self) -> DataFrame:
        """Evidence that does not depend on the references found in it."""
        job = F.col("source_job_id").cast("bigint")
        settings = E.settings_documents(asked_for(self.inputs.settings, "job_id", self.cases, job))
        others = (
            E.run_evidence(self._documents())
            .unionByName(E.settings_evidence(self.cases, settings))
            .unionByName(E.code_evidence(self.cases, self.inputs.source_code))
        )
        return self.keep(others, "evidence").unionByName(self.outputs)

    @cached_property
    def refs(self) -> DataFrame:
        # Rows without references add nothing to a case, but each case keeps one: its run document.
        rows = self.found.where((F.size("refs") > 0) | (F.col("ord") == 1))
        return self.keep(E.event_refs(rows), "refs")

    @cached_property
    def tables(self) -> DataFrame:
        given = self.inputs
        wanted = self.refs.select(F.explode(E.top_refs()).alias("ref"))
        return E.table_documents(given.table_columns, given.table_history, given.table_details, wanted)

    def keep_tables(self) -> None:
        """Write the table documents once, for a caller that reads the evidence and the requests made of it."""
        if "evidence" not in self.__dict__:
            self.__dict__["tables"] = self.keep(self.tables, "tables")

    @cached_property
    def evidence(self) -> DataFrame:
        plain = [*E.KEYS, "ord", "detail", "collector_name", "evidence_json"]
        return (
            self.found.select(*plain)
            .unionByName(E.table_evidence(self.refs, self.tables))
            .unionByName(E.summary_evidence(self.outputs))
        )

    @cached_property
    def _judged(self) -> tuple[DataFrame, DataFrame]:
        """Cases with the prompt they are asked with, and those that can't be asked."""
        chosen = prompts.select_prompt(self.inputs.prompts, self.prompt_name, self.prompt_alias)
        return prompts.assign_prompt(self.cases, chosen, self.prompt_name, self.prompt_alias)

    @cached_property
    def asked(self) -> DataFrame:
        """Cases that have a request, with their error class and prompt.

        The second phase starts from it; it is written, so the phases may run apart.
        """
        summary = self.summaries.select("case_id", "error_type", "error_description")
        accepted = self._judged[0].drop("temperature", "max_tokens", "system_prompt", "pieces")
        return self.keep(accepted.join(summary, "case_id", "left"), "asked")

    @property
    def requests(self) -> DataFrame:
        refs = self.refs.select("case_id", "refs")
        return prompts.prompt_requests(self._judged[0], E.bundle(self.evidence), refs)

    @property
    def rejects(self) -> DataFrame:
        """Unreadable documents, runs without keys, surplus deliveries and cases that can't be asked, with the reason.

        The digest is that of the document, where there is one; of a surplus delivery, of its canonical text.
        """
        without_keys = self.incomplete.select(
            F.col("job_id").cast("string").alias("source_job_id"),
            F.col("run_id").cast("string").alias("source_run_id"),
            F.lit(None).cast("string").alias("event_id"),
            "reason",
            F.md5("document").alias("digest"),
        )
        parts = [without_keys, self._judged[1]]
        # To rank the deliveries once more, all texts are read.
        if not self.again.isEmpty():
            parts.append(failures.repeated_deliveries(self.delivered, self.again))
        if self.inputs.unreadable is not None:
            parts.append(self.inputs.unreadable)
        return reduce(DataFrame.unionByName, [align(part, REJECTS) for part in parts])


@dataclass(frozen=True)
class Reported:
    """Outcome of the second phase. Its rejects are the responses beyond the first of a case."""

    reports: DataFrame
    notifications: DataFrame
    evidence: DataFrame
    rejects: DataFrame


def event_rows(cases: DataFrame, channel: str = V.DEFAULT_CHANNEL) -> DataFrame:
    """Rows of the event table."""
    payload = F.to_json(
        F.struct(
            "failed_task_key",
            F.coalesce(F.col("task_run_id").cast("string"), F.lit("")).alias("failed_task_run_id"),
            "failure_code_path",
            F.lit(channel).alias("slack_channel"),
            "source_job_id",
            "source_job_name",
            "source_run_id",
            F.lit(V.TRIGGER_SOURCE).alias("trigger_source"),
        )
    )
    return cases.select(
        "event_id", "source_job_id", "source_run_id", "source_job_name", "failed_task_key",
        F.lit(V.TRIGGER_SOURCE).alias("trigger_source"),
        payload.alias("payload_json"),
        iso_utc(F.col("event_ts")).alias("created_at"),
    )


def collect(
    inputs: Inputs,
    prompt_name: str = V.DEFAULT_PROMPT_NAME,
    prompt_alias: str = V.DEFAULT_PROMPT_ALIAS,
    channel: str = V.DEFAULT_CHANNEL,
    only_failed: bool = True,
    keep: Stage = session.stage,
    stored: DataFrame | None = None,
) -> Collected:
    """First phase: identify, gather evidence, render requests.

    Parameters are stripped and an empty channel means the default one.

    ``keep`` writes the frames that several outputs share, so they are computed once. A run that is
    delivered again (same job, run and ``event_ts``) is analysed once, by the delivery with most tasks, then the
    longest text; the others are counted among the rejects. ``stored`` (``case_id``, see ``known_cases``) names
    the cases that were analysed before: their deliveries are rejects, too. Each lookup table is unique by its key.
    """
    prompt_name, prompt_alias = prompt_name.strip(), prompt_alias.strip()
    channel = channel.strip() or V.DEFAULT_CHANNEL
    complete, incomplete = failures.require_keys(failures.with_document(inputs.runs), "job_id", "run_id")
    runs = failures.qualifying_runs(complete) if only_failed else complete
    runs = runs.withColumn("_rank", failures.delivery_rank(F.col("tasks"), F.col("document")))
    delivered = failures.heads(runs)
    keyed = failures.counted_deliveries(delivered)
    if stored is not None:
        here = delivered.select("case_id").distinct()
        stored = keep(here.join(stored.select("case_id"), "case_id", "left_semi"), "stored")
        keyed = keyed.join(stored, "case_id", "left_anti")
    settings = inputs.settings.select("job_id", "settings")
    counted = keep(failures.identify(keyed, settings).drop("settings", "task_settings"), "cases")
    cases = counted.drop("_n", "first_rank")
    return Collected(inputs, runs, delivered, incomplete, cases, counted, prompt_name, prompt_alias, channel, keep, stored)


def known_cases(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Case ids of the event rows that were created in the time that ``runs`` span.

    A run that is delivered again has the time it had before. The text of a creation time sorts like the time, so the
    bounds reach the scan: of a long history only the files that overlap the batch are read.
    """
    # One row: the bounds.
    first, last = runs.agg(*[F.left(iso_utc(bound("event_ts")), F.lit(19)) for bound in (F.min, F.max)]).first()
    # Behind the second there may be a fraction, then the offset. Without runs nothing is asked for.
    found = events.where(F.col("created_at").between(first, f"{last}~") if first else F.lit(False))
    moment = F.unix_micros(F.col("created_at").cast("timestamp")).cast("string")
    return found.select(F.concat_ws(":", "source_job_id", "source_run_id", moment).alias("case_id")).distinct()


def report(
    asked: DataFrame, responses: DataFrame, attempts: DataFrame, channel: str = V.DEFAULT_CHANNEL
) -> Reported:
    """Second phase: read answers, compose notifications, resolve delivery, write reports.

    Answers and attempts that carry the case id of their request are found by it, others by event id. Of several
    answers to a case the first counts, so a case has one report whatever the feeds repeat.
    """
    known, key = by_case(asked, responses)
    surplus = reports.surplus_responses(known, key)
    facts = asked.select(key, "source_job_id", "source_run_id", *({"event_id"} - {key}))
    if key == "event_id":
        # Runs of one second share their event id.
        facts = facts.dropDuplicates([key])
    return report_answers(reports.model_reports(asked, responses), attempts, answered_again(surplus.join(facts, key)), channel)


def answered_again(surplus: DataFrame) -> DataFrame:
    """Rejects for surplus answers that carry the ids of their case."""
    reason = F.concat(F.lit("answered again: "), F.col("n").cast("string"))
    return align(surplus.withColumn("reason", reason), REJECTS)


def report_answers(
    parsed: DataFrame, attempts: DataFrame, rejects: DataFrame, channel: str = V.DEFAULT_CHANNEL
) -> Reported:
    """Notifications, delivery and report rows of cases whose model report is parsed."""
    channel = channel.strip() or V.DEFAULT_CHANNEL
    # Three outputs read it; each would parse every answer again.
    fields = session.stage(reports.report_fields(parsed), "answers-read")
    resolved = notify.resolve_delivery(fields, attempts, channel)
    delivery = F.to_json(
        F.struct(
            F.col("slack_channel_id").alias("channel_id"),
            F.col("slack_error").alias("error"),
            F.col("slack_message_ts").alias("message_ts"),
            F.col("slack_notification_status").alias("status"),
        )
    )
    return Reported(
        reports=align(reports.report_rows(resolved), REPORTS),
        notifications=notify.notifications(fields, channel),
        evidence=resolved.select(
            *E.KEYS,
            F.lit(9).alias("ord"),
            F.lit("").alias("detail"),
            F.lit(V.SLACK_NOTIFICATION).alias("collector_name"),
            delivery.alias("evidence_json"),
        ),
        rejects=rejects,
    )


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """Rows of the evidence table."""
    return align(evidence.withColumn("created_at", iso_utc(F.col("event_ts"))), EVIDENCE)


def collected_frames(collected: Collected) -> dict[str, DataFrame]:
    """What the first phase adds to the output tables."""
    collected.keep_tables()
    return _aligned({
        "events": collected.events,
        "evidence": evidence_rows(collected.evidence),
        "prompt_requests": collected.requests,
        "rejects": collected.rejects,
    })


def reported_frames(reported: Reported) -> dict[str, DataFrame]:
    """What the second phase adds to the output tables."""
    return _aligned({
        "evidence": evidence_rows(reported.evidence),
        "reports": reported.reports,
        "notifications": reported.notifications,
        "rejects": reported.rejects,
    })


def output_frames(collected: Collected, reported: Reported) -> dict[str, DataFrame]:
    """All six output tables of a batch, in the columns of their schemas."""
    first, second = collected_frames(collected), reported_frames(reported)
    return {
        name: reduce(DataFrame.unionByName, [part[name] for part in (first, second) if name in part])
        for name in BATCH_TABLES
    }


def _aligned(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: align(frame, BATCH_TABLES[name]) for name, frame in frames.items()}


def write_tables(
    collected: Collected, reported: Reported, database: str, batch: str | int, *, replace: bool = False
) -> bool:
    """Write a batch to the six output tables, all or nothing; false when it was there already."""
    spark = collected.cases.sparkSession
    batches.ensure_batch_tables(spark, database)
    return batches.write_batch(output_frames(collected, reported), database, batch, replace=replace)
