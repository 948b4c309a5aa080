"""The second phase as a stream: requests meet their answers, or their time runs out.

Requests and responses are two streams with a watermark each. They are joined by case and time: an answer counts that
comes after its request and within ``patience``. Each side's state is dropped as soon as the watermarks show that
nothing can match it any more. At that moment a request without an answer leaves the join alone and gets the
call-failed report. An answer that comes later changes nothing.

Watermarks only move when rows arrive. ``tick`` adds a row without a case to a feed, which tells the join that time
has passed although nobody asked or answered; such rows go no further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import session
from faultlens.operators import reports
from faultlens.plans import analysis
from faultlens.sinks import batches
from faultlens.streaming.failed_runs import batch_name


def awaited(asked: DataFrame, responses: DataFrame, patience: str, lateness: str) -> DataFrame:
    """Stream of cases with their response, or without one after ``patience``.

    ``asked`` are the cases of the first phase with ``asked_at``; ``responses`` have ``case_id`` and ``answered_at``. Both
    times are intervals such as ``"30 minutes"``; rows that come later than ``lateness`` behind their own feed are not seen.
    """
    requests = asked.withWatermark("asked_at", lateness)
    given = responses.select(
        F.col("case_id").alias("_case"), "answered_at", *reports.ANSWER, F.lit(True).alias("answered")
    ).withWatermark("answered_at", lateness)
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (
        F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {patience}")
    )
    return requests.join(given, (F.col("case_id") == F.col("_case")) & in_time, "leftOuter").drop("_case")


def tick(feed: DataFrame, time_column: str, moment) -> DataFrame:
    """One row in the columns of a feed that holds a time, and an empty case id, which no case has.

    A null one would not do: Spark drops rows that can't join before it looks at their time.
    """
    known = {time_column: F.lit(moment), "case_id": F.lit("")}
    values = [known.get(f.name, F.lit(None)) for f in feed.schema.fields]
    columns = [value.cast(f.dataType).alias(f.name) for value, f in zip(values, feed.schema.fields, strict=True)]
    return feed.sparkSession.range(1).select(*columns)


def report_writer(
    attempts: DataFrame, database: str, channel: str = V.DEFAULT_CHANNEL
) -> Callable[[DataFrame, int], None]:
    """Write reports, notifications, delivery evidence and rejects of each batch of ``awaited``.

    A case has one report: of several answers in a batch the first counts, and a case that was reported in an earlier
    batch isn't reported again. What is surplus goes to the rejects. Repeated batches are handled as in the first phase.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = batch_name("answers", batch_id)
        batches.ensure_batch_tables(spark, database)
        if batches.is_committed(spark, database, name):
            return
        arrived = session.stage(batch.where("case_id <> ''"), "answers")
        if arrived.isEmpty():
            return
        ids = arrived.select("case_id").distinct()
        told = batches.committed(spark, database, "notifications").select("case_id")
        reported = session.stage(ids.join(told, "case_id", "left_semi"), "reported")

        responses = arrived.where("answered").select("case_id", "answered_at", *reports.ANSWER)
        facts = [c for c in arrived.columns if c not in ("answered_at", "asked_at", "answered", *reports.ANSWER)]
        # A request that was read twice, after a batch of the first phase broke off, is one case.
        cases = arrived.select(*facts).dropDuplicates(["case_id"])
        fresh = cases.join(reported, "case_id", "left_anti")
        again = reports.surplus_responses(responses, "case_id", known=reported)
        rejects = analysis.answered_again(again.join(cases, "case_id"))
        parsed = reports.model_reports(fresh, responses)
        out = analysis.report_answers(parsed, attempts, rejects, channel)
        batches.write_batch(analysis.reported_frames(out), database, name)

    return write
