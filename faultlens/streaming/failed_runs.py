"""Failed runs as they arrive: each micro-batch is analysed like a batch table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlens import session
from faultlens.operators import evidence
from faultlens.operators.failures import heads, qualifying_runs, with_document
from faultlens.plans import analysis
from faultlens.sinks import batches

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of later streams goes into Spark's RocksDB store, unless the session names a store itself."""
    if spark.conf.get(STATE_STORE, None) is None:
        spark.conf.set(STATE_STORE, ROCKSDB)


def qualifying_stream(runs: DataFrame) -> DataFrame:
    """Stream of runs with a failed task, every delivery of them; keeps no state.

    Which deliveries repeat others is told by the consumer from what it has stored, however long ago that was.
    """
    return with_document(qualifying_runs(runs))


def distinct_heads(runs: DataFrame, horizon: str) -> DataFrame:
    """Stream of narrow rows of failed runs, each once within ``horizon`` (such as ``"7 days"``) of its arrival.

    For consumers that store nothing to compare with. A run that is delivered again is known by its job, run and
    event time; runs without a job or run id are told apart by their text. The watermark is on the time of arrival, so
    no run is dropped for being late, and the state forgets a key once the horizon has passed: it is bounded by the
    failed runs that arrive in that time. Texts aren't kept, and are read for runs without keys only.
    """
    failed = qualifying_stream(runs)
    keyless = F.col("job_id").isNull() | F.col("run_id").isNull()
    told_apart = F.when(keyless, F.xxhash64("document")).otherwise(F.lit(0).cast("bigint"))
    narrow = heads(failed.withColumn("_other", told_apart)).withColumn("_arrived", F.current_timestamp())
    once = narrow.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["job_id", "run_id", "event_ts", "_other"])
    return once.drop("_other", "_arrived")


def on_batches(
    stream: DataFrame, analyse: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Call ``analyse(batch, batch_id)`` for every micro-batch."""
    writer = stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def on_failures(
    runs: DataFrame,
    analyse: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Call ``analyse(batch, batch_id)`` for every micro-batch of qualifying runs."""
    return on_batches(qualifying_stream(runs), analyse, checkpoint, available_now)


def batch_writer(folder: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder; a replayed batch replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def batch_name(phase: str, batch_id: int) -> str:
    """Name of a micro-batch among the committed batches; the phases share the tables."""
    return f"{phase}-{batch_id:012d}"


def analysis_writer(inputs: analysis.Inputs, database: str, feed: str, *prompt: str) -> Callable[[DataFrame, int], None]:
    """Run the first phase of the analysis on each batch; ``inputs.runs`` is replaced by the batch.

    Events, evidence, requests and rejects go to the batch's partitions of the tables in ``database``, and the cases
    that are asked to a folder of the batch below ``feed``, from which the second phase is streamed. A run whose event is stored, from
    whichever batch, isn't analysed again; its delivery is a reject, as in a batch table. A replayed batch that was
    committed is left alone; one that broke off is written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The stream's own session, not the caller's.
        spark = batch.sparkSession
        name = batch_name("runs", batch_id)
        batches.ensure_batch_tables(spark, database)
        if batches.is_committed(spark, database, name):
            return
        # The batch is read for each output: once from the source, then from its copy.
        runs = session.stage(batch, "arrived")
        stored = analysis.known_cases(batches.committed(spark, database, "events"), runs)
        outputs = evidence.outputs_between(inputs.outputs, runs)
        collected = analysis.collect(replace(inputs, runs=runs, outputs=outputs), *prompt, stored=stored)
        collected.asked.withColumn("asked_at", F.col("event_ts")).write.mode("overwrite").parquet(f"{feed}/batch={name}")
        batches.write_batch(analysis.collected_frames(collected), database, name)

    return write
