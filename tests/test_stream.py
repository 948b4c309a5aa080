import json
import time
import uuid
from collections import Counter
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import failures
from faultlens.plans import analysis, catalog
from faultlens.sinks import batches
from faultlens.sources import samples
from faultlens.streaming import answers, failed_runs

FOLDER = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    stream = catalog.QUERIES["stream_failed_runs"](spark, FOLDER)
    runs = failures.qualifying_runs(samples.event_runs(samples.load(spark, FOLDER, "events")))
    batch = failures.heads(runs).select(*stream.columns)
    assert stream.count() > 0
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = failed_runs.batch_writer(str(tmp_path), lambda df: df)
    frame = spark.range(5)
    write(frame, 0)
    write(frame, 1)
    write(frame, 0)
    counts = {r.batch_id: r["count"] for r in spark.read.parquet(str(tmp_path)).groupBy("batch_id").count().collect()}
    assert counts == {0: 5, 1: 5}


def test_only_new_files_are_analysed(spark, tmp_path):
    events = samples.load(spark, FOLDER, "events")
    seen = []

    def note(batch, batch_id):
        seen.append(batch.count())

    def run():
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        failed_runs.on_failures(samples.event_runs(stream), note, f"{tmp_path}/checkpoint").awaitTermination()

    errors = F.col("event_type") == "error"
    events.where(errors).write.parquet(f"{tmp_path}/in")
    run()
    first = sum(seen)
    run()
    assert sum(seen) == first > 0
    later = events.where(errors).withColumn("event_id", F.col("event_id") + 10_000_000)
    later.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sum(seen) == 2 * first


def arrive(spark, tmp_path, runs, name="in"):
    runs.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_runs_without_a_key_stay_apart(spark, tmp_path):
    from tests.test_pipeline import inputs

    runs = inputs(spark).runs
    nameless = runs.where("run_id is null")
    both = runs.unionByName(nameless.withColumn("run_name", F.lit("other"))).unionByName(nameless)
    seen = []
    stream = failed_runs.distinct_heads(arrive(spark, tmp_path, both), "1 day")
    note = lambda batch, _: seen.extend(r.run_name for r in batch.where("run_id is null").collect())
    failed_runs.on_batches(stream, note, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(seen) == ["no id", "other"]


def test_state_of_distinct_runs_is_bounded(spark, tmp_path):
    """Keys are forgotten after the horizon; what comes again within it is dropped, however old its event time."""
    from tests.test_pipeline import inputs

    one = inputs(spark).runs.where("run_id = 1")
    seen, rows = [], []

    def run(number):
        runs = spark.range(20).crossJoin(one.drop("run_id")).select(
            (F.lit(100 * number) + F.col("id")).alias("run_id"), *[c for c in one.columns if c != "run_id"]
        )
        old = one.withColumn("event_ts", F.lit("1999-01-01").cast("timestamp"))
        stream = failed_runs.distinct_heads(arrive(spark, tmp_path, runs.unionByName(old).unionByName(runs)), "1 second")
        query = failed_runs.on_batches(stream, lambda b, _: seen.extend(b.select("run_id").collect()), f"{tmp_path}/checkpoint")
        query.awaitTermination()
        rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(1.5)

    for number in range(1, 5):
        run(number)
    assert len({r.run_id for r in seen}) == 81 and max(rows) <= 2 * 21
    assert len(seen) <= 84  # each key once, the old run once for each horizon that passed


def database():
    return "s" + uuid.uuid4().hex[:8]


def test_each_batch_is_analysed_in_full(spark, tmp_path):
    from tests.test_pipeline import inputs

    known, db = inputs(spark), database()
    write = failed_runs.analysis_writer(known, db, f"{tmp_path}/asked", "p", "a")
    stream = arrive(spark, tmp_path, known.runs.where("run_id is not null"))
    failed_runs.on_failures(stream, write, f"{tmp_path}/checkpoint").awaitTermination()
    counted = lambda: {n: batches.committed(spark, db, n).count() for n in ("events", "evidence", "prompt_requests", "rejects")}
    whole = {"events": 3, "evidence": 17 + 7 + 7 + 1, "prompt_requests": 3, "rejects": 0}
    assert counted() == whole
    # A replayed micro-batch that was committed changes nothing.
    write(failures.qualifying_runs(known.runs), 0)
    assert counted() == whole and spark.read.parquet(f"{tmp_path}/asked").count() == 3


def test_repeats_in_any_batch_are_rejects_as_in_a_batch_table(spark, tmp_path):
    from tests.test_pipeline import inputs

    known, db = inputs(spark), database()
    one, two = known.runs.where("run_id = 1"), known.runs.where("run_id = 2")
    arrivals = [one.unionByName(two).unionByName(one), two, known.runs.where("run_id = 4").unionByName(one).unionByName(one)]
    write = failed_runs.analysis_writer(known, db, f"{tmp_path}/asked", "p", "a")
    for part in arrivals:
        stream = arrive(spark, tmp_path, part)
        query = failed_runs.on_failures(stream, write, f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert not query.lastProgress or not query.lastProgress["stateOperators"]
    every = arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2])
    batch = analysis.collect(replace(known, runs=every), "p", "a")
    for name, frame in analysis.collected_frames(batch).items():
        if name != "rejects":
            got = batches.committed(spark, db, name).select(*frame.columns).collect()
            assert sorted(map(str, got)) == sorted(map(str, frame.collect()))

    def surplus(rows):
        total = Counter()
        for r in rows:
            total[r.source_run_id, r.event_id, r.digest] += int(r.reason.removeprefix("delivered again: "))
        return total

    told = surplus(batches.committed(spark, db, "rejects").collect())
    assert told == surplus(batch.rejects.collect()) and sorted(told.values()) == [1, 3]


def test_the_lookup_of_stored_events_reads_the_time_of_the_batch(spark, tmp_path):
    from tests.test_pipeline import inputs

    runs = inputs(spark).runs
    events = spark.createDataFrame(
        [("7", "1", "2024-01-01T00:00:07+00:00"), ("7", "1", "2024-01-01T00:00:07.250000+00:00"), ("7", "1", "2023-12-31T23:59:59+00:00"),
         ("7", "2", "2024-01-01T00:00:08+00:00")],
        "source_job_id string, source_run_id string, created_at string",
    )
    events.write.parquet(f"{tmp_path}/events")
    found = analysis.known_cases(spark.read.parquet(f"{tmp_path}/events"), runs)
    assert sorted(r.case_id for r in found.collect()) == ["7:1:1704067207000000", "7:1:1704067207250000"]
    assert "GreaterThanOrEqual(created_at" in found._jdf.queryExecution().executedPlan().toString()
    assert analysis.known_cases(spark.read.parquet(f"{tmp_path}/events"), runs.limit(0)).count() == 0


def test_late_and_repeated_answers(spark, tmp_path):
    """An answer in time counts, the first of two; without one in time the report says so, and stays."""
    from tests.test_pipeline import inputs

    known, db = inputs(spark), database()
    asked = analysis.collect(known, "p", "a").asked.withColumn("asked_at", F.col("event_ts"))
    ids = {r.source_run_id: r.case_id for r in asked.collect()}
    start = asked.first().asked_at
    schema = "case_id string, answered_at timestamp, predictions array<string>, error string"
    nothing = {"choices": F.lit(None).cast(S.MODEL_RESPONSES["choices"].dataType), "outputs": F.lit(None).cast("array<string>")}

    def answer(*rows):
        return spark.createDataFrame(
            [(ids[run], start + timedelta(minutes=at), [said], None) for run, at, said in rows], schema
        ).withColumns(nothing)

    attempts = spark.createDataFrame([], S.DELIVERY_ATTEMPTS)
    write = answers.report_writer(attempts, db)

    def run(requests, responses, minute):
        over = start + timedelta(minutes=minute)
        asked_feed = arrive(spark, tmp_path, requests.unionByName(answers.tick(asked, "asked_at", over)), "asked")
        given = arrive(spark, tmp_path, responses.unionByName(answers.tick(responses, "answered_at", over)), "given")
        stream = answers.awaited(asked_feed, given, patience="30 minutes", lateness="5 minutes")
        failed_runs.on_batches(stream, write, f"{tmp_path}/checkpoint").awaitTermination()
        return {r.source_run_id: r for r in batches.committed(spark, db, "reports").collect()}

    said = lambda row: json.loads(row.report_json).get("summary")
    got = run(asked, answer(("1", 3, "second"), ("1", 2, "first"), ("4", -1, "before it was asked")), 10)
    assert {run: said(r) for run, r in got.items()} == {"1": "first"}
    # Run 2 is still waiting; its answer comes, and run 1 is answered again. Nobody answers run 4.
    got = run(asked.limit(0), answer(("2", 25, "just in time"), ("1", 26, "third")), 32)
    assert said(got["1"]) == "first" and said(got["2"]) == "just in time" and "4" not in got
    got = run(asked.limit(0), answer(), 60)
    assert set(got) == {"1", "2", "4"} and got["4"].error_type == "MODEL_CALL_FAILED"
    got = run(asked.limit(0), answer(("4", 31, "too late"), ("4", 70, "far too late")), 90)
    assert set(got) == {"1", "2", "4"} and got["4"].error_type == "MODEL_CALL_FAILED"
    rejects = sorted((r.source_run_id, r.reason) for r in batches.committed(spark, db, "rejects").collect())
    assert rejects == [("1", "answered again: 1")] * 2
    assert batches.committed(spark, db, "notifications").count() == 3
    # What the join keeps is gone once its time is over.
    state = [json.loads(p.read_text().splitlines()[-1]) for p in (tmp_path / "checkpoint" / "commits").glob("[0-9]*")]
    assert state


def test_streamed_reports_equal_the_batch(spark):
    streamed = catalog.QUERIES["stream_reports"](spark, FOLDER)
    batch = catalog.QUERIES["analysis_reports"](spark, FOLDER)
    assert streamed.count() > 0
    assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
