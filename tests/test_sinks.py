import uuid

import pytest
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import schemas as S
from faultlens.sinks import batches
from faultlens.sinks import tables as K
from faultlens.sources import readers


def database():
    return "d" + uuid.uuid4().hex[:8]


def test_tables_are_created_once_and_appended_by_name(spark):
    db = database()
    K.ensure_tables(spark, db)
    K.ensure_tables(spark, db)
    events = spark.createDataFrame([("x'; drop", "e1")], "created_at string, event_id string")
    K.append_table(events, f"{db}.events")
    K.append_table(events.withColumn("extra", F.lit(1)), f"{db}.events")
    rows = spark.table(f"{db}.events").collect()
    assert [(r.event_id, r.created_at, r.payload_json) for r in rows] == [("e1", "x'; drop", None)] * 2
    assert spark.table(f"{db}.reports").columns == S.REPORTS.fieldNames()
    assert set(t for _, t in spark.table(f"{db}.prompts").dtypes) == {"string"}


def test_seed_is_appended_once(spark):
    db = database()
    K.ensure_tables(spark, db)
    for _ in range(3):
        K.seed_default_prompt(spark, f"{db}.prompts")
    rows = spark.table(f"{db}.prompts").collect()
    assert [(r.prompt_name, r.prompt_version, r.temperature) for r in rows] == [(V.DEFAULT_PROMPT_NAME, "2", "0.1")]
    assert not spark.table(f"{db}.prompts").isEmpty()


def test_replace_drop_and_probe(spark):
    db = database()
    spark.sql(f"CREATE DATABASE {db}")
    frame = spark.createDataFrame([("txn", 18.45, "2026-05-30")], "id string, amount_usd double, day string")
    for n in (1, 2):
        K.replace_table(frame.withColumn("n", F.lit(n)), f"{db}.t")
    assert [r.n for r in spark.table(f"{db}.t").collect()] == [2]
    assert readers.probe_table(spark, f"{db}.t").first().ok
    columns = {r.col_name: r.data_type for r in readers.catalog_columns(spark, db).collect()}
    assert columns == {"id": "string", "amount_usd": "double", "day": "string", "n": "int"}
    K.drop_table(spark, f"{db}.t")
    K.drop_table(spark, f"{db}.t")
    failed = readers.probe_table(spark, f"{db}.t").first()
    assert not failed.ok and "TABLE_OR_VIEW_NOT_FOUND" in failed.error_text


def test_folder_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("e", "r")], "event_id string, report_json string")
    K.append_path(frame, S.REPORTS, f"{tmp_path}/r")
    K.append_path(frame, S.REPORTS, f"{tmp_path}/r")
    assert K.read_path(spark, S.REPORTS, f"{tmp_path}/r").count() == 2
    K.replace_path(frame, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 1


def content(spark, db):
    return {
        name: sorted(map(str, batches.committed(spark, db, name).collect())) for name in S.BATCH_TABLES
    }


def batch_frames(spark, *ids):
    events = spark.createDataFrame([(f"e{i}", f"t{i}") for i in ids], "event_id string, created_at string")
    rejects = spark.createDataFrame([(f"e{i}", "why") for i in ids if i % 2], "event_id string, reason string")
    return {"events": events, "rejects": rejects, "reports": events.select("event_id")}


def test_a_batch_is_written_once_however_often_it_is_tried(spark):
    db = database()
    batches.ensure_batch_tables(spark, db)
    batches.ensure_batch_tables(spark, db)
    assert batches.write_batch(batch_frames(spark, 1, 2), db, 0)
    before = content(spark, db)
    assert len(before["events"]) == 2 and len(before["rejects"]) == 1
    assert not batches.write_batch(batch_frames(spark, 1, 2), db, 0)
    assert not batches.write_batch(batch_frames(spark, 8, 9), db, 0)
    assert content(spark, db) == before
    assert batches.write_batch(batch_frames(spark, 3), db, 1)
    counts = {(r.batch_id, r.table_name): r.n_rows for r in batches.batches(spark, db).collect()}
    assert counts[("0", "events")] == 2 and counts[("1", "rejects")] == 1 and len(counts) == 6


def test_a_batch_that_broke_off_is_not_seen_and_leaves_nothing(spark):
    db = database()
    batches.ensure_batch_tables(spark, db)
    batches.write_batch(batch_frames(spark, 1), db, "a")
    whole = content(spark, db)
    broken = batch_frames(spark, 5, 7)
    batches.begin_batch({name: broken[name] for name in ("events", "rejects")}, db, "b")
    assert content(spark, db) == whole and spark.table(f"{db}.events").count() == 3
    # The second try has other rows, and none at all for the rejects.
    assert batches.write_batch(batch_frames(spark, 6), db, "b")
    assert spark.table(f"{db}.rejects").where("batch_id = 'b'").count() == 0
    assert [r.event_id for r in spark.table(f"{db}.events").where("batch_id = 'b'").collect()] == ["e6"]


def test_a_batch_may_be_replaced(spark):
    db = database()
    batches.ensure_batch_tables(spark, db)
    batches.write_batch(batch_frames(spark, 1, 3), db, 0)
    batches.write_batch(batch_frames(spark, 5), db, 1)
    assert batches.write_batch(batch_frames(spark, 2), db, 0, replace=True)
    assert sorted(r.event_id for r in batches.committed(spark, db, "events").collect()) == ["e2", "e5"]
    assert [r.event_id for r in batches.committed(spark, db, "rejects").collect()] == ["e5"]
    with pytest.raises(ValueError):
        batches.write_batch(batch_frames(spark, 2), db, "x' OR '1")


def test_committed_batches_prune_partitions(spark):
    db = database()
    batches.ensure_batch_tables(spark, db)
    for i in range(3):
        batches.write_batch(batch_frames(spark, i), db, i)
    one = spark.table(f"{db}.events").where("batch_id = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in one


def test_source_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes(b"x = '\xff'\n")
    row = readers.source_files(spark, str(tmp_path)).first()
    assert row.path.endswith("sub/a.py") and row.source == "x = '�'\n"


def test_typed(spark):
    frame = spark.createDataFrame([(1, "t", 5)], "run_id int, error string, other int").select(
        "*", *[F.lit(None).cast("string").alias(n) for n in ("logs", "notebook_output", "output_json")]
    )
    assert readers.typed(frame, S.RUN_OUTPUTS).dtypes[0] == ("run_id", "bigint")


def test_details_from_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/a")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.range(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
    found = readers.table_files(spark, {"x.y.a": f"{tmp_path}/a", "x.y.b": f"{tmp_path}/b"})
    rows = {r.table_name: r for r in found.collect()}
    assert (rows["x.y.a"].num_files, rows["x.y.a"].num_rows, rows["x.y.b"].num_files, rows["x.y.b"].num_rows) == (4, 100, 2, 10)
    sizes = sum(p.stat().st_size for p in (tmp_path / "b").glob("part-*"))
    assert rows["x.y.b"].size_in_bytes == sizes and rows["x.y.b"].last_modified.endswith("+00:00")
    assert "ReadSchema: struct<>" in found._jdf.queryExecution().executedPlan().toString()
    # They serve as the detail snapshot of an analysis.
    from faultlens.operators import evidence

    nothing = [spark.createDataFrame([], schema) for schema in (S.TABLE_COLUMNS, S.TABLE_HISTORY)]
    told = evidence.table_documents(*nothing, found).where("table_name = 'x.y.b'").first()
    assert '"num_files":2' in told.table_json and '"num_rows":10' in told.table_json
