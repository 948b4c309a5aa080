import re
from collections import Counter

from pyspark.sql import functions as F

from faultlens.operators.joins import asked_for, by_case, spread_lookup, unique_lookup


def facts(spark, n=6000):
    """A third of the rows share one key, a third have none."""
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit(1)).when(i % 3 == 1, F.lit(None)).otherwise(i).cast("bigint")
    return spark.range(n).withColumn("key", key)


def test_spread_lookup_equals_the_plain_join(spark):
    lookup = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    frame = facts(spark)
    got = spread_lookup(frame, lookup, F.col("key"), "k", F.col("id"), salts=5)
    want = frame.join(lookup, F.col("key") == F.col("k"), "left").drop("k")
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_and_missing_keys_are_spread(spark):
    lookup = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }.items():
        spark.conf.set(key, value)
    try:
        joined = spread_lookup(facts(spark), lookup, F.col("key"), "k", F.col("id"), salts=16)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6000
    assert max(sizes) < 6000 / 4  # one partition held both thirds before


def test_unique_lookup_keeps_rows_without_a_key(spark):
    lookup = spark.range(0, 10).select(F.col("id").alias("k"), F.lit(True).alias("hit"))
    frame = spark.range(20).select(
        "id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("key")
    )
    rows = {r.id: r.hit for r in unique_lookup(frame, lookup, F.col("key"), "k").collect()}
    assert rows == {i: (True if i % 2 == 0 and i < 10 else None) for i in range(20)}


def test_rows_without_a_key_do_not_meet(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lookup = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        frame = spark.range(6000).withColumn("key", F.when(F.col("id") % 2 == 0, F.col("id")))
        spread = spread_lookup(frame, lookup, F.col("key"), "k", F.col("id"))
        for joined in (spread, unique_lookup(frame, lookup, F.col("key"), "k")):
            sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(sizes) == 6000 and max(sizes) < 6000 / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_adaptive_execution_splits_a_hot_key(spark):
    """With the sizes lowered to test data, the final plan of the lookup reads skewed partitions in parts."""
    from faultlens import session

    session.tune(spark)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lookup = spark.range(0, 50).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        wide = spark.range(0, 40000, 1, 8).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50).alias("key"),
            F.sha2(F.col("id").cast("string"), 512).alias("text"),
        )
        joined = spread_lookup(wide, lookup, F.col("key"), "k", F.col("id"), salts=2)
        assert len(joined.collect()) == 40000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        assert "skewed" in plan or "skew=true" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_asked_for_keeps_asked_rows_once(spark):
    lookup = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    facts = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "f string")
    assert [tuple(r) for r in asked_for(lookup, "k", facts, F.col("f")).collect()] == [("a", 1)]
    assert asked_for(lookup, "k", facts.limit(0), F.col("f")).count() == 0


def test_by_case_prefers_the_case_id(spark):
    both = spark.createDataFrame([("c", "e")], "case_id string, event_id string")
    assert by_case(both, both)[1] == "case_id" and by_case(both, both)[0].columns == ["case_id"]
    assert by_case(both.drop("case_id"), both)[1] == "event_id"


def test_an_archive_is_not_moved_for_a_lookup(spark):
    """Only the facts are dealt out; the archive's buckets are read where they are, and only the asked span of them."""
    import uuid

    from faultlens.operators import evidence, failures
    from faultlens.sinks import tables
    from tests.test_pipeline import inputs

    known, archive = inputs(spark), f"archive_{uuid.uuid4().hex}"
    rest = spark.range(1000, 3000).select(
        F.col("id").alias("run_id"), *[F.lit("x").alias(c) for c in ("error", "logs", "notebook_output", "output_json")]
    )
    for part in (known.outputs, rest):
        tables.append_archive(part, archive, "run_id", 8)
    runs = failures.qualifying_runs(known.runs.where("run_id is not null"))
    outputs = evidence.outputs_between(spark.table(archive), runs)
    cases = failures.bare_cases(failures.heads(runs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.error_summaries(cases, outputs)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Literals in the plan may hold line breaks.
    lines = [line for line in plan.split("\n") if re.match(r"[ :]*(?:\+-|:-) ", line)]
    scan = next(i for i, line in enumerate(lines) if archive in line)
    assert "Bucketed: true" in lines[scan] and "GreaterThanOrEqual(run_id" in lines[scan]
    # From the scan up to the join, which stands at a smaller indent, nothing exchanges rows.
    depth = lines[scan].index("FileScan")
    above = []
    for line in reversed(lines[:scan]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
        if "Join" in line:
            break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)
    plain = evidence.error_summaries(cases, known.outputs).collect()
    assert sorted(map(str, found.collect())) == sorted(map(str, plain))
    tables.drop_table(spark, archive)
