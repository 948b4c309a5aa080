from datetime import date

import pytest
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import schemas as S
from faultlens.operators import health as H


def test_feed_status_keeps_absent_feeds(spark):
    feed = spark.createDataFrame(
        [("vendor_a", date(2026, 5, 30), 100), ("vendor_b", date(2026, 5, 31), 200)],
        "vendor_id string, feed_date date, row_count int",
    )
    expected = spark.createDataFrame([("vendor_a",), ("vendor_b",), ("vendor_c",)], "vendor_id string")
    as_of = F.lit("2026-05-31").cast("date")
    got = {r.vendor_id: r for r in H.feed_status(expected, feed, "vendor_id", "feed_date", as_of).collect()}
    assert (got["vendor_a"].rows_on_day, got["vendor_a"].lag_days) == (0, 1)
    assert got["vendor_a"].failure.startswith("feed vendor_a is empty on 2026-05-31; ")
    assert (got["vendor_b"].rows_on_day, got["vendor_b"].failure) == (1, None)
    assert (got["vendor_c"].rows_on_day, got["vendor_c"].newest_day, got["vendor_c"].lag_days) == (0, None, None)
    assert H.rows_on_day(feed, "feed_date", as_of).first().cnt == 1
    assert H.rows_on_day(feed, "feed_date", F.lit("2027-01-01").cast("date")).first().cnt == 0
    assert feed.where(H.recent(F.col("feed_date"), F.lit("2026-06-01").cast("date"))).count() == 1


def test_schema_drift(spark):
    # the transform asks for transaction_amount, the source has amount_usd
    expected = spark.createDataFrame(
        [("t", 1, "transaction_id", "string", None), ("t", 2, "transaction_amount", "double", None),
         ("t", 3, "day", "date", None), ("gone", 1, "x", "int", None)], S.TABLE_COLUMNS)
    actual = spark.createDataFrame(
        [("t", 1, "transaction_id", "string", None), ("t", 2, "amount_usd", "double", None),
         ("t", 3, "day", "string", None), ("other", 1, "y", "int", None)], S.TABLE_COLUMNS)
    got = {(r.table_name, r.col_name): r.drift for r in H.schema_drift(expected, actual).collect()}
    assert got == {
        ("t", "transaction_amount"): "missing", ("t", "amount_usd"): "added", ("t", "day"): "retyped", ("gone", "x"): "missing",
    }


def test_missing_tables(spark):
    refs = spark.createDataFrame([("a.b.c",), ("a.b.d",), ("a.b.d",)], "table_name string")
    catalog = spark.createDataFrame([("a.b.c",)], "table_name string")
    assert [tuple(r) for r in H.missing_tables(refs, catalog).collect()] == [("a.b.d", 2)]


def test_access(spark):
    probes = spark.createDataFrame(
        [("a.b.c", True, None), ("a.b.d", False, "no SELECT privilege"), ("a.b.e", False, "TABLE_OR_VIEW_NOT_FOUND")],
        S.TABLE_PROBE,
    )
    got = {r.table_name: (r.error_type, r.message) for r in H.access_failures(probes).collect()}
    assert set(got) == {"a.b.d", "a.b.e"}
    assert got["a.b.d"] == ("UNKNOWN", "probe of a.b.d failed: no SELECT privilege")
    assert got["a.b.e"][0] == "NOT_FOUND"


def test_families(values):
    texts = ["UNRESOLVED_COLUMN", "PERMISSION_DENIED on missing table not found", "OutOfMemoryError in shuffle", "hello",
             "SyntaxError", "init script failed", "upstream task failed", "HTTP 503 rate limit", "zoom"]
    got = values(H.failure_families, texts)
    assert [H_first(g) for g in got] == [
        "schema_drift", "permission", "resources", None, "syntax", "cluster", "upstream", "external_service", None,
    ]
    assert got[1] == ["permission", "missing_object"]
    assert values(lambda x: H.failure_family(H.failure_families(x)), ["hello"]) == ["other"]


def H_first(families):
    return families[0] if families else None


def test_cents(spark):
    rows = spark.createDataFrame([(18.45,), (None,)], "a double").select(H.cents(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [1845.0, None]


def test_rules_of_a_table(spark):
    own = spark.createDataFrame(
        [(15, "vendor", "vendor[ _]lib"), (1, "data_quality", "late"), (15, "vendor", "acme"), (900, "last", ".")], S.FAILURE_RULES
    )
    shipped = H.read_rules(H.shipped_rules(spark))
    assert [f for f, _ in shipped] == [f for f, _ in V.FAILURE_PATTERNS]
    rules = H.read_rules(H.shipped_rules(spark).unionByName(own))
    assert [f for f, _ in rules][:3] == ["data_quality", "schema_drift", "vendor"]
    texts = ["No module named VENDOR_lib", "ACME is late", "found 0", "x", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in frame.select("i", H.failure_families(F.col("t"), rules).alias("f")).collect()}
    assert got == {0: ["vendor", "dependency", "last"], 1: ["data_quality", "vendor", "last"], 2: ["data_quality", "last"], 3: ["last"], 4: [], 5: None}
    assert frame.select(H.failure_families(F.col("t"), []).alias("f")).first().f == []
    with pytest.raises(ValueError, match="family bad"):
        H.read_rules(spark.createDataFrame([(1, "bad", "(")], S.FAILURE_RULES))
    with pytest.raises(ValueError, match="at most"):
        H.read_rules(spark.range(501).select(F.lit(1).alias("priority"), F.lit("f").alias("family"), F.lit("x").alias("pattern")))
