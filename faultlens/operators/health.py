"""Checks on tables and feeds, and families of failure texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.operators.failures import classify_error
from faultlens.schemas import FAILURE_RULES


def on_day(date: Column, as_of: Column) -> Column:
    return date == as_of


def recent(date: Column, as_of: Column, days: int = 1) -> Column:
    """The last ``days`` days and today."""
    return date >= F.date_sub(as_of, days)


def cents(amount: Column) -> Column:
    return amount * 100


def rows_on_day(feed: DataFrame, date: str, as_of: Column) -> DataFrame:
    """Number of rows of a feed on one day; the filter reaches the scan."""
    return feed.where(on_day(F.col(date), as_of)).agg(F.count("*").alias("cnt"))


def feed_status(expected: DataFrame, feed: DataFrame, key: str, date: str, as_of: Column) -> DataFrame:
    """Rows on the day, newest day and lag of every expected feed; absent feeds count zero."""
    seen = feed.groupBy(key).agg(
        F.count_if(on_day(F.col(date), as_of)).alias("rows_on_day"), F.max(date).alias("newest_day")
    )
    rows = F.coalesce("rows_on_day", F.lit(0).cast("bigint"))
    status = expected.join(seen, key, "left").withColumn("rows_on_day", rows)
    message = F.concat(
        F.lit("feed "), F.col(key).cast("string"), F.lit(" is empty on "), as_of.cast("string"),
        F.coalesce(F.concat(F.lit("; its last rows are of "), F.col("newest_day").cast("string")), F.lit("; it never had rows")),
    )
    return status.select(
        key,
        "rows_on_day",
        "newest_day",
        F.date_diff(as_of, F.col("newest_day")).alias("lag_days"),
        F.when(F.col("rows_on_day") == 0, message).alias("failure"),
    )


def schema_drift(expected: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns missing from, added to or retyped in the tables that are expected to have them.

    Both sides hold one row per (table_name, col_name).
    """
    watched = expected.select("table_name").distinct()
    actual = columns.join(watched, "table_name", "left_semi").select(
        "table_name", "col_name", F.col("data_type").alias("actual_type")
    )
    both = expected.select("table_name", "col_name", F.col("data_type").alias("expected_type")).join(
        actual, ["table_name", "col_name"], "full_outer"
    )
    drift = (
        F.when(F.col("actual_type").isNull(), "missing")
        .when(F.col("expected_type").isNull(), "added")
        .when(F.col("actual_type") != F.col("expected_type"), "retyped")
    )
    return both.withColumn("drift", drift).where(F.col("drift").isNotNull())


def missing_tables(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References without a table; repeated references are merged before the join."""
    counted = refs.groupBy("table_name").agg(F.count("*").alias("mentions"))
    return counted.join(catalog.select("table_name").distinct(), "table_name", "left_anti")


# More rules than this are no rule table but a lookup, and belong into a join.
MOST_RULES = 500


def shipped_rules(spark: SparkSession) -> DataFrame:
    """The failure families that come with the package, as rows of a rule table that users extend."""
    rows = [(10 * i, family, pattern) for i, (family, pattern) in enumerate(V.FAILURE_PATTERNS, start=1)]
    return spark.createDataFrame(rows, FAILURE_RULES)


def read_rules(rules: DataFrame) -> list[tuple[str, str]]:
    """(family, pattern) of a rule table by priority, then family and pattern; the patterns of a family become one.

    The table is read by the driver, which is why its size is checked; a pattern that Java can't read is refused here
    and not in a task.
    """
    rows = rules.select("priority", "family", "pattern").orderBy("priority", "family", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rows")
    merged: dict[str, list[str]] = {}
    for row in rows:
        merged.setdefault(row["family"], []).append(f"(?:{row['pattern']})")
    out = [(family, "|".join(patterns)) for family, patterns in merged.items()]
    for family, pattern in out:
        try:
            rules.sparkSession.range(1).select(F.lit("").rlike(f"(?i){pattern}")).collect()
        except Exception as failure:
            raise ValueError(f"the pattern of family {family} can't be read: {pattern}") from failure
    return out


def failure_families(text: Column, rules: list[tuple[str, str]] = V.FAILURE_PATTERNS) -> Column:
    """Every family whose expression matches the text, in order of precedence.

    One expression over all rules is tried first: a text without any marker is read once, and the single rules only
    look at texts that have one.
    """
    if not rules:
        return F.array().cast("array<string>")
    marked = text.rlike("(?i)" + "|".join(f"(?:{pattern})" for _, pattern in rules))
    each = F.array(*[F.when(text.rlike(f"(?i){pattern}"), F.lit(family)) for family, pattern in rules])
    nothing = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(marked, F.array_compact(each)).otherwise(nothing)


def failure_family(families: Column) -> Column:
    """The family that comes first, or the one for texts that match none."""
    return F.coalesce(F.get(families, 0), F.lit(V.OTHER_FAMILY))


def access_failures(probes: DataFrame, rules: list[tuple[str, str]] = V.FAILURE_PATTERNS) -> DataFrame:
    """Failed table probes with their error class and family."""
    none = F.lit(None).cast("string")
    message = F.concat(
        F.lit("probe of "), F.col("table_name"), F.lit(" failed: "), F.coalesce("error_text", F.lit("")),
    )
    return probes.where(~F.col("ok")).select(
        "table_name",
        message.alias("message"),
        classify_error(message, none, none).alias("error_type"),
        failure_family(failure_families(F.coalesce("error_text", F.lit("")), rules)).alias("family"),
    )
