"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keyless_apart(facts: DataFrame, lookup: DataFrame, fact_key: Column, lookup_key: str, spread_by: Column):
    """Both sides with ``_key`` and a second join column that deals out the facts without a key.

    On the lookup side the column is 0 but computed from the key: a literal would be folded into a
    filter, the rows would be dealt by the key alone, and those without one would meet.
    """
    left = facts.withColumn("_key", fact_key).withColumn(
        "_gap", F.when(F.col("_key").isNull(), F.xxhash64(spread_by)).otherwise(F.lit(0).cast("bigint"))
    )
    right = lookup.withColumnRenamed(lookup_key, "_key").withColumn("_gap", F.pmod(F.xxhash64("_key"), F.lit(1)))
    return left, right


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    fact_key: Column,
    lookup_key: str,
    spread_by: Column,
    salts: int = 1,
) -> DataFrame:
    """Left join of ``facts`` to a ``lookup`` with one row per key, safe for hot and missing keys.

    A hot key is split by adaptive execution, which sees the sizes. A caller that has measured one and
    runs without adaptive execution may set ``salts``: rows of one key then go to that many partitions
    and the lookup is repeated as often. Rows without a key match nothing and are spread over all
    partitions. No side is forced to be broadcast.

    The lookup's key column is dropped; ``fact_key`` may be any expression over ``facts``.
    """
    left, right = _keyless_apart(facts, lookup, fact_key, lookup_key, spread_by)
    keys = ["_key", "_gap"]
    if salts > 1:
        keys = [*keys, "_salt"]
        left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
        every = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
        right = right.withColumn("_salt", F.explode(every))
    return left.join(right, keys, "left").drop(*keys)


def asked_for(lookup: DataFrame, key: str, facts: DataFrame, fact_key: Column) -> DataFrame:
    """Rows of a ``lookup`` that some fact asks for; work on its texts is then done for no others.

    The keys are made distinct before they move. Where they are few, as for a batch of new runs
    against a whole archive, Spark sees their size and filters the lookup where it is read.
    """
    wanted = facts.select(fact_key.alias("_wanted")).where("_wanted is not null").distinct()
    return lookup.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def by_case(cases: DataFrame, known: DataFrame) -> tuple[DataFrame, str]:
    """What a service returned and the key it is looked up by, the other key dropped.

    The case id is the key where both sides have it, else the event id, which runs of one second share.
    """
    if "case_id" in cases.columns and "case_id" in known.columns:
        return known.drop("event_id"), "case_id"
    return known.drop("case_id"), "event_id"


def unique_lookup(facts: DataFrame, lookup: DataFrame, fact_key: Column, lookup_key: str) -> DataFrame:
    """Left join on a key that is unique on both sides, but may be missing in many facts.

    The join is on the key alone, so a ``lookup`` that is kept bucketed by it is read where it lies: only the facts
    move. Facts without a key go round the join.
    """
    keyed = facts.withColumn("_key", fact_key)
    found = keyed.where("_key is not null").join(lookup.withColumnRenamed(lookup_key, "_key"), "_key", "left")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in lookup.schema if f.name != lookup_key}
    return found.unionByName(keyed.where("_key is null").withColumns(nothing)).drop("_key")
