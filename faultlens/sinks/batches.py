"""Batches written so that a repeat, or a retry after a break, leaves the same content.

Each table of an analysis is partitioned by batch. Writing a batch replaces its partition of every table,
also with nothing when a table has no rows this time, and names the batch in ``committed_batches`` last.
Readers see committed batches only, so what a broken attempt left behind is never read, and is gone when the
batch is written again. A batch that is already committed is not written twice: a stream that replays a
micro-batch after a restart finds it done. ``replace=True`` takes it back first and writes it anew.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens.schemas import BATCH_TABLES, COMMITTED_BATCHES
from faultlens.sinks.tables import align

BATCH = "batch_id"
COMMITS = "committed_batches"


def ensure_batch_tables(
    spark: SparkSession, database: str, tables: Mapping[str, StructType] = BATCH_TABLES, fmt: str = "parquet"
) -> None:
    """Create the database, the tables partitioned by batch and the list of batches unless they are there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in {**tables, COMMITS: COMMITTED_BATCHES}.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema.toDDL()}, {BATCH} STRING) "
            f"USING {fmt} PARTITIONED BY ({BATCH})"
        )


def _checked(batch: str | int) -> str:
    if not re.fullmatch(r"[\w.-]+", str(batch), re.ASCII):
        raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores: {batch!r}")
    return str(batch)


def _replace(rows: DataFrame, table: str, batch: str) -> None:
    """The rows become the batch's partition, whatever it held; none empty it."""
    own = [field for field in rows.sparkSession.table(table).schema.fields if field.name != BATCH]
    rows.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{batch}') SELECT * FROM {{rows}}",
        rows=align(rows, StructType(own)),
    )


def batches(spark: SparkSession, database: str) -> DataFrame:
    """The committed batches: ``batch_id``, and the number of rows written to each table."""
    return spark.table(f"{database}.{COMMITS}")


def is_committed(spark: SparkSession, database: str, batch: str | int) -> bool:
    return not batches(spark, database).where(F.col(BATCH) == _checked(batch)).isEmpty()


def committed(spark: SparkSession, database: str, name: str) -> DataFrame:
    """Rows of a table that belong to committed batches; the list of batches prunes the partitions read."""
    done = batches(spark, database).select(BATCH).distinct()
    return spark.table(f"{database}.{name}").join(done, BATCH, "left_semi")


def begin_batch(frames: Mapping[str, DataFrame], database: str, batch: str | int) -> None:
    """Write the batch's partition of some tables without committing it."""
    for name, rows in frames.items():
        _replace(rows, f"{database}.{name}", _checked(batch))


def write_batch(frames: Mapping[str, DataFrame], database: str, batch: str | int, *, replace: bool = False) -> bool:
    """Write a batch to its tables and commit it; false when it was committed before and is left alone."""
    spark, batch = next(iter(frames.values())).sparkSession, _checked(batch)
    commits = f"{database}.{COMMITS}"
    if is_committed(spark, database, batch):
        if not replace:
            return False
        _replace(spark.createDataFrame([], COMMITTED_BATCHES), commits, batch)
    begin_batch(frames, database, batch)
    written = [
        spark.table(f"{database}.{name}").where(F.col(BATCH) == batch).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        for name in frames
    ]
    counts = written[0]
    for one in written[1:]:
        counts = counts.unionByName(one)
    _replace(counts, commits, batch)
    return True
