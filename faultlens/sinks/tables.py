"""Creating, appending to and replacing the output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens.operators.prompts import default_prompt, missing_prompts
from faultlens.schemas import OUTPUT_TABLES


def ensure_tables(spark: SparkSession, database: str, fmt: str = "parquet") -> None:
    """Create the database and the four tables unless they are there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in OUTPUT_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema.toDDL()}) USING {fmt}")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the target by name; those the frame lacks become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append_table(df: DataFrame, table: str) -> None:
    """One append of the whole batch, aligned by column name."""
    align(df, df.sparkSession.table(table).schema).write.insertInto(table)


def append_path(df: DataFrame, schema: StructType, path: str) -> None:
    align(df, schema).write.mode("append").parquet(path)


def replace_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def replace_path(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_archive(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Append to a table that is kept bucketed and sorted by ``key``, so that lookups by it don't move it.

    The number of buckets is fixed by the first append; each bucket should stay within what a task can sort.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def seed_default_prompt(spark: SparkSession, table: str) -> None:
    """Append the default prompt unless an active version of it is new enough."""
    append_table(missing_prompts(default_prompt(spark), spark.table(table)), table)


def read_path(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
