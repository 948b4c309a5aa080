"""Readers that give the input tables their schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens import schemas as S
from faultlens import session
from faultlens.functions import json_text as J
from faultlens.functions.text import decode_utf8, iso_utc


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` by name and type; nothing else is read."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def unreadable(text: Column) -> Column:
    """Why a text can't be read as one JSON object; null when it can.

    The kind is judged on the whole text, so one that was cut off, or has something behind its last
    brace, is told from one that only lacks keys.
    """
    def fault(kind: Column) -> Column:
        return F.when(kind.isNull(), F.lit("not JSON")).when(kind != "object", F.concat(F.lit("not an object but "), kind))

    # The lambda names the kind, so the text is parsed once.
    judged = F.get(F.transform(F.array(J.strict_kind(text)), fault), 0)
    return F.when(text.isNull(), F.lit("no document")).otherwise(judged)


def split_documents(documents: DataFrame, text: str, kind: str, **ids: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``text`` is one JSON object, and the others as rows of the reject table.

    Each text is judged once and written with the outcome, which both parts read: a filter on the outcome would
    be moved below the texts and judge, and build, them again for every reader. A reject names the ``kind`` of document, the
    reason and the digest of the text, by which the sender can find it; ``ids`` are columns that are known from outside the text.
    """
    judged = session.stage(documents.withColumn("_fault", unreadable(F.col(text))), f"judged-{kind}")
    reason = F.concat(F.lit(f"unreadable {kind}: "), F.col("_fault"))
    given = {"reason": reason, "digest": F.md5(text)} | ids
    columns = [given.get(name, F.lit(None)).cast("string").alias(name) for name in S.REJECTS.fieldNames()]
    return (
        judged.where(F.col("_fault").isNull()).drop("_fault"),
        judged.where(F.col("_fault").isNotNull()).select(*columns),
    )


def outputs_from_documents(documents: DataFrame, run_id: Column, text: str) -> DataFrame:
    """Run outputs from a column of JSON objects.

    The three named keys are taken out as text (a value of another kind as its JSON); all others stay
    together as one object, absent when there are none. An object that repeats a key inside can't be taken apart
    and is kept whole beside what was read of it.
    """
    named = ["error", "logs", "notebook_output"]
    fields = J.parse(F.col(text), f"struct<{', '.join(f'{name}: string' for name in named)}>")
    whole = J.parse(F.col(text), "map<string, variant>")
    others = F.map_filter(whole, lambda key, _: ~key.isin(*named))
    rest = F.when(whole.isNull(), F.col(text)).when(F.cardinality(others) > 0, F.to_json(others))
    read = documents.select(run_id.cast("bigint").alias("run_id"), fields.alias("read"), rest.alias("output_json"))
    return read.select("run_id", *[f"read.{name}" for name in named], "output_json")


def runs_from_documents(documents: DataFrame, text: str, event_ts: Column) -> DataFrame:
    """Runs from a column of run-detail JSON; missing keys are null, the whole text is kept as ``document``.

    Texts that may be broken go through ``split_documents`` first: here they read as a run without keys.
    """
    read = documents.select(
        F.from_json(text, S.RUN_DETAILS).alias("run"),
        event_ts.cast("timestamp").alias("event_ts"),
        F.col(text).alias("document"),
    )
    return read.select("run.run_id", "run.job_id", "run.run_name", "event_ts", "run.tasks", "document")


def settings_from_documents(documents: DataFrame, job_id: str, text: str) -> DataFrame:
    """Job settings from a column of JSON; the whole text is kept as ``document``."""
    parsed = F.from_json(text, S._row(("settings", S.SETTINGS)))
    return documents.select(
        F.col(job_id).cast("bigint").alias("job_id"), parsed["settings"].alias("settings"), F.col(text).alias("document")
    )


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files below a folder, one row each; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode_utf8(F.col("content")).alias("source"))


def table_files(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Details of tables of parquet files, by name and path: files, bytes, rows and the newest change.

    All is taken from the files' hidden columns and footers; no column of a table is read. Tables without any row show no
    file. The rows fit the detail snapshot of an analysis.
    """
    facts = ["file_path", "file_size", "file_modification_time"]
    read = [
        spark.read.parquet(path).select(F.lit(name).alias("table_name"), *[f"_metadata.{fact}" for fact in facts])
        for name, path in sorted(tables.items())
    ]
    files = reduce(DataFrame.unionByName, read).groupBy("table_name", *facts).agg(F.count("*").alias("rows"))
    found = files.groupBy("table_name").agg(
        F.count("*").alias("num_files"), F.sum("file_size").alias("size_in_bytes"), F.sum("rows").alias("num_rows"),
        F.max("file_modification_time").alias("newest"),
    )
    return found.select(
        "table_name", F.lit("parquet").alias("format"), "num_files", "size_in_bytes", "num_rows",
        iso_utc(F.col("newest")).alias("last_modified"),
    )


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """Column snapshot of a database, one row per column; only catalog metadata is read."""
    rows = [
        (f"spark_catalog.{database}.{table.name}", i, c.name, c.dataType, c.description)
        for table in spark.catalog.listTables(database)
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{table.name}"), start=1)
    ]
    return spark.createDataFrame(rows, S.TABLE_COLUMNS)


def probe_table(spark: SparkSession, table: str) -> DataFrame:
    """Whether one row of a table can be read, as a row of the probe table."""
    try:
        spark.table(table).limit(1).collect()
        outcome = (table, True, None)
    except Exception as failure:  # every failure is the probe's answer
        outcome = (table, False, f"{type(failure).__name__}: {failure}")
    return spark.createDataFrame([outcome], S.TABLE_PROBE)
