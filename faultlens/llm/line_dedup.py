"""Lines that many documents repeat, found with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents and the largest
document id of each. A batch of documents is merge-joined with every run, which finds the keys they hold, and anti-joined
with those: what is left is new and becomes a run of level 0. Keys that a run holds already are not added again; their counts are
kept beside the runs as updates. So the runs share no key, and each key's first run and its updates have all its documents. When a level has ``fanout`` runs they are
merged into one run of the next level, and their updates into one, so that the number of both stays logarithmic in
the number of batches. Bucketing spares the runs every later shuffle.

The number of batches follows from the bytes of all texts, so a batch is as large for any corpus.

A line's key is the line without white space at its ends, A-Z lower-cased, as a 128-bit XXH3. Keys of
at least ``shortest`` code points in at least ``least_documents`` documents lose their lines everywhere
but in the document with the largest id. Lookups of a hot line are dealt over tasks by adaptive
execution; counts are combined before every shuffle.

Defined cases: a null or empty text is one empty line; rows without an id keep all lines and are not
counted; rows that share an id are one document to the counts and lose the same lines; a text may lose
all its lines; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import fresh_folder, stage

# The white space taken off both ends of a line (a fixed value of the contract).
LINE_SPACE = " \t\n\x0b\x0c\r"
SHORTEST = 20
LEAST_DOCUMENTS = 3
# Bytes of text in a batch, and runs of a level before they are merged. On a larger cluster a batch may be
# as large as all its tasks hash at a time.
BATCH_BYTES = 128 << 20
FANOUT = 4
KEY = ["k1", "k2"]


def line_key(line: str, shortest: int) -> bytes | None:
    """128-bit key of a line, none when it is too short to count."""
    from xxhash import xxh3_128_digest

    own = line.strip(LINE_SPACE)
    return xxh3_128_digest(own.encode("utf-8", "surrogatepass").lower()) if len(own) >= shortest else None


def line_hashes(docs: DataFrame, batches: int, shortest: int) -> DataFrame:
    """(batch, doc_id, k1, k2), each line key once per row of ``docs`` (doc_id, text)."""

    def scan(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in rows:
            keys, sizes = [], []
            for text in part.column(2):
                own = {line_key(line, shortest) for line in (text.as_py() or "").split("\n")} - {None}
                keys += own
                sizes.append(len(own))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            at = np.repeat(np.arange(len(sizes)), sizes)
            heads = [part.column(i).take(pa.array(at)) for i in (0, 1)]
            tails = [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*heads, *tails], ["batch", "doc_id", *KEY])

    dealt = docs.where("doc_id is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "text"
    )
    return dealt.mapInArrow(scan, "batch int, doc_id bigint, k1 bigint, k2 bigint")


class LineRuns:
    """Levelled runs of (k1, k2, n_docs, last_id) below the shared folder, each with its updates."""

    def __init__(self, spark: SparkSession, *, fanout: int = FANOUT, buckets: int | None = None):
        self._spark = spark
        self._fanout = fanout
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self._folder = fresh_folder(spark, "line-runs")
        # Per level, pairs of a run and the updates of the same batches.
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame, *, in_buckets: bool = False) -> str:
        """Rows as a bucketed, sorted table; those that come out of joins within the buckets are not moved again."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select(*KEY, "n_docs", "last_id")
        if not in_buckets:
            dealt = dealt.repartition(self._buckets, *KEY)
        writer = dealt.write.format("parquet").option("path", f"{self._folder}/{name}")
        writer.bucketBy(self._buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _tables(self, which: int) -> list[DataFrame]:
        return [self._spark.table(pair[which]) for level in self.levels for pair in level]

    def known_keys(self, counts: DataFrame) -> DataFrame:
        """The rows of a batch whose key a run holds. Each run is merged in its own buckets, without being shuffled.

        Runs share no key, so a row is found once at most, and only those that are found go on.
        """
        found = [counts.join(run.select(*KEY).hint("merge"), KEY, "left_semi") for run in self._tables(0)]
        return reduce(DataFrame.unionByName, found) if found else counts.limit(0)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, k1, k2), and merge the levels that are full."""
        counts = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))
        batch = self._write(counts)
        whole = self._spark.table(batch)
        updates = self._write(self.known_keys(whole), in_buckets=True)
        # The batch anti-joined with what the runs hold of it: both are in the same buckets.
        new = whole.join(self._spark.table(updates).select(*KEY).hint("merge"), KEY, "left_anti")
        run = self._write(new, in_buckets=True)
        self._drop(batch)
        self._put(0, run, updates)

    def _put(self, level: int, run: str, updates: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, updates))
        if len(self.levels[level]) >= self._fanout:
            full, self.levels[level] = self.levels[level], []
            # Runs of a level share no key, updates may.
            merged = self._write(reduce(DataFrame.unionByName, [self._spark.table(run) for run, _ in full]))
            added = self._write(_added([self._spark.table(updates) for _, updates in full]))
            self._drop(*[name for pair in full for name in pair])
            self._put(level + 1, merged, added)

    def _drop(self, *names: str) -> None:
        for name in names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Take the runs out of the session's catalog; their files stay with the shared folder."""
        self._drop(*[name for level in self.levels for pair in level for name in pair])
        self.levels = []

    def counts(self) -> DataFrame:
        """(k1, k2, n_docs, last_id) over everything added."""
        return _added(self._tables(0) + self._tables(1))


def _added(parts: list[DataFrame]) -> DataFrame:
    """Counts of equal keys added; parts in equal buckets stay in them."""

    def two(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right.toDF(*KEY, "n", "last").hint("merge"), KEY, "full_outer")
        return both.select(
            *KEY,
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
            F.greatest("last_id", "last").alias("last_id"),
        )

    return reduce(two, parts)


def _batches(docs: DataFrame, batch_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // batch_bytes))


def repeated_lines(
    docs: DataFrame, *, batch_bytes: int, fanout: int, shortest: int, least_documents: int
) -> DataFrame:
    """(doc_id, keys): the line keys that a document loses."""
    spark = docs.sparkSession
    batches = _batches(docs, batch_bytes)
    hashes = line_hashes(docs, batches, shortest)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        hashes = hashes.distinct()
    folder = fresh_folder(spark, "line-hashes")
    # Each batch reads its own files.
    hashes.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("doc_id bigint, k1 bigint, k2 bigint, batch int").parquet(folder)
    runs = LineRuns(spark, fanout=fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).drop("batch"))
    common = runs.counts().where(F.col("n_docs") >= least_documents).select(*KEY, "last_id")
    common = stage(common, "common-lines")
    runs.drop()
    lost = lines.join(common, KEY).where("doc_id <> last_id")
    # Bounded by the lines of one document.
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def deduplicate(
    docs: DataFrame, *, batch_bytes: int = BATCH_BYTES, fanout: int = FANOUT, shortest: int = SHORTEST,
    least_documents: int = LEAST_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id``, the kept ``text``, ``n_lines`` and ``n_dropped`` of every row."""
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    lost = repeated_lines(
        chosen, batch_bytes=batch_bytes, fanout=fanout, shortest=shortest, least_documents=least_documents
    )

    def cut(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for part in rows:
            kept, n_lines, n_dropped = [], [], []
            for text, keys in zip(part.column(1), part.column(2), strict=True):
                lines = (text.as_py() or "").split("\n")
                drop = {k["k1"].to_bytes(8, "little", signed=True) + k["k2"].to_bytes(8, "little", signed=True)
                        for k in keys.as_py() or []}
                stay = [line for line in lines if line_key(line, shortest) not in drop] if drop else lines
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    joined = chosen.join(lost, "doc_id", "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(cut, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")
