"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches.

Every document gets counts (words, characters in words, symbols, repeated lines, words in repeated
windows). Two base rules are fixed. The others are adaptive: a signal of a document is held against
the quartiles of its own language and source, so no cutoff has to suit all of them.

A sketch is a histogram of a non-negative integer signal whose buckets keep the leading bits of a value:
a quantile read from it is at most 1/64 below the true one. Counts of equal buckets add up, so sketches
are merged by summing, in any order and with the same result: tasks combine theirs before the shuffle,
sources are merged into languages and languages into the whole. A sketch has at most 64 buckets for each
power of two, whatever it has seen.

A group with fewer than ``least_rows`` measured documents takes the quartiles of its language, a language with fewer
those of all documents. The spread is the distance of the quartiles, or that of the language where that
is larger, so a group full of copies doesn't make its own spread vanish. A document is rejected if a
signal lies more than ``reach`` spreads and the signal's slack beyond the quartiles. Thresholds are
joined to the documents, one row a group.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources are groups
of their own; rows that share an id, and rows that repeat, are judged one by one and all count in the sketches;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WORD_SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

LEAST_ROWS = 100
REACH = 3
# Leading bits of a value that a bucket keeps.
KEPT_BITS = 7

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Signal:
    """An integer ratio ``scale * of / n_words``, judged on one or both sides."""

    name: str
    of: str
    scale: int
    slack: int
    low: bool

    def value(self) -> Column:
        return F.expr(f"{self.scale} * {self.of} div n_words")


SIGNALS = [
    Signal("word_length", "word_chars", 100, 100, low=True),
    Signal("symbol_share", "n_symbols", 1000, 100, low=False),
    Signal("line_repeats", "n_dup_lines", 1000, 50, low=False),
]


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more; windows are compared exactly."""
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    names: dict = {}
    own = np.array([names.setdefault(word, len(names)) for word in words], np.int64)
    if len(names) == n:
        return 0
    # Windows of a doubled length are pairs of names; the last step may overlap.
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = own[:-step] * (int(own.max()) + 1) + own[step:]
        own = np.unique(pairs, return_inverse=True)[1]
        size += step
    twice = np.bincount(own)[own] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(WORD_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WORD_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed) of every row of (doc_id, lang, source, text)."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([counts_of(text.as_py()) for text in batch.column(3)], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{name} bigint" for name in COUNTS)
    few = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return docs.mapInArrow(scan, schema).withColumn("base_failed", few | repeats)


def bucket(value: Column) -> Column:
    """The smallest value of the bucket that a non-negative integer falls into."""
    low_bits = F.greatest(F.lit(0), F.length(F.bin(value)) - KEPT_BITS)
    unit = F.pow(F.lit(2), low_bits).cast("bigint")
    return value - F.pmod(value, unit)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n) of the rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("signal"), bucket(s.value()).alias("bucket")) for s in SIGNALS]))
    seen = rows.where(~F.col("base_failed")).select("lang", "source", each.alias("s"))
    return seen.select("lang", "source", "s.*").groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """One row per group: ``rows`` and, for each signal, ``<signal>_q1`` and ``<signal>_q3``."""
    from pyspark.sql import Window

    # A group's rows are the buckets of a sketch.
    group = Window.partitionBy(*by, "signal")
    upto = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))

    def read(signal: str, numerator: int) -> Column:
        here = (F.col("signal") == signal) & (4 * F.col("upto") >= numerator * F.col("total"))
        return F.min(F.when(here, F.col("bucket")))

    columns = [read(s.name, k).alias(f"{s.name}_q{k}") for s in SIGNALS for k in (1, 3)]
    return upto.groupBy(*by).agg(F.max("total").alias("rows"), *columns)


def thresholds(sketch: DataFrame, *, least_rows: int, reach: int) -> DataFrame:
    """(lang, source, <signal>_low, <signal>_high), one row per language and source."""
    # One row: the quartiles of all documents.
    every = quartiles(merged(sketch)).first()
    own = quartiles(sketch, "lang", "source").alias("own")
    language = quartiles(merged(sketch, "lang"), "lang").alias("language")
    both = own.join(language, F.col("own.lang").eqNullSafe(F.col("language.lang")))
    enough = F.col("own.rows") >= least_rows
    enough_in_language = F.col("language.rows") >= least_rows

    def limits(s: Signal) -> list[Column]:
        def of_language(k: int) -> Column:
            whole = F.lit(every[f"{s.name}_q{k}"] if every else None).cast("bigint")
            return F.when(enough_in_language, F.col(f"language.{s.name}_q{k}")).otherwise(whole)

        q1, q3 = (F.when(enough, F.col(f"own.{s.name}_q{k}")).otherwise(of_language(k)) for k in (1, 3))
        spread = F.greatest(q3 - q1, of_language(3) - of_language(1))
        low = q1 - reach * spread - s.slack if s.low else F.lit(None).cast("bigint")
        return [low.alias(f"{s.name}_low"), (q3 + reach * spread + s.slack).alias(f"{s.name}_high")]

    return both.select("own.lang", "own.source", *[limit for s in SIGNALS for limit in limits(s)])


def judge(
    docs: DataFrame, *, least_rows: int = LEAST_ROWS, reach: int = REACH, id_column: str = "doc_id",
    text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the names of the adaptive rules a row breaks (``broken``)."""
    chosen = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"),
    )
    rows = stage(measured(chosen), "quality-counts")
    limits = stage(thresholds(stage(sketches(rows), "quality-sketches"), least_rows=least_rows, reach=reach), "quality-limits")
    same = F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    joined = rows.alias("r").join(limits.alias("t"), same, "left")

    def breaks(s: Signal) -> Column:
        beyond = (s.value() > F.col(f"{s.name}_high")) | F.coalesce(s.value() < F.col(f"{s.name}_low"), F.lit(False))
        return F.when(~F.col("base_failed") & F.coalesce(beyond, F.lit(False)), F.lit(s.name))

    broken = F.array_compact(F.array(*map(breaks, SIGNALS)))
    judged = joined.select("doc_id", *COUNTS, "base_failed", broken.alias("broken"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
