"""Benchmark passages in documents, by Wu-Manber search for many patterns at once.

Documents and items are sequences of words. Every ``window`` consecutive words of an item are a pattern;
an item of fewer words is one pattern. Patterns of one length share tables: the last two words under
the search position give a shift by which no pattern can end earlier, and where the shift is zero the
bucket of patterns with that suffix is compared word by word. Most positions are never looked at.

Patterns travel to the tasks in shards of bounded size. A benchmark too large for one shard is searched
shard by shard, all documents each time, and the occurrences are merged by document. The driver holds one
shard at a time; an item longer than a shard is one by itself.

Defined cases: null has no words; items without words, or without an id, name nothing; items that
repeat an id count once; rows with one id and one text are answered alike; an empty benchmark leaves
all documents clean; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

WINDOW = 10
BLOCK = 2
# Characters of benchmark text in one shard; what a task holds of the benchmark is a few times this.
SHARD_CHARACTERS = 2_000_000

# Word characters: digits, letters and everything beyond ASCII; A-Z become a-z and the rest a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if 0 < len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Shift and suffix tables over patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset], length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffix: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], frozenset]]] = {}
        for pattern, names in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.suffix.setdefault(pattern[length - self.block :], []).append((pattern, names))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        """(start, names) of every occurrence."""
        shift, suffix, default = self.shift, self.suffix, self.default
        length, block, at, n = self.length, self.block, self.length, len(words)
        while at <= n:
            own = tuple(words[at - block : at])
            step = shift.get(own, default)
            if step:
                at += step
                continue
            here = tuple(words[at - length : at])
            for pattern, names in suffix[own]:
                if pattern == here:
                    yield at - length, names
            at += 1


def matchers(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """One matcher per pattern length; ``items`` are (name, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for name, text in items:
        for pattern in windows(words_of(text), window):
            by_length.setdefault(len(pattern), {}).setdefault(pattern, set()).add(name)
    return [
        WuManber({p: frozenset(names) for p, names in patterns.items()}, length)
        for length, patterns in sorted(by_length.items())
    ]


def search(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged intervals of words inside an occurrence, and the names that occur."""
    found: list[tuple[int, int]] = []
    names: set = set()
    for table in tables:
        for start, own in table.find(words):
            found.append((start, start + table.length))
            names |= own
    return merge(found), names


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _dealt(items: DataFrame, shard_characters: int) -> tuple[DataFrame, int]:
    """The items with their shard, and the number of shards."""
    named = items.where("name is not null and text is not null")
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_characters))
    return named.withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(shards))), shards


def _shard(dealt: DataFrame, shard: int) -> list[tuple[str, str]]:
    return [(r["name"], r["text"]) for r in dealt.where(F.col("shard") == shard).select("name", "text").collect()]


_SPANS = "array<struct<start:bigint,stop:bigint>>"


def _occurrences(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """(doc_id, digest, n_words, spans, names) of every row, for one shard of the benchmark."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        tables = matchers(items, window)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            digests, counts, spans, names = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                words = words_of(text)
                intervals, own = search(words, tables)
                digests.append(xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")))
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in intervals])
                names.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(spans, span), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "digest", "n_words", "spans", "names"],
            )

    schema = f"doc_id bigint, digest binary, n_words bigint, spans {_SPANS}, names array<string>"
    return docs.mapInArrow(scan, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_characters: int = SHARD_CHARACTERS,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: ``n_words``, ``spans`` of hit words, ``n_hit``, ``item_ids``, ``contaminated``."""
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).cast("string").alias("name"), F.col(item_text).alias("text"))
    dealt, shards = _dealt(items, shard_characters)
    if shards == 1:
        rows = _occurrences(chosen, _shard(dealt, 0), window)
    else:
        # One shard at a time is in the driver: its occurrences are written before the next is read.
        found = [stage(_occurrences(chosen, _shard(dealt, i), window), f"occurrences-{i}") for i in range(shards)]
        merged = reduce(lambda a, b: a.unionByName(b), found).groupBy("doc_id", "digest", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"),
            (F.count("*") / len(found)).cast("int").alias("rows"),
        )
        # Rows that share id and text were answered together; they come back as many as they were.
        rows = merged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows")
    # Spans of several shards may overlap: walk them in order, counting each word once.
    step = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("upto")),
        lambda seen, span: F.struct(
            (seen["hit"] + F.greatest(F.lit(0), span["stop"] - F.greatest(seen["upto"], span["start"]))).alias("hit"),
            F.greatest(seen["upto"], span["stop"]).alias("upto"),
        ),
        lambda seen: seen["hit"],
    )
    counted = rows.withColumn("n_hit", step).withColumn("item_ids", F.array_sort("names"))
    return counted.select("doc_id", "n_words", "spans", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(item_ids) -> object:
    return F.sha2(F.array_join(item_ids, ","), 256)


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, str]:
    """Words, hit words and digest of the items found, by comparing every window; for tests."""
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        for pattern in windows(words_of(item), window):
            for at in range(len(words) - len(pattern) + 1):
                if tuple(words[at : at + len(pattern)]) == pattern:
                    hit.update(range(at, at + len(pattern)))
                    names.add(name)
    return len(words), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
