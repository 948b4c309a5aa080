"""Exact deduplication by deterministic block naming; DataFrame functions only.

The normalised text (white space deleted) is cut into blocks of fixed size. Equal blocks get one integer
name; then adjacent names are paired and equal pairs get one name, again and again, until each text has
a single name. Two texts have the same name after the same number of rounds exactly when they are
equal: names stand for compared contents, not for hashes of them.

Naming a round: distinct blocks (later: pairs of names) are grouped, sorted within their partition and
numbered in that order, and the table is written. A task that runs again gives the same numbers. Copies
are combined before the shuffle, so a block that a third of all rows hold is one row per task. Blocks
are looked up by a 64-bit hash wherever the grouping has shown that the hash stands for one block only;
blocks that share a hash with another block are looked up by their content.

Kept of equal texts: the row with the most code points in the original, then the smallest id. Defined
cases: null counts as empty, and empty texts are equal; a null id sorts after every other; of rows that
repeat in id, text length and normalised text one is kept; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import stage

# Deleted before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]"
BLOCK_CHARACTERS = 512
KEY = ["doc_id", "n_original", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows under a key that equal rows share: id, length and digest; with the normalised text."""
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_original"),
        normalised(text).alias("norm"),
    )
    return rows.select("doc_id", "n_original", F.unhex(F.sha2("norm", 256)).alias("text_sha256"), "norm")


def blocks(rows: DataFrame, size: int, digest) -> DataFrame:
    """(key, pos, h, block): an empty text is one empty block."""
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    own = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut)
    exploded = rows.select(*KEY, F.posexplode(own).alias("pos", "block"))
    return exploded.select(*KEY, F.col("pos").cast("bigint").alias("pos"), digest(F.col("block")).alias("h"), "block")


def _named(contents: DataFrame, by: list[str], label: str) -> DataFrame:
    """Distinct contents with an integer name each, written once."""
    distinct = contents.select(*by).distinct().sortWithinPartitions(*by)
    return stage(distinct.withColumn("name", F.monotonically_increasing_id()), label)


def _name_blocks(rows: DataFrame, size: int, digest) -> DataFrame:
    """(key, pos, name) for every block."""
    own = blocks(rows, size, digest)
    distinct = own.select("h", "block").distinct().sortWithinPartitions("h", "block")
    # Of the contents only those that share their hash are needed again.
    numbered = distinct.withColumn("name", F.monotonically_increasing_id())
    per_hash = numbered.groupBy("h").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    names = stage(per_hash, "block-names")
    narrow = own.select(*KEY, "pos", "h")
    alone = names.where("name = last").select("h", "name")
    found = narrow.join(alone, "h").select(*KEY, "pos", "name")
    shared = names.where("name <> last").select("h")
    if shared.isEmpty():
        return found
    # The contents behind a shared hash, named apart below zero.
    rival = own.join(shared, "h", "left_semi")
    apart = _named(rival, ["h", "block"], "shared-hash-names").withColumn("name", -1 - F.col("name"))
    return found.unionByName(rival.join(apart, ["h", "block"]).select(*KEY, "pos", "name"))


def identities(rows: DataFrame, size: int = BLOCK_CHARACTERS, digest=F.xxhash64) -> DataFrame:
    """(key, level, name) for every distinct key: equal texts, and only they, share level and name."""
    named = stage(_name_blocks(rows, size, digest), "names-0")
    done, level = [], 0
    while True:
        # The last position tells whether a text still has more than one name.
        lasts = named.groupBy(*KEY).agg(F.max("pos").alias("last"), F.min_by("name", "pos").alias("name"))
        lasts = stage(lasts, f"lasts-{level}")
        done.append(lasts.where("last = 0").select(*KEY, F.lit(level).alias("level"), "name"))
        if lasts.where("last > 0").isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = named.withColumn("half", F.floor(F.col("pos") / 2)).groupBy(*KEY, "half").agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")
        )
        # A text of one name is done; in a longer one a last block without neighbour is paired with none.
        open_pairs = stage(pairs.where("half > 0 or b is not null").withColumnRenamed("half", "pos"), f"pairs-{level}")
        codes = open_pairs.withColumn("b_or_none", F.coalesce("b", F.lit(-(1 << 62))))
        names = _named(codes, ["a", "b_or_none"], f"pair-names-{level}")
        level += 1
        named = stage(codes.join(names, ["a", "b_or_none"]).select(*KEY, "pos", "name"), f"names-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def classes(docs: DataFrame, *, size: int = BLOCK_CHARACTERS, digest=F.xxhash64, **columns) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_original``."""
    rows = keyed(docs, **columns)
    named = identities(rows, size, digest)
    # Equal rows are counted, so a repeated row is one key.
    counted = rows.groupBy(*KEY).agg(F.count("*").alias("n_rows"))
    same_key = [F.col(f"k.{c}").eqNullSafe(F.col(f"i.{c}")) for c in KEY]
    members = counted.alias("k").join(named.alias("i"), same_key).select(
        *[F.col(f"k.{c}").alias(c) for c in KEY], "n_rows", "level", "name"
    )
    members = stage(members, "identities")
    rank = F.struct((-F.col("n_original")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = stage(
        members.groupBy("level", "name").agg(F.sum("n_rows").alias("group_size"), F.min(rank).alias("best")), "groups"
    )
    joined = members.join(groups, ["level", "name"])
    best = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.n") == -F.col("n_original"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    return copies.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (best & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "n_original",
    )


def deduplicated(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns."""

    def key(doc_id: Column, length: Column, digest: Column) -> list[Column]:
        # Without nulls, so that the join and the removal of repeated rows share one shuffle.
        return [doc_id.isNull().alias("__exact_no_id"), F.coalesce(doc_id, F.lit(0)).alias("__exact_id"),
                length.alias("__exact_n"), digest.alias("__exact_sha")]

    text = F.col(text_column)
    length = F.char_length(F.coalesce(text, F.lit(""))).cast("bigint")
    own = docs.select("*", *key(F.col(id_column), length, F.sha2(normalised(text), 256)))
    stay = classes(docs, id_column=id_column, text_column=text_column, **options).where("kept")
    stay = stay.select(*key(F.col("doc_id"), F.col("n_original"), F.col("text_sha256")))
    names = ["__exact_no_id", "__exact_id", "__exact_n", "__exact_sha"]
    # A row that repeats whole has one decision; one of its rows stays.
    return own.join(stay, names, "left_semi").dropDuplicates(names).select(*docs.columns)
