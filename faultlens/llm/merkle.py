"""Merkle manifest of a table: a digest per row, a tree per partition value, one root, proofs and verification.

A row's leaf is the digest of its chosen columns. Leaves of one language, in ascending id order, form a
tree of fixed arity: while a level has more than one node, every run of ``arity`` neighbours (the last may
be shorter) becomes one parent, the digest of the run. The last node is the subroot; subroots, in order
of their language, form the top tree in the same way.

Order without gathering: leaves are dealt by ranges of (language, id, leaf), sorted and written; a leaf's
place is its place in its part plus the prefix sum of the parts before it. Languages of any share of the
rows are spread like all others, and rows that repeat are kept apart by a running number.

Each level finds siblings by self-joins: the sibling at offset k of a node has the same run and slot
(slot + k) mod arity (for two, the index XOR 1), so level and shifted level are equijoined once per
offset, and the rows at slot zero, which then hold their whole run, emit the parents. All these joins
share one partitioning by run. Afterwards the lists of siblings are handed down from the roots, one
equijoin of children with parents a level, each an eighth of the one below. The texts are read once.

Defined cases: a null column is written as ``-``; a null id sorts before all others and isn't tampered
with; rows that share an id are ordered by leaf, and equal rows have neighbouring places; a null language is
first; a tree of one leaf has that leaf as subroot, a single subroot is the root; an empty table gives
no rows. Columns other than those of a leaf are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.session import stage

ARITY = 8
# Which rows a verification tampers with: those whose checksum is divided by this.
TAMPER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """UTF-8 length, a colon and the value, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@contextmanager
def _joins_within_runs(spark: SparkSession):
    """Joins on (tree, run, slot) may use rows that are dealt by (tree, run)."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of ``by``; no partition is sorted beyond its range."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    written = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    # One row for each part that was written, so no more than there are shuffle partitions.
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn("place", F.col("_base") + within).drop("_part", "_base", "_at")


def _siblings(level: DataFrame, arity: int) -> DataFrame:
    """``level`` (tree, at, size, digest, further columns) with the digests of the run before and after each node.

    A node that is a root has no run and is left out.
    """
    further = [c for c in level.columns if c not in ("tree", "at", "size", "digest")]
    many = level.where("size > 1").select(
        "tree", F.floor(F.col("at") / arity).alias("run"), F.pmod("at", F.lit(arity)).cast("int").alias("slot"),
        "size", "digest", *further,
    ).repartition("tree", "run")
    out = many
    for k in range(1, arity):
        target = F.col("slot").bitwiseXOR(F.lit(1)) if arity == 2 else F.pmod(F.col("slot") + k, F.lit(arity))
        shifted = many.select("tree", "run", F.col("slot").alias("_slot"), F.col("digest").alias(f"_{k}"))
        out = out.withColumn("_slot", target).join(shifted, ["tree", "run", "_slot"], "left").drop("_slot")
    # Offsets in order: first the slots after one's own, then, around the end, those before it.
    around = F.array(*[F.col(f"_{k}") for k in range(1, arity)])
    after = F.array_join(F.slice(around, F.lit(1), F.lit(arity - 1) - F.col("slot")), "")
    before = F.array_join(F.slice(around, F.lit(arity) - F.col("slot"), F.col("slot")), "")
    names = ["tree", "run", "slot", "size", "digest", *further]
    return out.select(*names, before.alias("before"), after.alias("after"))


def build(leaves: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over (tree, at, size, digest): the levels with their siblings, lowest first, and (tree, subroot)."""
    steps, level = [], leaves
    tops = leaves.where("size = 1").select("tree", F.col("digest").alias("subroot"))
    most = leaves.agg(F.max("size")).first()[0] or 0
    with _joins_within_runs(leaves.sparkSession):
        while most > 1:
            steps.append(stage(_siblings(level, arity), f"{label}-siblings-{len(steps)}"))
            parents = steps[-1].where("slot = 0").select(
                "tree", F.col("run").alias("at"), F.ceil(F.col("size") / arity).cast("bigint").alias("size"),
                F.sha2(F.concat("digest", "after"), 256).alias("digest"),
            )
            level = stage(parents, f"{label}-level-{len(steps)}")
            tops = tops.unionByName(level.where("size = 1").select("tree", F.col("digest").alias("subroot")))
            most = -(-most // arity)
    return steps, stage(tops, f"{label}-tops")


def hand_down(steps: list[DataFrame], roots: DataFrame, leaves: DataFrame, arity: int, label: str) -> DataFrame:
    """Each leaf of ``build`` with ``path``, its siblings from the lowest level up, and the columns of its root.

    ``roots`` (tree, path, further columns) has the paths that the roots themselves continue with.
    """
    given = [c for c in roots.columns if c not in ("tree", "path")]
    paths = None
    for i, found in reversed(list(enumerate(steps))):
        further = [c for c in found.columns if c not in ("tree", "run", "slot", "size", "digest", "before", "after")]
        own = found.select(
            "tree", "run", (F.col("run") * arity + F.col("slot")).alias("at"), "size", "digest", *further,
            F.array(F.struct("before", "after")).alias("own"),
        )
        names = ["tree", "at", "digest", *further, F.concat("own", "path").alias("path"), *given]
        # A tree has one run at most whose parent is its root.
        here = own.where(F.col("size") <= arity).join(roots, "tree").select(*names)
        if paths is not None:
            above = paths.select("tree", F.col("at").alias("run"), "path", *given)
            here = here.unionByName(own.where(F.col("size") > arity).join(above, ["tree", "run"]).select(*names))
        # The lowest level is as large as the table: it is joined where it is read.
        paths = stage(here, f"{label}-paths-{i}") if i else here
    alone = leaves.where("size = 1").drop("size").join(roots, "tree")
    return alone if paths is None else paths.unionByName(alone.select(*paths.columns))


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to when it is hashed with the siblings of a path, level by level."""
    return F.aggregate(path, start, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]), 256))


def manifest(
    docs: DataFrame, *, arity: int = ARITY, tamper: int = TAMPER, id_column: str = "doc_id", tree_column: str = "lang",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``path``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row."""
    doc_id = F.col(id_column).cast("bigint")
    hit = F.crc32(doc_id.cast("string")) % tamper == 0
    changed = F.translate(F.col(tampered_column), UPPER, LOWER)
    altered = leaf(*[changed if name == tampered_column else F.col(name) for name in columns])
    rows = docs.select(
        F.col(tree_column).cast("string").alias("lang"), doc_id.alias("doc_id"), leaf(*map(F.col, columns)).alias("leaf"),
        # Only a tampered row needs a second digest.
        F.when(hit, altered).alias("tampered"), F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(stage(rows, "manifest-leaves"), ["lang", "doc_id", "leaf", "row"], "manifest-sorted")
    sizes = placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    langs = numbered(sizes, ["lang"], "manifest-langs").withColumnRenamed("place", "tree")
    same = F.col("p.lang").eqNullSafe(F.col("t.lang"))
    leaves = placed.alias("p").join(langs.alias("t"), same).select(
        "tree", (F.col("place") - F.col("first")).alias("at"), "t.size", F.col("leaf").alias("digest"), "doc_id", "tampered"
    )
    leaves = stage(leaves, "manifest-indexed")
    steps, tops = build(leaves, arity, "manifest")

    upper = tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"),
                        F.lit(tops.count()).cast("bigint").alias("size"), F.col("subroot").alias("digest"))
    upper_steps, top = build(upper, arity, "manifest-top")
    nothing = F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path")
    crown = top.select("tree", nothing, F.col("subroot").alias("root"))
    roots = hand_down(upper_steps, crown, upper, arity, "manifest-top").select(
        F.col("at").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    found = hand_down(steps, stage(roots, "manifest-roots"), leaves, arity, "manifest")
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.sha2(proof, 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
