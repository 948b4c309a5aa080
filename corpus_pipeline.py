"""Documents cleaned and packed for training, one operator per stage.

Every row gets its own decision. Where ids are null or repeat, the rows that bear them are written with ids of their
own, behind all others, for the length of a stage; the operators then see unique ids. Of near copies the row with the
smallest id stays, so one with an id of its own stays before one without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import session
from faultlens.llm import decontaminate, exact_dedup, packing, queries, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    own = _with_ids(docs)
    # Labels name documents by their given id, which also tells the rows that may be learned from.
    model = toxicity.train(docs, queries.read(spark, sf_dir, "labels"))
    scored = toxicity.score(_for_operator(own), model)
    return _without(own, scored.where(F.col("score") >= toxicity.THRESHOLD).select("doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    own = _with_ids(docs)
    found = simhash.near_duplicates(_for_operator(own), width=queries.SHINGLE_WORDS, tau=queries.MOST_BITS)
    return _without(own, found.where("doc_id <> component_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    own = _with_ids(docs)
    found = decontaminate.contamination(_for_operator(own), queries.read(spark, sf_dir, "benchmark"))
    return _without(own, found.where("contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents that are left, with its place in a sequence."""
    return packing.packed(docs, queries.tokenizer_path(), queries.PACK_LENGTH, queries.PACK_END_ID)


ID = "__stage_id"


def _with_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with an id that no two rows share: their own, or one behind all where that is null or repeats."""
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = counted.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__odd_id"))
    odd = session.stage(odd, "odd-ids")
    if odd.isEmpty():
        return docs.withColumn(ID, F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("__odd_id"))
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    # Written, so that a row keeps its number whatever reads it.
    apart = session.stage(docs.join(odd, same, "left_semi").withColumn(ID, F.monotonically_increasing_id() + last + 1), "odd-rows")
    return docs.join(odd, same, "left_anti").withColumn(ID, F.col("doc_id")).unionByName(apart)


def _for_operator(own: DataFrame) -> DataFrame:
    return own.select(F.col(ID).alias("doc_id"), "text")


def _without(own: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows that aren't rejected."""
    ids = session.stage(rejected.select(F.col("doc_id").alias("__rejected_id")), "rejected")
    return own.join(ids, F.col(ID) == F.col("__rejected_id"), "left_anti").drop(ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# The classifier, the tokens and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = session.stage(docs, f"corpus-{i}")
    return docs
