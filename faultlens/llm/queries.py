"""Registered queries of the subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import session
from faultlens.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    importance,
    license_scan,
    line_dedup,
    merkle,
    packing,
    quality_rules,
    simhash,
    spelling,
    token_files,
    toxicity,
)

VOCABULARY = "byte_bpe_50k.json"
# Parameters of the contracts.
FILE_END_ID = 2
PACK_END_ID = 0
PACK_LENGTH = 2048
SHINGLE_WORDS = 4
MOST_BITS = 4


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="faultlens-package-")) / "faultlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship(spark)
    return session.tune(spark).read.parquet(f"{folder}/{table}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(read(spark, folder, "documents"))
    named = F.array_join(F.array_sort(F.array_distinct("matches.license_id")), ",").alias("license_ids")
    return found.select("doc_id", "license_id", "score", F.col("line").cast("bigint").alias("line"), "n_matches", named)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.deduplicate(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    written = token_files.write(read(spark, folder, "documents"), tokenizer_path(), FILE_END_ID)
    return token_files.read(spark, written)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(read(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_importance(spark: SparkSession, folder: str) -> DataFrame:
    good = read(spark, folder, "labels").where("quality = 1").select("doc_id")
    return importance.resample(read(spark, folder, "documents"), good)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"), tokenizer_path(), PACK_LENGTH, PACK_END_ID)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"), width=SHINGLE_WORDS, tau=MOST_BITS)
    return found.select("doc_id", "fingerprint", "component_id")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        decontaminate.items_digest("item_ids").alias("items_sha256"), "contaminated",
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.classes(read(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(read(spark, folder, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.variants(read(spark, folder, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    query.__name__: query
    for query in (
        op1_license_scan, op2_line_dedup, op3_token_files, op4_html_text, op5_toxicity, op6_importance, op7_packing,
        op8_simhash, op9_decontaminate, op10_exact_dedup, op11_quality_rules, op12_merkle_manifest, op13_spelling_variants,
    )
}
