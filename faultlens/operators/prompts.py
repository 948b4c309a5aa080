"""Prompt versions: choosing the active one, seeding the default, rendering requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions.text import iso_utc, list_of_path, number_or
from faultlens.schemas import PROMPTS

_PIECES = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def is_active() -> Column:
    return F.lower("is_active") == "true"


def _version() -> Column:
    return F.col("prompt_version").try_cast("int")


def _precedence(numeric_version: bool) -> list[Column]:
    """Later update wins, then the greater version as text; or the greater number first."""
    if numeric_version:
        return [_version(), F.col("updated_at")]
    return [F.col("updated_at"), F.col("prompt_version")]


def active_prompts(prompts: DataFrame, numeric_version: bool = False, tie_break: str | None = None) -> DataFrame:
    """Active prompt of every (name, alias); combines before the shuffle."""
    order = _precedence(numeric_version) + ([F.col(tie_break)] if tie_break else [])
    latest = F.max_by(F.struct(*prompts.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return (
        prompts.where(is_active())
        .groupBy("prompt_name", "prompt_alias")
        .agg(latest.alias("latest"))
        .select("latest.*")
    )


def select_prompt(prompts: DataFrame, name: str, alias: str, numeric_version: bool = False) -> DataFrame:
    """Active prompt of one (name, alias): no or one row. The filter on both reaches the scan."""
    named = prompts.where((F.col("prompt_name") == name) & (F.col("prompt_alias") == alias))
    return active_prompts(named, numeric_version)


# The prompt row shipped with the package, without its times.
DEFAULT_PROMPT = {
    "prompt_name": V.DEFAULT_PROMPT_NAME,
    "prompt_alias": V.DEFAULT_PROMPT_ALIAS,
    "prompt_version": V.DEFAULT_PROMPT_VERSION,
    "is_active": "true",
    "model_endpoint": V.DEFAULT_MODEL_ENDPOINT,
    "temperature": V.DEFAULT_TEMPERATURE,
    "max_tokens": V.DEFAULT_MAX_TOKENS,
    "system_prompt": V.DEFAULT_SYSTEM_PROMPT,
    "user_prompt_template": V.DEFAULT_USER_TEMPLATE,
    "notes": "Default prompt for failed runs.",
}


def default_prompt(spark: SparkSession) -> DataFrame:
    """The shipped prompt, stamped with the current time."""
    now = iso_utc(F.current_timestamp())
    values = [F.lit(v).alias(n) for n, v in DEFAULT_PROMPT.items()]
    shipped = spark.range(1).select(F.inline(F.array(F.struct(*values))))
    return shipped.select("*", now.alias("created_at"), now.alias("updated_at"))


def missing_prompts(defaults: DataFrame, prompts: DataFrame, least_version: int = 2) -> DataFrame:
    """Defaults whose (name, alias) has no active row of at least that version."""
    present = prompts.where(is_active() & (_version() >= least_version)).select("prompt_name", "prompt_alias")
    return defaults.join(present.distinct(), ["prompt_name", "prompt_alias"], "left_anti").select(
        *[name for name in defaults.columns if name in PROMPTS.fieldNames()]
    )


def model_settings(prompts: DataFrame) -> DataFrame:
    """Numeric temperature and token limit; ``settings_error`` names a malformed one."""
    temperature = number_or(F.col("temperature"), "double", V.DEFAULT_TEMPERATURE)
    tokens = number_or(F.col("max_tokens"), "bigint", V.DEFAULT_MAX_TOKENS)
    return (
        prompts.withColumn("temperature", temperature)
        .withColumn("max_tokens", tokens)
        .withColumn(
            "settings_error",
            F.when(F.col("temperature").isNull(), F.lit("malformed temperature")).when(
                F.col("max_tokens").isNull(), F.lit("malformed max_tokens")
            ),
        )
    )


def template_pieces(template: Column) -> Column:
    """Template cut into literals, doubled braces and placeholders."""
    return F.regexp_extract_all(template, F.lit(_PIECES), F.lit(0))


def template_error(pieces: Column) -> Column:
    """First piece that is a lone brace or an unknown placeholder, else null."""
    known = ["{" + name + "}" for name in V.PROMPT_PLACEHOLDERS]
    bad = F.filter(
        pieces,
        lambda piece: (piece.startswith("{") | piece.startswith("}")) & ~piece.isin("{{", "}}", *known),
    )
    return F.get(bad, 0)


def fill_template(pieces: Column, values: dict[str, Column]) -> Column:
    """Replace every placeholder once; inserted values are not scanned again."""

    def filled(piece: Column) -> Column:
        chain = F.when(piece == "{{", F.lit("{")).when(piece == "}}", F.lit("}"))
        for name, value in values.items():
            chain = chain.when(piece == "{" + name + "}", F.coalesce(value, F.lit("")))
        return chain.otherwise(piece)

    return F.array_join(F.transform(pieces, filled), "")


METADATA = ["prompt_name", "prompt_alias", "prompt_version", "model_endpoint"]


def assign_prompt(
    cases: DataFrame, prompt: DataFrame, name: str, alias: str
) -> tuple[DataFrame, DataFrame]:
    """Cases with the prompt they are asked with, and rejected events with the reason.

    ``prompt`` is the outcome of ``select_prompt``: at most one row, read as a scalar subquery, so
    the cases are not joined or moved. Its template is cut once, before it meets the cases.
    """
    pieces = template_pieces(F.col("user_prompt_template"))
    fields = [*METADATA, "temperature", "max_tokens", "system_prompt"]
    cut = model_settings(prompt).withColumn("pieces", pieces)
    bad_piece = F.concat(F.lit("unknown placeholder "), template_error(F.col("pieces")))
    chosen = cut.select(
        F.struct(*fields, "pieces", F.coalesce("settings_error", bad_piece).alias("problem")).alias("prompt")
    )
    problem = F.when(F.col("prompt").isNull(), F.lit(f"{V.NO_PROMPT} {name}@{alias}")).otherwise(
        F.col("prompt.problem")
    )
    judged = cases.withColumn("prompt", chosen.scalar()).withColumn("reason", problem)
    rejected = judged.where(F.col("reason").isNotNull()).select(
        "source_job_id", "source_run_id", "event_id", "reason", F.lit(None).cast("string").alias("digest")
    )
    accepted = judged.where(F.col("reason").isNull()).select(
        *cases.columns, *[f"prompt.{field}" for field in [*fields, "pieces"]]
    )
    return accepted, rejected


def prompt_requests(asked: DataFrame, bundles: DataFrame, refs: DataFrame) -> DataFrame:
    """Rendered requests for the model service."""
    joined = (
        asked.join(bundles, "case_id", "left")
        .join(refs, "case_id", "left")
        .withColumn("failed_task_run_id", F.coalesce(F.col("task_run_id").cast("string"), F.lit("")))
        .withColumn("discovered_code_paths", list_of_path(F.col("failure_code_path")))
        .withColumn("discovered_tables", F.to_json(F.coalesce("refs", F.array().cast("array<string>"))))
    )
    values = {placeholder: F.col(placeholder) for placeholder in V.PROMPT_PLACEHOLDERS}
    return joined.select(
        "case_id", "event_id", *METADATA, "temperature", "max_tokens", "system_prompt",
        fill_template(F.col("pieces"), values).alias("user_prompt"),
    )
