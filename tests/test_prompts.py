from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens import schemas as S
from faultlens.operators import prompts as P


def rows(spark, *items):
    base = dict.fromkeys(S.PROMPTS.fieldNames(), "")
    return spark.createDataFrame([tuple({**base, **i}.values()) for i in items], S.PROMPTS)


def version(v, updated, active="true", name="p", alias="a"):
    return {"prompt_name": name, "prompt_alias": alias, "prompt_version": v, "updated_at": updated, "is_active": active}


def test_later_update_wins_then_text_order_of_versions(spark):
    frame = rows(spark, version("10", "1"), version("9", "1"), version("11", "0"), version("99", "2", "false"))
    assert P.select_prompt(frame, "p", "a").first().prompt_version == "9"
    assert P.active_prompts(frame).first().prompt_version == "9"
    assert P.select_prompt(frame, "p", "a", numeric_version=True).first().prompt_version == "11"
    assert P.active_prompts(frame, numeric_version=True).first().prompt_version == "11"


def test_activity_ignores_case_and_absence_gives_no_row(spark):
    frame = rows(spark, version("1", "1", "TRUE"), version("2", "2", "yes"))
    assert P.select_prompt(frame, "p", "a").first().prompt_version == "1"
    assert P.select_prompt(frame, "p", "b").count() == 0


def test_seed_needs_a_recent_active_version(spark):
    default = P.default_prompt(spark)
    name, alias = V.DEFAULT_PROMPT_NAME, V.DEFAULT_PROMPT_ALIAS
    cases = [
        ([version("1", "1", name=name, alias=alias)], 1),
        ([version("2", "1", "false", name, alias)], 1),
        ([version("two", "1", name=name, alias=alias)], 1),
        ([version("2", "1", name=name, alias="other")], 1),
        ([version("2", "1", "True", name, alias), version("3", "1", name=name, alias=alias)], 0),
    ]
    for known, expected in cases:
        missing = P.missing_prompts(default, rows(spark, *known))
        assert missing.count() == expected and set(missing.columns) == set(S.PROMPTS.fieldNames())


def test_model_settings(spark):
    frame = rows(spark, {"temperature": "", "max_tokens": "5", "notes": "a"}, {"temperature": "hot", "notes": "b"},
                 {"temperature": "1", "max_tokens": "1.5", "notes": "c"})
    got = {r.notes: (r.temperature, r.max_tokens, r.settings_error) for r in P.model_settings(frame).collect()}
    assert got == {
        "a": (0.1, 5, None), "b": (None, 1600, "malformed temperature"), "c": (1.0, None, "malformed max_tokens")
    }


def test_values_may_be_absent(spark):
    pieces = P.template_pieces(F.lit("a{source_job_id}b"))
    filled = P.fill_template(pieces, {"source_job_id": F.lit(None).cast("string")})
    assert spark.range(1).select(filled.alias("x")).first().x == "ab"
