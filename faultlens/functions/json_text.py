"""Strict JSON on native expressions.

``from_json`` alone is lenient: it ignores whatever follows the first value. Reading the text as
the first of two items of an array, the second being the digest of the text itself, closes that
gap: trailing text either breaks the array or moves the digest away from second place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"allowSingleQuotes": "false"}
_JSON_SPACE = " \t\n\r"


def kind_of(text: Column) -> Column:
    """Kind of the JSON value in ``text`` judged by its first character (valid text assumed)."""
    first = F.left(F.btrim(text, F.lit(_JSON_SPACE)), F.lit(1))
    return (
        F.when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .when(first.rlike("[-0-9NI]"), "number")
    )


def strict_value(text: Column) -> Column:
    """Compact JSON text (strings unquoted) in a one-item array; null when not strict JSON.

    Text that no JSON value can start with is not parsed, and the lambda names the parsed pair, so
    other text is parsed once.
    """
    digest = F.md5(text)
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')), "array<string>", _OPTIONS)
    sound = F.filter(F.array(pair), lambda read: (F.size(read) == 2) & (F.get(read, 1) == digest))
    return F.when(kind_of(text).isNotNull(), F.slice(F.get(sound, 0), 1, 1))


def strict_kind(text: Column) -> Column:
    """object, array, string, boolean, null or number; SQL null when ``text`` is not strict JSON."""
    return F.when(strict_value(text).isNotNull(), kind_of(text))


def canonical(text: Column) -> Column:
    """JSON text with the keys of every object sorted and no spacing, at any depth.

    Texts that differ in order, spacing or the writing of numbers get one form. A text that can't be held as a
    variant, because it isn't JSON or repeats a key, is its own form.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def parse(text: Column, schema: str) -> Column:
    """Read JSON text known to be strict."""
    return F.from_json(text, schema, _OPTIONS)


def string_values(document: Column) -> Column:
    """Decoded strings of a JSON text at any depth, keys left out; null when it can't be read.

    Escaped backslashes and quotes are first written as code points, which changes no value. A string
    then ends at the next quote, so the pattern needs no alternatives and takes linear time.
    """
    plain = F.replace(F.replace(document, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    quoted = F.regexp_extract_all(plain, F.lit(r'("[^"]*"\s*:?)'), F.lit(1))
    values = F.filter(quoted, lambda found: ~F.endswith(found, F.lit(":")))
    return parse(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def is_empty(json: Column) -> Column:
    """Whether JSON text is null, an empty text, list or object, false or zero."""
    zero = F.substring(json, 1, 1).isin("0", "-") & json.rlike(r"^-?0(\.0*)?([eE][-+]?\d+)?$")
    return json.isin("null", '""', "[]", "{}", "false") | zero


def truthy(json: Column, shown: Column | None = None) -> Column:
    """``shown`` (or the JSON text itself) unless the value is empty, then SQL null."""
    return F.when(~is_empty(json), json if shown is None else shown)


def _items_text(array_json: Column) -> Column:
    items = parse(array_json, "array<string>")
    return F.transform(items, lambda item: F.coalesce(item, F.lit("None")))


def text_lines(text: Column) -> Column:
    """Lines of a text: items of a JSON list, else the text itself, else nothing."""
    is_list = F.btrim(text, F.lit(_JSON_SPACE)).startswith("[") & strict_value(text).isNotNull()
    return (
        F.when(is_list, _items_text(text))
        .when(F.coalesce(text, F.lit("")) != "", F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )


def json_lines(value_json: Column) -> Column:
    """Lines of a JSON value: list items, lines of a string, or the value as one line."""
    kind = kind_of(value_json)
    as_text = F.get(parse(F.concat(F.lit("["), value_json, F.lit("]")), "array<string>"), 0)
    return (
        F.when(kind == "array", _items_text(value_json))
        .when(kind == "string", text_lines(as_text))
        .when(kind.isNull() | (kind == "null"), F.array().cast("array<string>"))
        .otherwise(F.array(value_json))
    )
