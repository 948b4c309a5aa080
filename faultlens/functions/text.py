"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import fixed_values as V


def truncate(text: Column, limit: int) -> Column:
    """First ``limit`` characters and a marker when the text is longer; null reads as empty."""
    text = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(text, 1, limit), F.lit(V.TRUNCATION_MARKER))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def strip(text: Column) -> Column:
    """Remove white space of every script from both ends."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def first_text(*texts: Column) -> Column:
    """First text that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])


def first_nonempty(*arrays: Column) -> Column:
    """First array with at least one item, else null."""
    return F.coalesce(*[F.when(F.size(items) > 0, items) for items in arrays])


# The fixed pattern for the JVM: an identifier is not tried from its middle, where it can only fail
# again, and is never given back in parts. Both leave the matched names as they are and take the
# time per word from quadratic to linear.
_NAME = f"{V.IDENTIFIER}+"
_REF_PATTERN = rf"(?<![A-Za-z_]){_NAME}`?\.`?{_NAME}`?\.`?{_NAME}"


def table_refs(text: Column) -> Column:
    """Distinct three-part names in ``text``, sorted, without backticks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_REF_PATTERN), F.lit(0))
    names = F.transform(found, lambda name: F.replace(name, F.lit("`")))
    return F.sort_array(F.array_distinct(names))


def bullets(items: Column, limit: int, empty: str) -> Column:
    """The first ``limit`` items as a dashed list, or ``empty``."""
    dashed = F.transform(F.slice(items, 1, limit), lambda item: F.concat(F.lit("- "), item))
    return F.when(F.size(items) > 0, F.array_join(dashed, "\n")).otherwise(F.lit(empty))


def lines(items: Column, limit: int, empty: str) -> Column:
    """The first ``limit`` items, one per line, or ``empty``."""
    joined = F.array_join(F.slice(items, 1, limit), "\n")
    return F.when(F.size(items) > 0, joined).otherwise(F.lit(empty))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC, whatever the session's zone; a whole second has no fraction."""
    micros = F.unix_micros(ts)
    fraction = F.pmod(micros, F.lit(1_000_000))
    seconds = ((micros - fraction) / 1_000_000).cast("decimal(18,6)")
    # A timestamp without zone prints as it is.
    whole = (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)).cast("string")
    return F.concat(
        F.replace(whole, F.lit(" "), F.lit("T")),
        F.when(fraction == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))),
        F.lit("+00:00"),
    )


def decode_utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def list_of_path(path: Column) -> Column:
    """JSON list that holds the path, or an empty list when there is none."""
    return F.to_json(F.filter(F.array(path), lambda item: item != ""))


def number_or(text: Column, kind: str, default: str) -> Column:
    """Numeric value of ``text``; empty gives ``default``, a malformed number gives null."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default)).try_cast(kind)
