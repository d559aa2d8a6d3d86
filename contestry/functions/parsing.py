"""Raw text columns to typed columns.  Anything malformed becomes null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for "no value" after trimming and lower-casing.
MISSING_TOKENS = ("", "--", "---", "n/a", "nan")

# Blanks that a plain strip removes.
_BLANKS = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def clean_text(value: Column) -> Column:
    """Trimmed text, or null where the text is a missing token."""
    text = strip(value.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING_TOKENS), text)


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def landed_attempted(value: Column) -> Column:
    """``'45 of 118'`` -> struct(landed=45, attempted=118)."""
    text, pattern = clean_text(value), r"^(\d+)\s+of\s+(\d+)$"
    return F.struct(
        _group(text, pattern, 1).try_cast("int").alias("landed"),
        _group(text, pattern, 2).try_cast("int").alias("attempted"),
    )


def clock_seconds(value: Column) -> Column:
    """``'2:35'`` -> 155."""
    text, pattern = clean_text(value), r"^(\d+):(\d{2})$"
    return _group(text, pattern, 1).try_cast("int") * 60 + _group(text, pattern, 2).try_cast("int")


def height_inches(value: Column) -> Column:
    """Feet-and-inches text, the inch mark optional -> inches."""
    text, pattern = clean_text(value), r"^(\d+)'\s*(\d+)\"?$"
    feet, inches = _group(text, pattern, 1).try_cast("int"), _group(text, pattern, 2).try_cast("int")
    return (feet * 12 + inches).cast("double")


def reach_inches(value: Column) -> Column:
    """``72"`` or ``72`` -> 72.0."""
    return _group(clean_text(value), r"^(\d+(?:\.\d+)?)\"?$", 1).try_cast("double")


def percent(value: Column) -> Column:
    """``45%`` or ``45`` -> 0.45."""
    return _group(clean_text(value), r"^(\d+(?:\.\d+)?)%?$", 1).try_cast("double") / 100.0


def number(value: Column) -> Column:
    """Numeric text to double; bad text and NaN become null."""
    parsed = strip(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


# The date spellings found in the raw tables.
DATE_FORMATS = ("yyyy/MM/dd", "MMM d, yyyy", "yyyy-MM-dd", "MMMM d, yyyy")


def mixed_date(value: Column) -> Column:
    """Text in any known date spelling -> timestamp without zone.

    A spelling is tried only on text that holds its separator: a failed try costs
    many times a parse.
    """
    text = strip(value.cast("string"))
    tries = [F.when(text.contains(re.search("[/,-]", fmt)[0]), F.try_to_timestamp(text, F.lit(fmt))) for fmt in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def trailing_hex_id(url: Column) -> Column:
    """The 16-digit hex id that ends a URL, an optional slash after it."""
    return _group(strip(url), r"([0-9a-f]{16})/?$", 1)
