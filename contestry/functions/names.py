"""Name normalisation for matching, and event slugs.

ASCII text, nearly all of it, is normalised on the JVM.  Only other text goes
through Arrow to the Unicode tables of the Python standard library.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.functions.parsing import strip

_ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfc_casefold(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: unicodedata.normalize("NFC", s).strip().casefold(), na_action="ignore"
    )


@F.pandas_udf(T.StringType())
def _unaccent_casefold(names: pd.Series) -> pd.Series:
    def fold(text: str) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return "".join(kept).strip().casefold()

    return names.map(fold, na_action="ignore")


def _ascii_or(name: Column, unicode_path) -> Column:
    plain = name.rlike(_ASCII)
    return F.coalesce(
        F.when(plain, F.lower(strip(name))), unicode_path(F.when(~plain, name))
    )


def normal_name(name: Column) -> Column:
    """Composed, trimmed, case-folded; accents stay."""
    return _ascii_or(name, _nfc_casefold)


def folded_name(name: Column) -> Column:
    """Like ``normal_name`` with combining marks removed."""
    return _ascii_or(name, _unaccent_casefold)


def event_slug(name: Column, date_text: Column, prefix: str = "EVENT") -> Column:
    body = F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit(prefix + "_"), body, F.lit("_"), date_text, F.lit(".json"))


def pair_key(x: Column, y: Column) -> Column:
    """Order-free key of two values; null if either is null."""
    return F.when(x.isNotNull() & y.isNotNull(), F.array(F.least(x, y), F.greatest(x, y)))
