"""Text and number normalisation as column expressions."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def grab(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unescape_nfkc(text: Text) -> Column:
    """HTML entities resolved and Unicode in its compatibility composition.

    Spark has neither; plain ASCII text without an ampersand stays in the JVM and reaches Python as a null.
    """
    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", html.unescape(v)))

    text = _col(text)
    odd = text.rlike(r"[&\x{80}-\x{10FFFF}]")
    return F.when(odd, convert(F.when(odd, text))).otherwise(text)


def keep_model_text(text: Text) -> Column:
    """Drop Hebrew and all but letters, digits and the punctuation of model names; squeeze white space."""
    plain = F.regexp_replace(_col(text), r"[\x{590}-\x{5FF}]+", " ")
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9#+/.&()-]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def clean(text: Text) -> Column:
    """Text for matching; null gives ''. A compatibility form leaves trademark signs behind as letters, as is usual here."""
    return F.coalesce(keep_model_text(unescape_nfkc(text)), F.lit(""))


def compact_key(text: Text) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", "")


def slug(text: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_price(text: Text) -> Column:
    """Whole shekels, halves away from zero; null where the digits make no number. Negative prices stay."""
    digits = F.regexp_replace(F.regexp_replace(_col(text), r"[^0-9.,-]", ""), ",", "")
    return F.round(digits.try_cast("decimal(38,10)"), 0).cast("bigint")


def normalize_sku(sku: Text) -> Column:
    """Percent-decoded, unescaped, upper-case letters and digits. A bare % stays, as Python's decoder leaves it."""
    whole = F.regexp_replace(F.coalesce(_col(sku), F.lit("")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.upper(F.regexp_replace(unescape_nfkc(F.coalesce(F.try_url_decode(whole), whole)), "[^A-Za-z0-9]", ""))


def quote(text: Text) -> Column:
    """Percent-encoding as in a path: space %20, slash and tilde kept."""
    out = F.url_encode(_col(text))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def availability_key(code: Text) -> Column:
    """A code without direction marks, trimmed, upper-case; null if nothing is left."""
    plain = F.regexp_replace(_col(code), "[‎‏﻿]", "")
    plain = F.regexp_replace(plain, "(?i)&lrm;|&#8206;|&#x200E;", "")
    return F.nullif(F.upper(F.trim(plain)), F.lit(""))
