"""Cleaning of names, identifiers and postal codes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V

def null_string() -> Column:
    return F.lit(None).cast("string")


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (built-in ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for a non-null value with nothing but white space; null for null."""
    return strip(c) == ""


def blank_to_null(c: Column) -> Column:
    """Blank becomes null; any other value stays as it is, padding included."""
    return F.when(is_blank(c), null_string()).otherwise(c)


def split_bilingual(c: Column, separator: str = r"\|") -> tuple[Column, Column]:
    """English and French part; an absent part is null, parts after the second are dropped."""
    parts = F.split(c, separator)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def clean_name(c: Column) -> Column:
    """Strip, then delete full stops, then lower-case: the order matters for ``"foo ."``."""
    return F.lower(F.replace(strip(c), F.lit("."), F.lit("")))


def normalize_business_number(
    c: Column,
    placeholders: Sequence[str] = tuple(V.NUMBER_PLACEHOLDERS),
    digit_placeholders: Sequence[str] = tuple(V.DIGIT_PLACEHOLDERS),
) -> Column:
    """First nine digits of a number with at least nine, unless it is a placeholder."""
    raw = strip(c)
    digits = F.regexp_replace(raw, r"[^\p{Nd}]", "")
    nine = F.when(F.length(digits) >= 9, F.substring(digits, 1, 9))
    fake = raw.isin(*placeholders) | nine.isin(*digit_placeholders)
    return F.when(fake, null_string()).otherwise(nine)


def is_domestic(country: Column, domestic: Sequence[str] = tuple(V.DOMESTIC_COUNTRIES)) -> Column:
    """Null country gives null: such a row is neither domestic nor foreign."""
    return F.upper(strip(country)).isin(*domestic)


def normalize_postal_code(c: Column, country: Column) -> Column:
    """Domestic codes become ``A1A1A1`` or null; all others stay as they are."""
    squeezed = F.upper(remove_whitespace(c))
    valid = squeezed.rlike(r"\A[A-Z]\p{Nd}[A-Z]\p{Nd}[A-Z]\p{Nd}\z")
    return F.when(is_domestic(country), F.when(valid, squeezed)).otherwise(c)


def remove_whitespace(c: Column) -> Column:
    """Delete all white space, inner white space too."""
    return F.translate(c, V.WHITESPACE, "")


def has_whitespace(c: Column) -> Column:
    return c.rlike(r"(?U)\s")


def strip_common_prefixes(c: Column, prefixes: Sequence[str] = tuple(V.COMMON_PREFIXES)) -> Column:
    """Remove any run of leading organisation words; nothing left gives null.

    Each prefix ends in one blank and none starts another, so a single anchored repetition
    is the same as removing them one at a time until none is left.
    """
    run = "^(?:(?:" + "|".join(prefixes) + ") )+"
    rest = F.regexp_replace(
        F.btrim(F.lower(c), F.lit(V.WHITESPACE + "\x1c\x1d\x1e\x1f")), run, ""
    )
    return F.nullif(rest, F.lit(""))
