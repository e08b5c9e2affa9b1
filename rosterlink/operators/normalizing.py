"""Cleaned name, identifier and postal columns beside the raw ones, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.functions import vocabulary as V
from rosterlink.operators.profiling import percent, present


def normalize_names(df: DataFrame, columns: Sequence[str] = tuple(V.NAME_COLUMNS)) -> DataFrame:
    """Adds ``_raw``, ``_en`` and ``_fr`` for each name column and keeps the original."""
    added = {}
    for c in columns:
        raw = F.col(c).cast("string")
        english, french = text.split_bilingual(raw)
        added[f"{c}_raw"] = raw
        added[f"{c}_en"] = text.clean_name(english)
        added[f"{c}_fr"] = text.clean_name(french)
    return df.withColumns(added)


def _replace(df: DataFrame, column: str, raw: str, make) -> DataFrame:
    """Rename ``column`` to ``raw`` in place and add the cleaned column at the end."""
    renamed = df.withColumnRenamed(column, raw)
    return renamed.withColumn(column, make(F.col(raw).cast("string")))


def normalize_business_numbers(
    df: DataFrame, column: str = "recipient_business_number", raw: str = "bn_raw"
) -> DataFrame:
    return _replace(df, column, raw, text.normalize_business_number)


def normalize_postal_codes(
    df: DataFrame,
    column: str = "recipient_postal_code",
    raw: str = "postal_code_raw",
    country: str = "recipient_country",
) -> DataFrame:
    return _replace(
        df,
        column,
        raw,
        lambda c: text.normalize_postal_code(c, F.col(country).cast("string")),
    )


def normalize_refs(
    df: DataFrame, column: str = "ref_number", raw: str = "ref_number_raw"
) -> DataFrame:
    return _replace(df, column, raw, text.remove_whitespace)


def normalize_grants(df: DataFrame) -> DataFrame:
    """All four cleanings; they collapse into one projection."""
    return normalize_refs(normalize_postal_codes(normalize_business_numbers(normalize_names(df))))


def bn_summary(df: DataFrame, column: str = "recipient_business_number") -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(column).alias("valid"),
        F.count_if(F.col(column).isNull()).alias("null_count"),
    )
    return counted.select(
        "*",
        percent(F.col("valid"), F.col("total_rows")).alias("valid_pct"),
        percent(F.col("null_count"), F.col("total_rows")).alias("null_pct"),
    )


def postal_summary(
    df: DataFrame, column: str = "recipient_postal_code", country: str = "recipient_country"
) -> DataFrame:
    """Domestic, domestic with a valid code, and foreign; a null country is in neither."""
    domestic = text.is_domestic(F.col(country).cast("string"))
    counted = df.agg(
        F.count_if(domestic).alias("domestic"),
        F.count_if(domestic & F.col(column).isNotNull()).alias("domestic_valid"),
        F.count_if(~domestic).alias("foreign_rows"),
    )
    return counted.withColumn(
        "domestic_valid_pct", percent(F.col("domestic_valid"), F.col("domestic"))
    )


def ref_whitespace_count(df: DataFrame, raw: str = "ref_number_raw") -> DataFrame:
    return df.agg(F.count_if(text.has_whitespace(F.col(raw))).alias("with_whitespace"))


def blank_to_null(
    df: DataFrame, columns: Sequence[str] = tuple(V.LINKAGE_TEXT_COLUMNS)
) -> DataFrame:
    return df.withColumns({c: text.blank_to_null(F.col(c)) for c in present(df, columns)})


def add_stripped_name(
    df: DataFrame,
    column: str = "recipient_legal_name_en",
    stripped: str = "recipient_legal_name_stripped_en",
    prefixes: Sequence[str] = tuple(V.COMMON_PREFIXES),
) -> DataFrame:
    return df.withColumn(stripped, text.strip_common_prefixes(F.col(column), prefixes))


def prefix_strip_count(
    df: DataFrame,
    column: str = "recipient_legal_name_en",
    stripped: str = "recipient_legal_name_stripped_en",
) -> DataFrame:
    same = F.col(stripped).eqNullSafe(F.lower(F.col(column)))
    return df.agg(F.count_if(~same).alias("n_stripped"))
