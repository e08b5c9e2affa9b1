"""Labels by ordered rules, with where each label came from and how sure it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions.rules import Rule, first_match, recipient_rules
from rosterlink.operators.profiling import percent


def apply_rules(
    df: DataFrame, rules: Sequence[Rule] | None = None, target: str = "rule_label"
) -> DataFrame:
    return df.withColumn(target, first_match(recipient_rules() if rules is None else rules))


def classify_with_provenance(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    label: str = "recipient_type",
    target: str = "recipient_type_new",
    source: str = "recipient_type_source",
    confidence: str = "recipient_type_confidence",
) -> DataFrame:
    """An existing label wins (an empty one too), then the rules; the rest stay null.

    The label is worked out once and its source is read off it.
    """
    rules = recipient_rules() if rules is None else rules
    existing = F.col(label)
    labelled = df.withColumn(target, F.when(existing.isNotNull(), existing).otherwise(first_match(rules)))
    return labelled.withColumns(
        {
            source: F.when(existing.isNotNull(), F.lit("original")).when(
                F.col(target).isNotNull(), F.lit("deterministic")
            ),
            confidence: F.when(F.col(target).isNotNull(), F.lit(1.0)),
        }
    )


def label_fill(df: DataFrame, label: str = "recipient_type") -> DataFrame:
    """Rows with and without a label."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(label).alias("filled"),
        F.count_if(F.col(label).isNull()).alias("null_count"),
    )
    return counted.select(
        "*",
        percent(F.col("filled"), F.col("total_rows")).alias("filled_pct"),
        percent(F.col("null_count"), F.col("total_rows")).alias("null_pct"),
    )


def classification_coverage(
    df: DataFrame, source: str = "recipient_type_source", sources: Sequence[str] = (
        "original", "deterministic", "llm"
    )
) -> DataFrame:
    """Rows per source of label, rows without one, and the share that has one."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(source) == s).alias(s) for s in sources],
        F.count_if(F.col(source).isNull()).alias("remaining"),
    )
    covered = F.col("total_rows") - F.col("remaining")
    return counted.withColumn("coverage_pct", percent(covered, F.col("total_rows")))


def label_breakdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per label for several label columns in one shuffle."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns]
            )
        )
    )
    return (
        long.groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("column", F.desc("n"), "label")
    )


def rule_breakdown(
    df: DataFrame, target: str = "recipient_type_new", source: str = "recipient_type_source"
) -> DataFrame:
    """Counts per label among the rows that the rules labelled."""
    return label_breakdown(df.filter(F.col(source) == "deterministic"), [target]).drop("column")
