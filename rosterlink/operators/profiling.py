"""Profiles of a messy table: completeness, distributions, formats and key uniqueness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.functions.text import is_blank, strip
from rosterlink.sources.tables import materialize

EMPTY_LABEL = "(empty)"


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the table has."""
    return [c for c in wanted if c in df.columns]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal; null when there is nothing to divide by."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
    )


def _completeness_sums(columns: Sequence[str]) -> list[Column]:
    return [
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns],
        *[F.count_if(is_blank(F.col(c).cast("string"))).alias(f"_blank_{c}") for c in columns],
    ]


def _completeness_of(c: str) -> dict[str, Column]:
    """What there is to say of a column, from ``_total`` and its sums."""
    total, null, blank = F.col("_total"), F.col(f"_null_{c}"), F.col(f"_blank_{c}")
    filled = total - null - blank
    return {
        "total": total, "filled": filled, "null_count": null, "empty_count": blank,
        "fill_rate": percent(filled, total),
    }


def completeness(df: DataFrame, columns: Sequence[str] = tuple(V.KEY_COLUMNS)) -> DataFrame:
    """Filled, null and blank counts per column, from one pass over the table."""
    columns = present(df, columns)
    counted = df.agg(F.count(F.lit(1)).alias("_total"), *_completeness_sums(columns))
    rows = [
        F.struct(F.lit(c).alias("column"), *[x.alias(n) for n, x in _completeness_of(c).items()])
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows))).orderBy("fill_rate", "column")


def null_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and share per column, for a table whose blanks are nulls already."""
    return (
        completeness(df, columns)
        .select("column", "null_count", percent(F.col("null_count"), F.col("total")).alias("null_pct"))
        .orderBy(F.desc("null_count"), "column")
    )


def value_distribution(df: DataFrame, column: str, empty_label: str = EMPTY_LABEL) -> DataFrame:
    """Count and share of each value; null and the empty string share one label."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(empty_label))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total)).orderBy(F.desc("n"), "value")


def id_format_census(
    df: DataFrame,
    column: str = "recipient_business_number",
    placeholders: Sequence[str] = tuple(V.CENSUS_PLACEHOLDERS),
) -> DataFrame:
    """Format classes of an identifier. They overlap, and ``other_format`` is the remainder
    after subtracting each of them, so it can come out too low."""
    counted = df.agg(F.count(F.lit(1)).alias("_total"), *_format_sums(column, placeholders))
    return counted.select(*[x.alias(n) for n, x in _formats().items()])


def _format_sums(column: str, placeholders: Sequence[str]) -> list[Column]:
    c = strip(F.col(column).cast("string"))
    return [
        F.count_if(c.isNull() | (c == "")).alias("_missing"),
        F.count_if(c.rlike(r"\A\p{Nd}+\z")).alias("_all_digits"),
        F.count_if(c.rlike("(?iU)RT")).alias("_has_rt_suffix"),
        F.count_if(c.rlike("(?iU)RP")).alias("_has_rp_suffix"),
        F.count_if(c.isin(*placeholders)).alias("_placeholder"),
    ]


def _formats() -> dict[str, Column]:
    """The census from ``_total`` and the sums."""
    total, missing = F.col("_total"), F.col("_missing")
    classes = {k: F.col(f"_{k}") for k in ("all_digits", "has_rt_suffix", "has_rp_suffix", "placeholder")}
    return {
        "total_rows": total, "missing": missing, "has_value": total - missing, **classes,
        "other_format": reduce(lambda rest, k: rest - k, classes.values(), total - missing),
        "coverage_pct": percent(total - missing, total),
    }


def _separator_sums(columns: Sequence[str], separator: str) -> list[Column]:
    return [F.count_if(F.contains(F.col(c), F.lit(separator))).alias(f"_with_{c}") for c in columns]


def _separators(c: str) -> dict[str, Column]:
    own = F.col(f"_with_{c}")
    return {"with_separator": own, "pct": percent(own, F.col("_total"))}


def separator_census(
    df: DataFrame, columns: Sequence[str] = tuple(V.BILINGUAL_COLUMNS), separator: str = "|"
) -> DataFrame:
    """Rows per column whose value holds the separator."""
    columns = present(df, columns)
    counted = df.agg(F.count(F.lit(1)).alias("_total"), *_separator_sums(columns, separator))
    rows = [
        F.struct(F.lit(c).alias("column"), *[x.alias(n) for n, x in _separators(c).items()])
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows))).orderBy(F.desc("with_separator"), "column")


def top_k_values(
    df: DataFrame, column: str = "owner_org", k: int = 20, empty_label: str = EMPTY_LABEL
) -> DataFrame:
    """The k most frequent values, ties in value order."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(empty_label))
    return (
        df.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )


def distinct_name_census(
    df: DataFrame, column: str = "recipient_legal_name", approximate: bool = False
) -> DataFrame:
    """Distinct names after stripping, after lower-casing too, and the case collisions.

    Every exact name has one lower-case form, so grouping the exact names by that form gives
    both exact counts with single-key shuffles.
    """
    name = strip(F.col(column).cast("string"))
    if approximate:
        counted = df.agg(
            F.approx_count_distinct(name).alias("distinct_exact"),
            F.approx_count_distinct(F.lower(name)).alias("distinct_lower"),
        )
    else:
        return _case_census(df.select(name.alias("name")).dropna().distinct())
    return counted.withColumn("case_collisions", F.col("distinct_exact") - F.col("distinct_lower"))


def _case_census(names: DataFrame) -> DataFrame:
    """The census from the different names."""
    lowered = names.groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("k"))
    counted = lowered.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("distinct_exact"),
        F.count(F.lit(1)).alias("distinct_lower"),
    )
    return counted.withColumn("case_collisions", F.col("distinct_exact") - F.col("distinct_lower"))


def _key_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.select(strip(F.col(column).cast("string")).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def key_uniqueness(df: DataFrame, column: str = "ref_number") -> DataFrame:
    """How far a column is from being a key; blanks are left out."""
    filled = F.col("key").isNotNull() & (F.col("key") != "")
    rows = F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0))
    counted = _key_counts(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        rows.alias("non_empty"),
        F.count_if(filled).alias("distinct_keys"),
    )
    excess = F.col("non_empty") - F.col("distinct_keys")
    return counted.select(
        "*", excess.alias("duplicates"), (excess == 0).alias("all_unique")
    )


def key_uniqueness_with_null(df: DataFrame, column: str = "ref_number") -> DataFrame:
    """Short form: null counts as one more value and nothing is stripped."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
    ).withColumn("duplicates", F.col("total_rows") - F.col("distinct_keys"))


def duplicate_keys(df: DataFrame, column: str = "ref_number") -> DataFrame:
    """The keys that occur more than once."""
    return _key_counts(df, column).filter((F.col("key") != "") & (F.col("n") > 1))


def audit_filter(df: DataFrame, equals: Mapping[str, object], columns: Sequence[str]) -> DataFrame:
    """Rows where every named column has the given value, for a closer look."""
    conditions = [F.col(c) == F.lit(v) for c, v in equals.items()]
    return df.filter(reduce(lambda a, b: a & b, conditions)).select(*present(df, columns))


def matches_any(columns: Sequence[str], term: str, regex: bool = False) -> Column:
    """Case-insensitive match in any of several nullable columns; ``term`` is plain text
    unless ``regex``."""
    if regex:
        tests = [F.col(c).rlike("(?iU)" + term) for c in columns]
    else:
        tests = [F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search_any(
    df: DataFrame,
    term: str,
    columns: Sequence[str] = tuple(V.NAME_COLUMNS),
    regex: bool = False,
) -> DataFrame:
    return df.filter(matches_any(present(df, columns), term, regex))


def type_spread(
    df: DataFrame,
    term: str,
    columns: Sequence[str] = tuple(V.NAME_COLUMNS),
    type_column: str = "recipient_type",
) -> DataFrame:
    """Categories found under one search term, with the number of categories beside them."""
    counts = (
        search_any(df, term, columns).groupBy(type_column).agg(F.count(F.lit(1)).alias("n"))
    )
    categories = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("n_categories", categories).orderBy(F.desc("n"), type_column)


def sample_per_group(df: DataFrame, key: str, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows of each group in the given order; null is a group of its own."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def head_sample(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def _labelled(column: str, empty_label: str = EMPTY_LABEL) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(empty_label))


def profile_report(
    df: DataFrame, owner_column: str = "owner_org", separator: str = "|", top: int = 20
) -> DataFrame:
    """All sections in one long table: section, key, metric and value.

    Two scans of the table: one aggregate for everything that is a count over all rows, and one
    count of values, written out, for the sections that need values.
    """
    keys, named = present(df, V.KEY_COLUMNS), present(df, V.BILINGUAL_COLUMNS)
    none = F.lit(None).cast("string")
    rows: list[Column] = []

    def add(section: str, key: Column, metrics: Mapping[str, Column]) -> None:
        rows.extend(
            F.struct(
                F.lit(section).alias("section"), key.alias("key"), F.lit(n).alias("metric"),
                x.cast("double").alias("value"),
            )
            for n, x in metrics.items()
        )

    add("shape", none, {"total_rows": F.col("_total"), "total_columns": F.lit(len(df.columns))})
    sums = [F.count(F.lit(1)).alias("_total"), *_completeness_sums(keys)]
    for c in keys:
        add("completeness", F.lit(c), _completeness_of(c))
    if "recipient_business_number" in df.columns:
        sums += _format_sums("recipient_business_number", V.CENSUS_PLACEHOLDERS)
        add("business_number_formats", none, _formats())
    sums += _separator_sums(named, separator)
    for c in named:
        add("bilingual_names", F.lit(c), _separators(c))
    parts = [df.agg(*sums).select(F.inline(F.array(*rows)))]
    sources = {}
    if "recipient_type" in df.columns:
        sources["recipient_types"] = _labelled("recipient_type")
    if owner_column in df.columns:
        sources["top_owner_orgs"] = _labelled(owner_column)
    if "recipient_legal_name" in df.columns:
        sources["unique_names"] = strip(F.col("recipient_legal_name").cast("string"))
    if not sources:
        return parts[0]
    values = [F.struct(F.lit(k).alias("section"), x.alias("value")) for k, x in sources.items()]
    counts = materialize(
        df.select(F.inline(F.array(*values))).groupBy("section", "value").agg(F.count(F.lit(1)).alias("n")),
        "value-counts",
    )

    def long(section: str, part: DataFrame, key: Column, metrics: Sequence[str]) -> DataFrame:
        structs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return part.select(F.lit(section).alias("section"), key.alias("key"), F.inline(F.array(*structs)))

    def of(section: str) -> DataFrame:
        return counts.filter(F.col("section") == section)

    if "recipient_types" in sources:
        total = of("recipient_types").agg(F.sum("n")).scalar()
        types = of("recipient_types").withColumn("pct", percent(F.col("n"), total))
        parts.append(long("recipient_types", types, F.col("value"), ["n", "pct"]))
    if "top_owner_orgs" in sources:
        best = of("top_owner_orgs").orderBy(F.desc("n"), "value").limit(top)
        parts.append(long("top_owner_orgs", best, F.col("value"), ["n"]))
    if "unique_names" in sources:
        names = _case_census(of("unique_names").select(F.col("value").alias("name")).dropna())
        parts.append(long("unique_names", names, none, names.columns))
    return reduce(DataFrame.unionByName, parts)
