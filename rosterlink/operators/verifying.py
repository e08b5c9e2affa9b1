"""Checks on finished clusters: sizes, mixed labels, reduction, search and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.operators.profiling import matches_any, percent, present

NULL_LABEL = "(null)"
SEARCH_COLUMNS = [
    "recipient_legal_name_en",
    "recipient_operating_name_en",
    "research_organization_name_en",
]
SIZE_BUCKETS = [
    ("1 (singleton)", 1),
    ("2", 2),
    ("3-5", 5),
    ("6-10", 10),
    ("11-20", 20),
    ("21-50", 50),
    ("51-100", 100),
]
LAST_BUCKET = "100+"


def attach_attributes(
    clusters: DataFrame, records: DataFrame, columns: Sequence[str], id: str = "unique_id"
) -> DataFrame:
    """Adds those of ``columns`` that the clusters lack, by id; nothing lacking, no join.

    The id must be on both sides and unique in ``records``.
    """
    for side, df in (("clusters", clusters), ("records", records)):
        if id not in df.columns:
            raise ValueError(f"{side} has no column {id!r}")
    missing = [c for c in present(records, columns) if c not in clusters.columns]
    if not missing:
        return clusters
    return clusters.join(records.select(id, *missing), id, "left")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_size_histogram(clusters: DataFrame) -> DataFrame:
    """Number of clusters of each exact size."""
    return (
        cluster_sizes(clusters)
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("n_clusters"))
        .orderBy("size")
    )


def cluster_overview(clusters: DataFrame) -> DataFrame:
    """Everything follows from the histogram, which is small: exact median included."""
    sizes = cluster_sizes(clusters).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    counted = sizes.agg(
        F.coalesce(F.sum(F.col("size") * F.col("k")), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_clusters"),
        F.percentile("size", 0.5, F.col("k")).alias("median_size"),
        F.max("size").alias("max_size"),
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("k"))), F.lit(0)).alias("singletons"),
    )
    rows, found = F.col("total_rows"), F.col("n_clusters")
    return counted.select(
        "total_rows",
        "n_clusters",
        F.round(F.try_divide(rows, found), 1).alias("mean_size"),
        "median_size",
        "max_size",
        "singletons",
        percent(F.col("singletons"), found).alias("singleton_pct"),
        percent(rows - found, rows).alias("reduction_pct"),
    )


def cluster_size_buckets(clusters: DataFrame) -> DataFrame:
    """Clusters and rows per size bucket, in the order of the sizes."""
    sizes = cluster_sizes(clusters).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    label = F.lit(LAST_BUCKET)
    place = F.lit(len(SIZE_BUCKETS))
    for number, (name, most) in reversed(list(enumerate(SIZE_BUCKETS))):
        label = F.when(F.col("size") <= most, F.lit(name)).otherwise(label)
        place = F.when(F.col("size") <= most, F.lit(number)).otherwise(place)
    grouped = sizes.groupBy(place.alias("bucket_no"), label.alias("size_bucket")).agg(
        F.sum("k").alias("n_clusters"), F.sum(F.col("size") * F.col("k")).alias("total_rows")
    )
    total = grouped.agg(F.sum("total_rows")).scalar()
    return grouped.withColumn("pct_of_rows", percent(F.col("total_rows"), total)).orderBy(
        "bucket_no"
    )


def largest_clusters(clusters: DataFrame, k: int = 20) -> DataFrame:
    return cluster_sizes(clusters).orderBy(F.desc("size"), "cluster_id").limit(k)


def _members(df: DataFrame, chosen: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Rows of the chosen clusters."""
    rows = df.join(chosen.select("cluster_id"), "cluster_id", "left_semi")
    return rows.select(*present(df, columns)) if columns else rows


def largest_cluster_detail(
    clusters: DataFrame, k: int = 20, columns: Sequence[str] | None = None
) -> DataFrame:
    return _members(clusters, largest_clusters(clusters, k), columns)


def cross_type_clusters(df: DataFrame, label: str = "recipient_type") -> DataFrame:
    """Clusters with more than one label, most labels first; null counts as a label."""
    pairs = df.groupBy("cluster_id", F.coalesce(label, F.lit(NULL_LABEL)).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        pairs.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("size"))
        .filter(F.col("n_types") > 1)
        .orderBy(F.desc("n_types"), F.desc("size"), "cluster_id")
    )


def cross_type_summary(df: DataFrame, label: str = "recipient_type") -> DataFrame:
    """How many entities have mixed labels, and their share."""
    pairs = df.select("cluster_id", F.coalesce(label, F.lit(NULL_LABEL)).alias("label")).distinct()
    per_cluster = pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_types"))
    counted = per_cluster.agg(
        F.count_if(F.col("n_types") > 1).alias("n_inconsistent"),
        F.count(F.lit(1)).alias("entities"),
    )
    return counted.withColumn(
        "pct_inconsistent", percent(F.col("n_inconsistent"), F.col("entities"))
    )


def cross_type_detail(
    df: DataFrame, k: int = 10, label: str = "recipient_type", columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the clusters with the most mixed labels."""
    return _members(df, cross_type_clusters(df, label).limit(k), columns)


def reduction_by(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Rows, entities and what linking removed, per value of ``key``."""
    pairs = df.groupBy(key, "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = pairs.groupBy(key).agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("entities")
    )
    removed = F.col("total_rows") - F.col("entities")
    report = grouped.select(
        "*",
        removed.alias("rows_eliminated"),
        percent(removed, F.col("total_rows")).alias("reduction_pct"),
    ).orderBy(F.desc("total_rows"), key)
    return report.limit(k) if k else report


def matched_clusters(
    df: DataFrame,
    term: str,
    columns: Sequence[str] = tuple(SEARCH_COLUMNS),
    regex: bool = False,
) -> DataFrame:
    """Clusters with a row whose names match, and how many of its rows do."""
    found = matches_any(present(df, columns), term.strip(), regex)
    return df.filter(found).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("matches"))


def entity_search(
    df: DataFrame,
    term: str,
    id: str = "unique_id",
    columns: Sequence[str] = tuple(SEARCH_COLUMNS),
    regex: bool = False,
) -> DataFrame:
    """All rows of every cluster that has a matching row."""
    if not term.strip():
        raise ValueError("give a name or part of a name to search for")
    hits = matched_clusters(df, term, columns, regex).select("cluster_id")
    return df.join(hits, "cluster_id", "left_semi").select(*df.columns)


def search_counts(
    df: DataFrame,
    term: str,
    columns: Sequence[str] = tuple(SEARCH_COLUMNS),
    regex: bool = False,
) -> DataFrame:
    return matched_clusters(df, term, columns, regex).agg(
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
        F.count(F.lit(1)).alias("entities"),
    )


def sample_clusters(
    df: DataFrame, k: int = 10, seed: int = 42, columns: Sequence[str] | None = None
) -> DataFrame:
    """All rows of k clusters picked by a seeded digest: the same clusters every time."""
    digest: Column = F.md5(F.concat_ws(":", F.col("cluster_id").cast("string"), F.lit(str(seed))))
    chosen = df.select("cluster_id").distinct().orderBy(digest, "cluster_id").limit(k)
    return _members(df, chosen, columns)
