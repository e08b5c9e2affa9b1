"""Entities as connected components of the likely pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.operators.blocking import with_unique_id
from rosterlink.operators.lookups import lookup_join
from rosterlink.operators.profiling import percent
from rosterlink.sources.tables import materialize


#: Links that one task holds at a time.
TASK_LINKS = 1_000_000


def forest(task_links: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a partition of links ``(a, b)``: each node with the least node it hangs
    together with there. It starts anew whenever it holds ``task_links`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x: object) -> object:
            while (higher := up.setdefault(x, x)) != x:
                up[x] = up[higher]
                x = higher
            return x

        def told(kind: pa.DataType) -> pa.RecordBatch:
            rows = [(x, top(x)) for x in list(up)]
            rows = [r for r in rows if r[0] != r[1]]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], ["a", "b"])

        kind = None
        for batch in batches:
            kind = batch["a"].type
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= task_links:
                yield told(kind)
        if up:
            yield told(kind)

    return run


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links on disk, with their number and a checksum of 128 bits that their order does
    not change. Both are read back, so a task that ran twice counts once."""
    live = materialize(links, "links")
    sums = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(38,0)")) for seed in (0, 1)]
    return live, tuple(live.agg(F.count(F.lit(1)), *sums).first())


def connected_components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, component)`` for every node of an edge table ``(a, b)``; the component is
    its least node. Null nodes have no links, and a node linked with itself alone is left out.

    Before anything is shuffled, each partition reduces its links to a forest: a link for each
    node but the roots. While these are more than one task holds, rounds follow: every node
    links its larger neighbours to the least node it knows, then its smaller neighbours and
    itself; what is left in the end are stars around least nodes. A node's neighbours are only
    reduced to a least value and joined back, so a node with very many of them is no burden.
    Each round is written out; one that changes nothing is the last. Where one task holds all
    links, its forest is the result.
    """
    kind = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}"
    known = edges.select("a", "b").dropna()
    live, seen = _written(known.mapInArrow(forest(task_links), kind))
    before: tuple = ()
    while seen[0] > task_links and seen != before:
        before = seen
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            live.select(F.col("a").alias("v"), F.col("b").alias("a"))
            .join(least, "a")
            .filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(own, "a").select(moved.alias("a"), F.col("m").alias("b"))
        live, seen = _written(small.filter(F.col("a") != F.col("b")).distinct())
    if seen != before:
        # One task holds them all: their number has just been counted.
        live = materialize(live.coalesce(1).mapInArrow(forest(2 * seen[0] + 2), kind), "stars")
    stars = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = live.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)


def cluster_pairs(
    pairs: DataFrame,
    nodes: DataFrame,
    threshold: float = V.CLUSTER_THRESHOLD,
    id: str = "id",
) -> DataFrame:
    """Cluster of every node over the pairs at or above the threshold; the cluster id is the
    least node id, and a node without such a pair is a cluster of its own."""
    edges = pairs.filter(F.col("match_probability") >= threshold).select(
        F.col("id_l").alias("a"), F.col("id_r").alias("b")
    )
    members = connected_components(edges)
    return nodes.join(members.withColumnRenamed("node", id), id, "left").select(
        *nodes.columns, F.coalesce("component", id).alias("cluster_id")
    )


def assign_cluster_ids(clusters: DataFrame, dense: bool = False) -> DataFrame:
    """Cluster ids that hold over all shards. The least record id is unique already;
    ``dense`` numbers the clusters from 0 without gaps."""
    if not dense:
        return clusters
    numbered = with_unique_id(
        clusters.select("cluster_id").distinct().orderBy("cluster_id"), name="_dense"
    )
    return (
        lookup_join(clusters, numbered, ["cluster_id"])
        .drop("cluster_id")
        .withColumnRenamed("_dense", "cluster_id")
    )


def shard_report(
    records: DataFrame,
    clusters: DataFrame,
    shards: Sequence[str] = tuple(V.RECIPIENT_TYPES),
    shard: str = "recipient_type",
) -> DataFrame:
    """Rows, entities and status of every shard, absent ones included.

    A shard with fewer than two rows is not linked: its rows are its entities.
    """
    spark = records.sparkSession
    wanted = spark.createDataFrame([(s,) for s in shards], f"{shard} string")
    rows = records.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))
    entities = (
        clusters.select(shard, "cluster_id")
        .distinct()
        .groupBy(shard)
        .agg(F.count(F.lit(1)).alias("found"))
    )
    skipped = F.col("n_rows") < 2
    # All three have one row per shard once grouped.
    return (
        wanted.join(rows, shard, "left")
        .join(entities, shard, "left")
        .select(shard, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "found")
        .select(
            shard,
            "n_rows",
            F.when(skipped, F.col("n_rows"))
            .otherwise(F.coalesce("found", F.lit(0)))
            .alias("entities"),
            F.when(skipped, F.lit("skipped (too few)")).otherwise(F.lit("ok")).alias("status"),
        )
        .orderBy(shard)
    )


def linkage_totals(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows in, rows linked, entities by a true distinct count, and the reduction."""
    entities = clusters.select("cluster_id").distinct().agg(F.count(F.lit(1))).scalar()
    linked = clusters.agg(F.count(F.lit(1))).scalar()
    counted = records.agg(
        F.count(F.lit(1)).alias("rows_processed"),
    ).select("rows_processed", linked.alias("rows_linked"), entities.alias("entities"))
    return counted.withColumn(
        "reduction_pct", percent(F.col("rows_processed") - F.col("entities"), F.col("rows_processed"))
    )
