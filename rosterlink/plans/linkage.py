"""Linking and clustering from end to end, all shards in one go."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.functions.levels import LinkageModel
from rosterlink.operators.blocking import collapse_profiles, shard_filter
from rosterlink.operators.cells import candidate_vectors, linking_vectors, reachable_vectors
from rosterlink.operators.clustering import connected_components
from rosterlink.operators.comparing import attach_term_frequencies, tf_carried
from rosterlink.operators.lookups import lookup_join
from rosterlink.operators.normalizing import add_stripped_name, blank_to_null
from rosterlink.operators.scoring import score_pairs
from rosterlink.operators.training import gamma_patterns, train
from rosterlink.sources.tables import materialize


@dataclass
class Linkage:
    """Result of a run: the records with their cluster, and what it was built from."""

    clusters: DataFrame
    params: DataFrame
    pairs: DataFrame
    profiles: DataFrame


def linkage_records(df: DataFrame) -> DataFrame:
    """Blanks become nulls and the prefix-free name is added."""
    return add_stripped_name(blank_to_null(df))


PROFILE_KEY = ["_key_1", "_key_2"]


def with_profile_key(df: DataFrame, model: LinkageModel = LinkageModel()) -> DataFrame:
    """A 128-bit digest of the linkage columns. Digests skip nulls, so the places of the
    nulls go in too."""
    columns = [model.shard, *model.columns]
    places = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return df.withColumns(
        {k: F.xxhash64(F.lit(number), places, *columns) for number, k in enumerate(PROFILE_KEY)}
    )


def cluster_records(
    records: DataFrame,
    profiles: DataFrame,
    scored: DataFrame,
    model: LinkageModel = LinkageModel(),
    threshold: float = V.CLUSTER_THRESHOLD,
) -> DataFrame:
    """Carries the clusters of profiles over to their records; ``scored`` should be written.

    The copies of a profile belong together if the pair they form is likely enough, or if the
    profile is linked to another one, since then each copy is linked to that. Otherwise every
    copy is a cluster of its own.
    """
    likely = scored.filter(F.col("match_probability") >= threshold)
    between = F.col("id_l") != F.col("id_r")
    edges = likely.filter(between).select(F.col("id_l").alias("a"), F.col("id_r").alias("b"))
    inside = likely.filter(~between).select(
        F.col("id_l").alias("node"), F.col("id_l").alias("own")
    )
    members = connected_components(edges).join(inside, "node", "full").select(
        F.col("node").alias("id"), F.coalesce("component", "own").alias("_linked")
    )
    labelled = materialize(
        with_profile_key(profiles, model)
        .join(members, "id")
        .select(*PROFILE_KEY, "_linked"),
        "labelled",
    )
    return (
        lookup_join(with_profile_key(records, model), labelled, PROFILE_KEY)
        .withColumn("cluster_id", F.coalesce("_linked", model.id))
        .drop(*PROFILE_KEY, "_linked")
    )


def link_and_cluster(
    df: DataFrame,
    model: LinkageModel = LinkageModel(),
    params: DataFrame | None = None,
    pair_threshold: float = V.PAIR_THRESHOLD,
    cluster_threshold: float = V.CLUSTER_THRESHOLD,
    recall: float = V.PRIOR_RECALL,
    max_pairs: int | None = None,
    keep_unclustered: bool = False,
) -> Linkage:
    """Block, compare, train (unless ``params`` are given), score and cluster.

    Once there are parameters, pairs that cannot reach the pair threshold whatever their
    similarity are dropped before it is worked out. Clusters need no more likely pairs than hang
    their profiles together; ``pairs`` of the result are all of them, scored when they are read.
    ``df`` has a unique ``model.id``. Rows without a known label, and those of shards with
    fewer than two rows, take no part; ``keep_unclustered`` returns them with a null cluster.
    """
    records = linkage_records(df)
    linked = shard_filter(records, model)
    profiles = materialize(collapse_profiles(linked, model), "profiles")
    weighed = materialize(attach_term_frequencies(profiles, model), "weighed")
    carry = tf_carried(model)
    joining = max(pair_threshold, cluster_threshold)
    if params is None:
        # Training looks only at pairs of the first rules; these are compared in full.
        first = list(model.training_rules)
        vectors = materialize(candidate_vectors(weighed, model, carry, only=first), "vectors")
        params = materialize(
            train(linked, profiles, gamma_patterns(vectors, model), model, recall, max_pairs),
            "params",
        )
        parts, links = [vectors], [vectors]
        rest = [r for r in range(1, len(model.blocking) + 1) if r not in first]
        if rest:
            parts.append(reachable_vectors(weighed, params, model, carry, pair_threshold, only=rest))
            links.append(linking_vectors(weighed, params, model, carry, joining, only=rest))
    else:
        parts = [candidate_vectors(weighed, model, carry, params, pair_threshold)]
        links = [candidate_vectors(weighed, model, carry, params, joining, linking=True)]

    def scored(vectors: list[DataFrame]) -> DataFrame:
        return score_pairs(reduce(DataFrame.unionByName, vectors), params, model, pair_threshold)

    clusters = cluster_records(linked, profiles, materialize(scored(links), "scored"), model, cluster_threshold)
    if keep_unclustered:
        others = records.join(
            F.broadcast(linked.select(model.shard).distinct()), model.shard, "left_anti"
        )
        clusters = clusters.unionByName(
            others.withColumn("cluster_id", F.lit(None).cast("bigint")), allowMissingColumns=True
        )
    return Linkage(clusters, params, scored(parts), profiles)
