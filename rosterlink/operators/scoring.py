"""Match probability of candidate pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.functions.levels import Comparison, Exact, LinkageModel

SLACK = 1e-6  # bits, far above rounding of a sum of a few weights


def level_weights(params: DataFrame, model: LinkageModel) -> DataFrame:
    """One row per shard with a column per level: log2(m/u), and u of the equal level."""
    picked = []
    for c in model.comparisons:
        mine = F.col("comparison") == c.column
        for level in c.codes:
            at = mine & (F.col("level") == level)
            picked.append(
                F.max(F.when(at, F.log2(F.col("m") / F.col("u")))).alias(f"w_{c.gamma}_{level}")
            )
        if c.term_frequency:
            picked.append(
                F.max(F.when(mine & (F.col("level") == 0), F.col("u"))).alias(f"u_{c.gamma}")
            )
    return params.groupBy(F.col("shard").alias(model.shard)).agg(
        F.max(F.log2(F.col("prior") / (1 - F.col("prior")))).alias("w_prior"), *picked
    )


def _known(weight: Column, model: LinkageModel) -> Column:
    """The weight; a pair whose shard or level the parameters lack fails the query, since it
    would be lost without a word otherwise.
    """
    told = F.concat(F.lit("no parameters for a pair of shard "), F.col(model.shard))
    return F.coalesce(weight, F.raise_error(told).cast("double"))


def _best_case(c: Comparison) -> Column:
    """The most that a comparison can add before any similarity is known."""
    missing = F.col(f"l_{c.column}").isNull() | F.col(f"r_{c.column}").isNull()
    folded = F.when(missing, F.lit(0.0))
    open_levels: list[Column] = []

    def highest(own: Column) -> Column:
        return F.greatest(*open_levels, own) if open_levels else own

    for number, level in enumerate(c.levels):
        weight = F.col(f"w_{c.gamma}_{number}")
        if not isinstance(level, Exact):
            open_levels.append(weight)
            continue
        if number == 0 and c.term_frequency:
            weight = weight + F.log2(F.col(f"u_{c.gamma}") / F.col(f"tf_{c.column}"))
        folded = folded.when(level.condition(), highest(weight))
    return folded.otherwise(highest(F.col(f"w_{c.gamma}_{len(c.levels)}")))


def reachable_pairs(
    pairs: DataFrame,
    params: DataFrame,
    model: LinkageModel = LinkageModel(),
    threshold: float = V.PAIR_THRESHOLD,
) -> DataFrame:
    """Drops the pairs that stay below the threshold however similar their texts are.

    Equal and missing values settle most of a pair's weight without Python, so similarities
    are worked out only where they can matter. No pair that ``score_pairs`` would keep is lost.
    """
    if threshold <= 0:
        return pairs
    best = F.col("w_prior")
    for c in model.comparisons:
        best = best + _best_case(c)
    needed = math.log2(threshold / max(1 - threshold, 1e-300)) - SLACK
    joined = pairs.join(F.broadcast(level_weights(params, model)), model.shard, "left")
    return joined.filter(_known(best, model) >= needed).select(*pairs.columns)


def score_pairs(
    vectors: DataFrame,
    params: DataFrame,
    model: LinkageModel = LinkageModel(),
    threshold: float = V.PAIR_THRESHOLD,
) -> DataFrame:
    """Adds the match weight in bits and the probability, and keeps the likely pairs.

    A missing value counts nothing. Equal values of a column with term frequencies count
    more the rarer they are. The weight table has one row per shard.
    """
    weights = level_weights(params, model)
    by_level = [
        F.array(*[f"w_{c.gamma}_{level}" for level in c.codes]).alias(f"w_{c.gamma}") for c in model.comparisons
    ]
    told = [f"u_{c.gamma}" for c in model.comparisons if c.term_frequency]
    weights = weights.select(model.shard, "w_prior", *by_level, *told)
    weight = F.col("w_prior")
    for c in model.comparisons:
        gamma = F.col(c.gamma)
        settled = gamma.between(c.codes[0], c.codes[-1])
        weight = weight + F.when(settled, F.get(f"w_{c.gamma}", gamma)).otherwise(F.lit(0.0))
        if c.term_frequency:
            rarity = F.log2(F.col(f"u_{c.gamma}") / F.col(f"tf_{c.column}"))
            weight = weight + F.when(gamma == 0, rarity).otherwise(F.lit(0.0))
    joined = vectors.join(F.broadcast(weights), model.shard, "left")
    # Written out in the filter and in the columns, the weight is more code than the JVM compiles;
    # as the value of a generator it is worked out once.
    scored = joined.select(
        *vectors.columns, F.explode(F.array(_known(weight, model))).alias("match_weight")
    ).withColumn(
        "match_probability", 1.0 / (1.0 + F.pow(F.lit(2.0), -F.col("match_weight")))
    )
    return scored.filter(F.col("match_probability") >= threshold)
