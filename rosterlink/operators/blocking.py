"""Record ids, shards, distinct profiles and candidate pairs.

Records that agree in every column the linkage looks at score alike with any third record,
so they are collapsed into one *profile* that carries their number. Pairs are made between
profiles and weighted by how many record pairs they stand for; copies never meet one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.functions.levels import BlockingRule, LinkageModel
from rosterlink.sources.tables import materialize

PAIRS_PER_CELL = 2_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its low 33 bits


def with_unique_id(df: DataFrame, key: str | None = None, name: str = "unique_id") -> DataFrame:
    """A long id per row: a key column that the caller knows to be unique, or a gap-free index.

    The index comes from two passes over a written copy, so that a lost executor cannot
    change it; only one count per partition is broadcast.
    """
    if key:
        return df.withColumn(name, F.col(key).cast("bigint"))
    placed = materialize(
        df.withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}),
        "row-places",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition, so a window over all of them is small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    place = F.col("_mono").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + place).alias(name), *df.columns
    )


def shard_filter(df: DataFrame, model: LinkageModel = LinkageModel()) -> DataFrame:
    """Rows of the known shards with at least two rows; there are few shards, so the list
    of those kept is small."""
    known = df.filter(F.col(model.shard).isin(*model.shards))
    kept = known.groupBy(model.shard).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return known.join(F.broadcast(kept.select(model.shard)), model.shard, "left_semi")


def collapse_profiles(records: DataFrame, model: LinkageModel = LinkageModel()) -> DataFrame:
    """One row per shard and distinct value of the linkage columns: its least id and size."""
    return records.groupBy(model.shard, *model.columns).agg(
        F.min(model.id).alias("id"), F.count(F.lit(1)).alias("n")
    )


def _block_rows(
    profiles: DataFrame, rules: Sequence[BlockingRule], shard: str, only: Sequence[int]
) -> DataFrame:
    """Each profile once per rule whose keys it has, with the digest of its block."""
    blocks = F.array(
        *[
            F.struct(
                F.lit(number).alias("match_rule"),
                F.when(
                    rule.present(),
                    F.xxhash64(F.lit(number), F.col(shard), *[k.on() for k in rule.keys]),
                ).alias("block"),
            )
            for number, rule in enumerate(rules, 1)
            if number in only
        ]
    )
    return profiles.select("*", F.inline(blocks)).filter(F.col("block").isNotNull())


def _side(rows: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return rows.select(
        *[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in rows.columns]
    )


def block_pairs(
    profiles: DataFrame,
    model: LinkageModel = LinkageModel(),
    carry: Sequence[str] = (),
    pairs_per_cell: int = PAIRS_PER_CELL,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """Candidate pairs of profiles, each once, under the first rule that finds it.

    All rules go through one equi-join on (rule, block). A pair that an earlier rule finds
    too is dropped right in the join, so pairs are never shuffled to remove doubles. A large
    block is cut into tiles by a hash and becomes a triangle of cells, one for each two tiles:
    a profile is the left side of the cells of its tile and later ones, and the right side of
    those of its tile and earlier ones. So two profiles of different tiles meet in one cell and
    in one order, and cells are spread over tasks. ``carry`` names further profile columns
    to keep, of one of the two sides: they are for values that both sides share. ``only`` gives
    the numbers of the rules whose pairs are wanted.
    """
    rules = model.blocking
    rows = _block_rows(
        profiles.select("id", "n", model.shard, *model.columns, *carry),
        rules,
        model.shard,
        range(1, len(rules) + 1) if only is None else only,
    )
    sizes = rows.groupBy("match_rule", "block").agg(F.count(F.lit(1)).alias("k"))
    # A block of one profile has no pair, so its rows go no further.
    grids = sizes.filter(F.col("k") > 1).select(
        "match_rule",
        "block",
        F.ceil(F.col("k") / F.lit(pairs_per_cell**0.5)).cast("int").alias("grid"),
    )
    rows = rows.join(grids, ["match_rule", "block"])
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"))
    later = F.explode(F.sequence(F.col("tile"), F.col("grid") - 1))
    earlier = F.explode(F.sequence(F.lit(0), F.col("tile")))
    left = rows.withColumn("high", later).withColumnRenamed("tile", "low").drop("grid")
    right = rows.withColumn("low", earlier).withColumnRenamed("tile", "high").drop("grid", *carry)
    at = ["match_rule", "block", "low", "high"]
    joined = _side(left, "l_", at).join(_side(right.drop(model.shard), "r_", at), at)
    # Profiles of one tile meet in both orders, those of two tiles in one, whichever it is.
    once = (F.col("low") < F.col("high")) | (F.col("l_id") < F.col("r_id"))
    ordered = F.col("l_id") < F.col("r_id")

    def sides(c: str) -> list[Column]:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        return [
            F.when(ordered, a).otherwise(b).alias(f"l_{c}"),
            F.when(ordered, b).otherwise(a).alias(f"r_{c}"),
        ]

    return joined.filter(once & _first_rule(rules)).select(
        F.col(f"l_{model.shard}").alias(model.shard),
        F.least("l_id", "r_id").alias("id_l"),
        F.greatest("l_id", "r_id").alias("id_r"),
        "match_rule",
        (F.col("l_n") * F.col("r_n")).alias("n_pairs"),
        *[x for c in model.columns for x in sides(c)],
        *[F.col(f"l_{c}").alias(c) for c in carry],
    )


def second_digest(rules: Sequence[BlockingRule], shard: str) -> Column:
    """A second digest beside the block's, where nothing is held against the values themselves."""
    other = F.lit(None).cast("bigint")
    for number, rule in enumerate(rules, 1):
        own = F.xxhash64(*[k.on() for k in rule.keys], F.lit(number), F.col(shard))
        other = F.when(F.col("match_rule") == number, own).otherwise(other)
    return other


def block_ends(
    profiles: DataFrame, column: str, model: LinkageModel = LinkageModel()
) -> DataFrame:
    """The profiles with the least or the greatest id of those that share a block and the value of
    ``column``.

    Where two profiles of a block are a pair, the first of the values on the left and the last of
    those on the right are one too, in the same order. So ``block_pairs`` finds the same pairs of
    values of ``column`` between these profiles as between all.
    """
    rules = model.blocking
    rows = _block_rows(profiles.select("id", model.shard, *model.columns), rules, model.shard, range(1, len(rules) + 1))
    other = second_digest(rules, model.shard)
    ends = rows.groupBy("match_rule", "block", other.alias("_block"), column).agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    )
    ids = ends.select(F.explode(F.array("first", "last")).alias("id")).distinct()
    return profiles.join(ids, "id", "left_semi").select(*profiles.columns)


def block_cells(
    profiles: DataFrame,
    model: LinkageModel = LinkageModel(),
    carry: Sequence[str] = (),
    pairs_per_cell: int = PAIRS_PER_CELL,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """The profiles that ``block_pairs`` would pair, once for each cell they belong to.

    The rows of a cell follow each other in one partition, in the order of their ids; ``low``
    and ``high`` are the tiles that meet in the cell, and ``tile`` is the row's own. No pair is
    a row, so this grows with the profiles, and with the tiles of their blocks.
    """
    rules = model.blocking
    rows = _block_rows(
        profiles.select("id", "n", model.shard, *model.columns, *carry),
        rules,
        model.shard,
        range(1, len(rules) + 1) if only is None else only,
    )
    sizes = rows.groupBy("match_rule", "block").agg(F.count(F.lit(1)).alias("k"))
    # A block of one profile has no pair, so its rows go no further.
    grids = sizes.filter(F.col("k") > 1).select(
        "match_rule",
        "block",
        F.ceil(F.col("k") / F.lit(pairs_per_cell**0.5)).cast("int").alias("grid"),
    )
    rows = rows.join(grids, ["match_rule", "block"])
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    at = ["match_rule", "block", "low", "high"]
    cells = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    return cells.drop("grid", "other").repartition(*at).sortWithinPartitions(*at, "id")


def _first_rule(rules: Sequence[BlockingRule]) -> Column:
    """The row's rule holds on the values themselves and no earlier rule does."""
    first = F.lit(False)
    for number, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(rule.holds(), F.col("match_rule") == number).otherwise(first)
    return first


def copy_pairs(
    profiles: DataFrame, model: LinkageModel = LinkageModel(), carry: Sequence[str] = ()
) -> DataFrame:
    """The pairs inside each profile as one row: all of them look the same."""
    rule = F.lit(None).cast("int")
    for number, r in reversed(list(enumerate(model.blocking, 1))):
        rule = F.when(r.present(), F.lit(number)).otherwise(rule)
    return (
        profiles.filter(F.col("n") > 1)
        .withColumn("match_rule", rule)
        .filter(F.col("match_rule").isNotNull())
        .select(
            model.shard,
            F.col("id").alias("id_l"),
            F.col("id").alias("id_r"),
            "match_rule",
            (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"),
            *[F.col(c).alias(f"{s}{c}") for c in model.columns for s in ("l_", "r_")],
            *carry,
        )
    )


def candidate_pairs(
    profiles: DataFrame,
    model: LinkageModel = LinkageModel(),
    carry: Sequence[str] = (),
    pairs_per_cell: int = PAIRS_PER_CELL,
) -> DataFrame:
    """Pairs between profiles and inside them; ``n_pairs`` adds up to all record pairs."""
    return block_pairs(profiles, model, carry, pairs_per_cell).unionByName(
        copy_pairs(profiles, model, carry)
    )


def block_size_report(profiles: DataFrame, model: LinkageModel = LinkageModel()) -> DataFrame:
    """Per rule, before any join: blocks, record pairs, pairs of profiles, largest block."""
    rules = model.blocking
    rows = _block_rows(profiles, rules, model.shard, range(1, len(rules) + 1))
    blocks = rows.groupBy("match_rule", "block").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("profiles")
    )

    def pairs(c: str) -> Column:
        return F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("bigint"))

    return blocks.groupBy("match_rule").agg(
        F.count(F.lit(1)).alias("blocks"),
        pairs("records").alias("record_pairs"),
        pairs("profiles").alias("profile_pairs"),
        F.max("records").alias("largest_block"),
    )


def _pairs_caught(profiles: DataFrame, shard: str, keys: Sequence[str], sign: int) -> DataFrame:
    """Record pairs of each shard that agree in ``keys``, from block sizes alone."""
    blocks = (
        profiles.dropna(subset=list(keys))
        .groupBy(shard, *keys)
        .agg(F.sum("n").cast("double").alias("k"))
    )
    return blocks.groupBy(shard).agg(
        (F.sum(F.col("k") * (F.col("k") - 1) / 2) * sign).alias("caught")
    )


def pairs_caught_by_either(
    profiles: DataFrame, model: LinkageModel = LinkageModel()
) -> DataFrame:
    """Record pairs per shard that satisfy at least one prior rule, by inclusion and
    exclusion over block sizes: no pair is formed."""
    parts = []
    rules = model.prior_rules
    for mask in range(1, 1 << len(rules)):
        chosen = [r for i, r in enumerate(rules) if mask >> i & 1]
        keys = list(dict.fromkeys(k for r in chosen for k in r))
        parts.append(_pairs_caught(profiles, model.shard, keys, 1 if len(chosen) % 2 else -1))
    return (
        reduce(DataFrame.unionByName, parts).groupBy(model.shard).agg(F.sum("caught").alias("caught"))
    )
