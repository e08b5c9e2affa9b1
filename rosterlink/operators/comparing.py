"""Level codes of candidate pairs, and how common each value is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions.levels import Comparison, Exact, LinkageModel, Similar
from rosterlink.functions.similarity import FEW_PAIRS, Texts, at_most, jaro_winkler, similarities, similarity_blocks
from rosterlink.operators.lookups import lookup_join

#: Rounding of a similarity; places of a table per pair that are cheaper to scan than to sort.
SLACK, PLACES = 1e-9, 64


def add_similarities(pairs: DataFrame, model: LinkageModel = LinkageModel()) -> DataFrame:
    """A ``jw_`` column per compared column. Only pairs that no exact level settles are sent
    to Python; the function sees each distinct pair of a batch once."""
    added = {}
    for comparison in model.comparisons:
        for c in comparison.similar_columns():
            wanted = comparison.unsettled(c)
            added[f"jw_{c}"] = jaro_winkler(
                F.when(wanted, F.col(f"l_{c}")), F.when(wanted, F.col(f"r_{c}"))
            )
    return pairs.withColumns(added) if added else pairs


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers, and the place of each pair among them."""
    low = int(min(a.min(), b.min()))
    wide = int(max(a.max(), b.max())) - low + 1
    key = (a - low).astype(np.int64) * wide + (b - low)
    if wide * wide > PLACES * len(key):
        seen, place = np.unique(key, return_inverse=True)
    else:
        there = np.zeros(wide * wide, bool)
        there[key] = True
        seen = np.flatnonzero(there)
        table = np.empty(wide * wide, np.int32)
        table[seen] = np.arange(len(seen))
        place = table[key]
    return seen // wide + low, seen % wide + low, place


def levels_of(
    comparison: Comparison,
    texts: dict[str, tuple[Texts, np.ndarray]],
    i: np.ndarray,
    j: np.ndarray,
    repeats: bool = False,
) -> np.ndarray:
    """The level of each pair of rows. ``texts`` has for each column its distinct texts and the
    number of each row's (-1: null).

    Similarities are worked out only for pairs that no level before has settled and whose
    upper bound reaches the lowest level of their column; with ``repeats``, once for each
    distinct pair of texts.
    """
    out = np.full(len(i), len(comparison.levels))
    open_ = np.ones(len(i), bool)
    known: dict[str, np.ndarray] = {}
    for number, level in enumerate(comparison.levels):
        own, code = texts[level.column]
        a, b = code[i], code[j]
        if isinstance(level, Exact):
            holds = (a == b) & (a >= 0)
        else:
            if level.column not in known:
                least = min(x.threshold for x in comparison.levels if isinstance(x, Similar) and x.column == level.column)
                known[level.column] = np.full(len(i), -1.0)
                at = np.flatnonzero(open_ & (a >= 0) & (b >= 0))
                if len(at):
                    left, right = a[at], b[at]
                    place = None
                    if repeats:
                        left, right, place = distinct_pairs(left, right)
                    alike = np.full(len(left), -1.0)
                    near = np.flatnonzero(at_most(own, left, own, right) >= least - SLACK)
                    alike[near] = similarities(own, left[near], own, right[near], least - SLACK)
                    known[level.column][at] = alike if place is None else alike[place]
            holds = known[level.column] >= level.threshold
        out[open_ & holds] = number
        open_ &= ~holds
    return out


def level_blocks(
    comparison: Comparison, texts: dict[str, tuple[Texts, np.ndarray]], i: np.ndarray, j: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of all rows ``i`` with all rows ``j``, as ``levels_of`` gives them, part by part:
    some of ``i``, some of ``j``, and a matrix of levels with a row for each of the latter. The
    column of the comparison has no null here."""
    if comparison.similar_columns() != [comparison.column]:
        step = max(1, FEW_PAIRS // max(1, len(i)))
        for at in range(0, len(j), step):
            part = j[at : at + step]
            found = levels_of(comparison, texts, np.tile(i, len(part)), np.repeat(part, len(i)))
            yield i, part, found.reshape(len(part), len(i))
        return
    own, code = texts[comparison.column]
    thresholds = [x.threshold for x in comparison.levels if isinstance(x, Similar)]
    for a, b, alike in similarity_blocks(own, code[i], own, code[j], min(thresholds) - SLACK):
        rows, others = i[a], j[b]
        out = np.full(alike.shape, len(comparison.levels), np.int8)
        # From the last level to the first, so that the best one that holds stays.
        for number, level in reversed(list(enumerate(comparison.levels))):
            if isinstance(level, Exact):
                held = texts[level.column][1]
                holds = (held[rows] == held[others, None]) & (held[rows] >= 0)
            else:
                holds = alike >= level.threshold
            out[holds] = number
        yield rows, others, out


def comparison_vectors(
    pairs: DataFrame, model: LinkageModel = LinkageModel(), carry: Sequence[str] = ()
) -> DataFrame:
    """Ids, weight and one level code per comparison; no text is kept."""
    return add_similarities(pairs, model).select(
        model.shard,
        "id_l",
        "id_r",
        "match_rule",
        "n_pairs",
        *[c.code() for c in model.comparisons],
        *carry,
    )


def term_frequencies(
    profiles: DataFrame, column: str, model: LinkageModel = LinkageModel()
) -> DataFrame:
    """Share of each value among the shard's records that have one; ``k`` is the number of
    profiles with it."""
    values = (
        profiles.filter(F.col(column).isNotNull())
        .groupBy(model.shard, column)
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    )
    totals = values.groupBy(model.shard).agg(F.sum("n").alias("total"))
    # One row per shard, so the totals are always small.
    return values.join(F.broadcast(totals), model.shard).select(
        model.shard, column, "k", (F.col("n") / F.col("total")).alias(f"tf_{column}")
    )


def attach_term_frequencies(
    profiles: DataFrame, model: LinkageModel = LinkageModel()
) -> DataFrame:
    """Adds ``tf_`` columns while there is one row per profile, not one per pair."""
    weighed = profiles
    for c in model.tf_columns:
        tf = term_frequencies(profiles, c, model)
        weighed = lookup_join(weighed, tf.drop("k"), [model.shard, c])
    return weighed


def tf_carried(model: LinkageModel = LinkageModel()) -> list[str]:
    return [f"tf_{c}" for c in model.tf_columns]
