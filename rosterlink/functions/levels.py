"""Comparison levels: how alike two values are, as a small integer.

A code is 0 for the best level that holds, then 1, 2, ...; the last code means that none
holds, and ``NULL_LEVEL`` that a side is missing. The two sides of a pair are columns with
the prefixes ``l_`` and ``r_``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V

NULL_LEVEL = -1


@dataclass(frozen=True)
class Exact:
    """Both sides equal."""

    column: str

    def condition(self) -> Column:
        return F.col(f"l_{self.column}") == F.col(f"r_{self.column}")


@dataclass(frozen=True)
class Similar:
    """Jaro-Winkler similarity of at least ``threshold``, read from a ``jw_`` column."""

    column: str
    threshold: float

    def condition(self) -> Column:
        return F.col(f"jw_{self.column}") >= F.lit(self.threshold)


@dataclass(frozen=True)
class Comparison:
    """Ordered levels over one column; ``term_frequency`` corrects level 0 by rarity."""

    column: str
    levels: tuple[Exact | Similar, ...]
    term_frequency: bool = False

    @property
    def gamma(self) -> str:
        return f"g_{self.column}"

    @property
    def codes(self) -> range:
        return range(len(self.levels) + 1)

    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.column, *[x.column for x in self.levels]]))

    def similar_columns(self) -> list[str]:
        return list(dict.fromkeys(x.column for x in self.levels if isinstance(x, Similar)))

    def unsettled(self, column: str) -> Column:
        """True where the similarity of ``column`` is needed: both sides are there and no
        exact level decides."""
        decided = [x.condition() for x in self.levels if isinstance(x, Exact)]
        both = F.col(f"l_{column}").isNotNull() & F.col(f"r_{column}").isNotNull()
        return both & ~reduce(lambda a, b: a | b, [F.coalesce(d, F.lit(False)) for d in decided])

    def code(self) -> Column:
        missing = F.col(f"l_{self.column}").isNull() | F.col(f"r_{self.column}").isNull()
        folded = F.when(missing, F.lit(NULL_LEVEL))
        for number, level in enumerate(self.levels):
            folded = folded.when(level.condition(), F.lit(number))
        return folded.otherwise(F.lit(len(self.levels))).cast("int").alias(self.gamma)


def compare_exact(column: str, term_frequency: bool = False) -> Comparison:
    """Equal or not."""
    return Comparison(column, (Exact(column),), term_frequency)


def compare_name(
    column: str, thresholds: Sequence[float] = tuple(V.NAME_SIMILARITY_LEVELS)
) -> Comparison:
    """Equal, then falling similarity."""
    return Comparison(column, (Exact(column), *[Similar(column, t) for t in thresholds]))


def compare_custom(
    column: str, levels: Sequence[Exact | Similar], term_frequency: bool = False
) -> Comparison:
    """Any ordered levels over the columns of a record."""
    return Comparison(column, tuple(levels), term_frequency)


@dataclass(frozen=True)
class Key:
    """A blocking key: a whole column or its first ``prefix`` characters."""

    column: str
    prefix: int | None = None

    def on(self, side: str = "") -> Column:
        c = F.col(f"{side}{self.column}")
        return F.substring(c, 1, self.prefix) if self.prefix else c


@dataclass(frozen=True)
class BlockingRule:
    """Pairs whose keys are all equal; a null key never matches."""

    keys: tuple[Key, ...]

    def holds(self) -> Column:
        equal = [k.on("l_") == k.on("r_") for k in self.keys]
        return F.coalesce(reduce(lambda a, b: a & b, equal), F.lit(False))

    def present(self) -> Column:
        return reduce(lambda a, b: a & b, [k.on().isNotNull() for k in self.keys])


def block_on(*keys: str | Key) -> BlockingRule:
    return BlockingRule(tuple(k if isinstance(k, Key) else Key(k) for k in keys))


@dataclass(frozen=True)
class LinkageModel:
    """What to block on, what to compare and how to train; the defaults are for grants."""

    id: str = "unique_id"
    shard: str = "recipient_type"
    shards: tuple[str, ...] = tuple(V.RECIPIENT_TYPES)
    comparisons: tuple[Comparison, ...] = field(
        default_factory=lambda: (
            compare_custom(
                "recipient_legal_name_en",
                [
                    Exact("recipient_legal_name_en"),
                    Exact("recipient_legal_name_stripped_en"),
                    *[Similar("recipient_legal_name_en", t) for t in V.NAME_SIMILARITY_LEVELS],
                ],
                term_frequency=True,
            ),
            compare_name("recipient_legal_name_fr"),
            compare_name("recipient_operating_name_en"),
            compare_exact("recipient_business_number", term_frequency=True),
            compare_exact("recipient_postal_code", term_frequency=True),
            compare_exact("recipient_city"),
            compare_name("research_organization_name_en"),
        )
    )
    blocking: tuple[BlockingRule, ...] = field(
        default_factory=lambda: (
            block_on("recipient_business_number"),
            block_on("recipient_legal_name_en", "recipient_postal_code"),
            block_on("recipient_legal_name_en", "recipient_city"),
            block_on("recipient_postal_code", Key("recipient_legal_name_en", 6)),
            block_on("recipient_city", Key("recipient_legal_name_en", 5)),
            block_on("research_organization_name_en"),
        )
    )
    # Rules that are almost surely right, for the prior, and the columns each training
    # session holds equal.
    prior_rules: tuple[tuple[str, ...], ...] = (
        ("recipient_business_number",),
        ("recipient_legal_name_en", "recipient_postal_code"),
    )
    sessions: tuple[tuple[str, ...], ...] = (
        ("recipient_business_number",),
        ("recipient_legal_name_en", "recipient_postal_code"),
    )

    @property
    def columns(self) -> list[str]:
        """Every column that blocking or a comparison looks at."""
        used = [c for x in self.comparisons for c in x.columns()]
        used += [k.column for rule in self.blocking for k in rule.keys]
        return list(dict.fromkeys(used))

    @property
    def training_rules(self) -> range:
        """The first rules, up to the last that a training session blocks on: their pairs
        hold every pair that a session looks at. All rules, if a session is not one."""
        keys = [
            frozenset(k.column for k in rule.keys) if not any(k.prefix for k in rule.keys) else None
            for rule in self.blocking
        ]
        wanted = [frozenset(s) for s in self.sessions]
        if not all(w in keys for w in wanted):
            return range(1, len(keys) + 1)
        return range(1, max(keys.index(w) for w in wanted) + 2)

    @property
    def gammas(self) -> list[str]:
        return [x.gamma for x in self.comparisons]

    @property
    def tf_columns(self) -> list[str]:
        return [x.column for x in self.comparisons if x.term_frequency]
