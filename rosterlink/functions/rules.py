"""Ordered first-match rules folded into one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlink.functions import vocabulary as V
from rosterlink.functions.text import strip

UNICODE_IGNORE_CASE = "(?iU)"


@dataclass(frozen=True)
class Rule:
    """One arm: rows for which ``condition(column)`` holds get ``label``."""

    column: str
    kind: str  # "filled", "words" (case-insensitive), "pattern" (as written), "person"
    label: str
    pattern: str = ""

    def condition(self) -> Column:
        c = F.col(self.column)
        if self.kind == "filled":
            return c != ""
        if self.kind == "words":
            return c.rlike(UNICODE_IGNORE_CASE + self.pattern)
        if self.kind == "pattern":
            return c.rlike(self.pattern)
        if self.kind == "person":
            return person_name_pattern(c)
        raise ValueError(f"unknown rule kind {self.kind!r}")


def recipient_rules(
    name: str = "recipient_legal_name_en",
    research: str = "research_organization_name_en",
    number: str = "bn_raw",
) -> list[Rule]:
    """The default rule list; the first arm that holds decides."""
    return [
        Rule(research, "filled", "S"),
        Rule(name, "words", "S", V.SCHOOL_WORDS),
        Rule(number, "pattern", "N", V.CHARITY_NUMBER),
        Rule(name, "words", "F", V.COMPANY_WORDS),
        Rule(name, "words", "N", V.NONPROFIT_WORDS),
        Rule(name, "words", "A", V.INDIGENOUS_WORDS),
        Rule(name, "words", "G", V.GOVERNMENT_WORDS),
        Rule(name, "words", "N", V.HOSPITAL_WORDS),
        Rule(name, "words", "N", V.WORSHIP_WORDS),
        Rule(name, "words", "N", V.MUSEUM_WORDS),
        Rule(name, "words", "F", V.MEDIA_WORDS),
        Rule(name, "person", "P"),
    ]


def person_name_pattern(c: Column) -> Column:
    """``surname, given``: one comma, a short end, few words before it and 2 to 4 in all."""
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    after = F.regexp_extract(c, r"(?d)\A[^,]*, ?(.*)\z", 1)
    before = F.regexp_extract(c, r"\A([^,]*),", 1)
    return (
        (commas == 1)
        & (F.length(after) <= 18)
        & (F.size(F.split(strip(before), " ")) <= 2)
        & F.size(F.split(c, " ")).between(2, 4)
    )


def first_match(rules: Sequence[Rule]) -> Column:
    """Label of the first rule that holds; a null operand means the rule does not hold."""
    if not rules:
        return F.lit(None).cast("string")
    head, *rest = rules
    folded = F.when(head.condition(), F.lit(head.label))
    for rule in rest:
        folded = folded.when(rule.condition(), F.lit(rule.label))
    return folded
