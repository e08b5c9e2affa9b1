"""Language of a text: first its family, then one-versus-one linear support vector machines.

Families are learned: languages whose mean vectors are closest are joined, by average link,
until about the square root of their number is left (or they are given). One machine for each
pair of families picks the family by votes; inside it, one machine for each pair of languages
separates the close relatives, again by votes. Ties go to the greater sum of margins.

A text is the square roots of its counts of hashed character n-grams of one to three
characters, in lower case, with everything that is no letter as one blank. Whole texts count.
Machines are trained on the squared hinge loss with a quadratic penalty, on a bounded sample
of labelled documents, spread evenly over the languages (``SAMPLE`` in all, by a hash).

Text that is null or has no letter is ``und`` with score 0; so is all text if there is
nothing to learn from. Equal texts get equal answers. Only ``text`` is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import SHARES, sample_slots, ship, shipped

#: Labelled documents to learn from in all; hashed n-grams.
SAMPLE, WIDTH_BITS = 2_000, 12
WIDTH = 1 << WIDTH_BITS
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def vector(text: str, letters: np.ndarray) -> np.ndarray | None:
    """The n-gram vector of a text, of length 1, or ``None`` if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where(letters[c], c, np.uint64(32))
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    blank = c == 32
    c = c[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(c) < 2:
        return None
    shift = np.uint64(21)
    pairs = c[:-1] << shift | c[1:]
    threes = (pairs[:-1] << shift | c[2:]) + np.uint64(1)
    grams = np.concatenate([c[1:-1], pairs, threes])
    slots = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WIDTH_BITS)
    counts = np.sqrt(np.bincount(slots.astype(np.int64), minlength=WIDTH)).astype(np.float32)
    return counts / np.linalg.norm(counts)


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and intercept (last) of a linear support vector machine; ``y`` is 1 or -1.

    Both classes weigh the same. Accelerated gradient steps on the squared hinge loss.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    look, before = w.copy(), w.copy()
    for i in range(1, rounds + 1):
        lack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        push = -2 * weight * y * lack
        g = np.concatenate([x.T @ push, [push.sum()]]).astype(np.float32)
        g[:-1] += penalty * look[:-1]
        w = look - 0.2 * g
        look = w + (i - 1) / (i + 2) * (w - before)
        before = w
    return w


def families_of(centres: dict[str, np.ndarray], number: int) -> list[list[str]]:
    """Languages joined by the average cosine of their mean vectors, seen from the middle."""
    groups = [[name] for name in sorted(centres)]
    middle = np.mean(list(centres.values()), axis=0)
    apart = {name: v - middle for name, v in centres.items()}
    unit = {name: v / max(np.linalg.norm(v), 1e-12) for name, v in apart.items()}
    while len(groups) > number:
        a, b = max(
            combinations(range(len(groups)), 2),
            key=lambda p: np.mean([unit[x] @ unit[y] for x in groups[p[0]] for y in groups[p[1]]]),
        )
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass
class LanguageModel:
    """Families, and by pair of names (families or languages) the row of its machine."""

    families: list[list[str]] = field(default_factory=list)
    machines: dict[tuple[str, str], int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH + 1), np.float32))

    def vote(self, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most wins, and its least margin."""
        if len(names) == 1:
            return names[0], np.inf
        wins = {name: [0, 0.0, np.inf] for name in names}
        for a, b in combinations(names, 2):
            m = float(margins[self.machines[a, b]])
            for name, own in ((a, m), (b, -m)):
                wins[name] = [wins[name][0] + (own > 0), wins[name][1] + own, min(wins[name][2], own)]
        best = max(names, key=lambda n: (wins[n][0], wins[n][1]))
        return best, wins[best][2]

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        v = vector(text, letters) if text and self.families else None
        if v is None:
            return UNKNOWN, 0.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        family, sure = self.vote([f"family:{i}" for i in range(len(self.families))], margins)
        name, surer = self.vote(self.families[int(family.split(":")[1])], margins)
        least = min(sure, surer)
        return name, float(1 / (1 + np.exp(-np.clip(3 * least, -30, 30))))


def fit(docs: DataFrame, sample: int = SAMPLE, families: list[list[str]] | None = None) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the documents given, those without either left out."""
    known = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel()
    each = sample / len(counts)
    shares = F.create_map(
        *[F.lit(x) for name, n in counts.items() for x in (name, sample_slots(each, n))]
    )
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text"), F.lit(SHARES))
    picked = known.filter(slot < F.element_at(shares, F.col("lang")))
    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(lang, vector(text, letters.value)) for lang, text in zip(batch["lang"], batch["text"], strict=True)]
            rows = [(lang, v.tobytes()) for lang, v in made if v is not None]
            yield pd.DataFrame(rows, columns=["lang", "v"], dtype=object)

    rows = picked.select("lang", "text").mapInPandas(vectors, "lang string, v binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    if not rows:
        return LanguageModel()
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in rows])
    lang = np.array([r["lang"] for r in rows])
    names = sorted(set(lang.tolist()))
    if families is None:
        centres = {name: x[lang == name].mean(0) for name in names}
        families = families_of(centres, max(1, round(len(names) ** 0.5)))
    model, found = LanguageModel(families), []

    def add(a: str, b: str, is_a: np.ndarray, is_b: np.ndarray) -> None:
        rows_in = is_a | is_b
        model.machines[a, b] = len(found)
        found.append(train_machine(x[rows_in], np.where(is_a[rows_in], 1, -1).astype(np.float32)))

    member = {f"family:{i}": np.isin(lang, f) for i, f in enumerate(families)}
    for a, b in combinations(member, 2):
        add(a, b, member[a], member[b])
    for family in families:
        for a, b in combinations(family, 2):
            add(a, b, lang == a, lang == b)
    if found:
        model.weights = np.stack(found)
    return model


def language(model: LanguageModel, docs: DataFrame, text: Column) -> Column:
    """``lang_pred`` and ``score`` of a text."""
    sent = ship(docs.sparkSession, (model, letter_table()))

    @F.pandas_udf("lang_pred string, score double")
    def predict_language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, letters = shipped(sent)
        for texts in batches:
            rows = [own.predict(t, letters) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"], dtype=object)

    return predict_language(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: one in four by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents not held out, then ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs.filter(~held_out()), sample)
    found = docs.select("doc_id", held_out().alias("held_out"), language(model, docs, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.*")
