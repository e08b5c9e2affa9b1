"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all thresholds: P(grade <= k) = sigmoid(cut_k - w.x), with the
cuts in ascending order. The expected severity is the sum of P(grade >= k).

Features are a document's distinct words and the beginnings of its words. Labels say only
toxic or not; toxic documents are graded 1 to ``GRADES`` by how many different marker words
they hold, in parts of equal size, a marker being a feature that toxic documents favour.

The model is fitted on a bounded sample of labelled documents, chosen by a hash of the id;
every document is scored on its whole text. Null or empty text has no features and is never
called toxic. Without labels of both kinds all severities are 0. Of several labels of one
document the highest counts; rows with equal ids get the same label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import SHARES, WORD, sample_slots
from rosterlink.sources.tables import materialize

GRADES = 3
#: Labelled documents to learn from, about; features kept, those most telling.
SAMPLE, FEATURES = 20_000, 4_000
#: Lengths of word beginnings, which hold for the inflected forms of a word.
BEGINNINGS = (4, 5, 6)
#: Documents that must hold a feature, and least z-score of its log odds.
LEAST_DOCUMENTS, LEAST_Z = 5, 2.5
CACHED_WORDS = 200_000


@dataclass
class OrdinalModel:
    """Weights by feature and ascending cuts between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) by document and k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - scores[:, None], -30, 30)))


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they differ."""
    return [word] + [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of about ``sample`` labelled documents, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    total = known.count()
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < sample_slots(sample, total)
    one = known.filter(chosen).groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    picked = docs.filter(chosen).select("doc_id", "text")
    return picked.join(one, "doc_id").select("text", F.col("_toxic").alias("toxic"))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature, the different words of documents that have it, in all and in toxic ones."""

    def out() -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for word, n in seen.items():
            for feature in word_features(word):
                sums = counts.setdefault(feature, [0, 0])
                sums[0] += n
                sums[1] += bad[word]
        names = list(counts)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            sums = [[counts[f][k] for f in part] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array(c, pa.int64()) for c in sums)],
                ["feature", "n", "n_toxic"],
            )

    seen: Counter = Counter()
    bad: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(*(batch[c].to_pylist() for c in ("text", "toxic")), strict=True):
            words = distinct_words(text)
            seen.update(words)
            if toxic:
                bad.update(words)
            if len(seen) > 200_000:
                yield from out()
                seen, bad = Counter(), Counter()
    yield from out()


def telling_features(sample: DataFrame, keep: int = FEATURES) -> tuple[list[str], set[str]]:
    """The features most telling of toxic or not, and those of them that toxic text favours.

    Features are ranked by the z-score of their log odds among the words of documents.
    """
    counted = materialize(
        sample.mapInArrow(_feature_counts, "feature string, n long, n_toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t")),
        "toxicity-features",
    )
    total = counted.filter(~F.endswith("feature", F.lit("*"))).agg(F.sum("n"), F.sum("t")).first()
    n, bad = total[0] or 0, total[1] or 0
    if not bad or bad == n:
        return [], set()
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (bad - F.col("t") + 1.0)) - F.log(b / (n - bad - F.col("n") + F.col("t") + 1.0))
    best = (
        counted.filter(F.col("n") >= LEAST_DOCUMENTS)
        .withColumn("z", odds / F.sqrt(1 / a + 1 / b))
        .filter(F.abs("z") >= LEAST_Z)
        .orderBy(F.abs("z").desc(), "feature")
        .limit(keep)
        .select("feature", "z")
        .collect()
    )
    return [r["feature"] for r in best], {r["feature"] for r in best if r["z"] > 0}


def _vectors(sample: DataFrame, features: list[str]) -> pd.DataFrame:
    """Selected features of the sampled documents: toxic, positions and counts."""
    at = {f: i for i, f in enumerate(features)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                hits = Counter(
                    at[f] for w in distinct_words(text) for f in word_features(w) if f in at
                )
                found = sorted(hits.items())
                rows.append((bool(toxic), [i for i, _ in found], [n for _, n in found]))
            yield pd.DataFrame(rows, columns=["toxic", "at", "n"])

    return sample.mapInPandas(vectors, "toxic boolean, at array<int>, n array<int>").toPandas()


def grades_of(toxic: np.ndarray, markers: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for documents that are not toxic; toxic ones in equal parts by their markers."""
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        limits = np.quantile(markers[toxic], np.arange(1, grades) / grades)
        out[toxic] = 1 + np.searchsorted(limits, markers[toxic], side="left")
    return out


def fit_cumulative_link(
    rows: np.ndarray, at: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int,
    penalty: float = 3e-5, steps: int = 800, rate: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by gradient steps on the penalised likelihood of sparse rows.

    Cuts are kept in order by learning the logarithms of their distances.
    """
    n, top = len(grade), int(grade.max())
    shares = np.clip([(grade <= k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(shares / (1 - shares)) + 1e-3 * np.arange(top))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(width), start[:1], gaps])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, cuts = x[:width], x[width] + np.concatenate([[0], np.cumsum(np.exp(x[width + 1 :]))])
        score = np.bincount(rows, values * w[at], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up = 1 / (1 + np.exp(-np.clip(edges[grade + 1] - score, -30, 30)))
        low = 1 / (1 + np.exp(-np.clip(edges[grade] - score, -30, 30)))
        up[grade == top], low[grade == 0] = 1, 0
        p = np.maximum(up - low, 1e-12)
        slope_up, slope_low = up * (1 - up) / p, low * (1 - low) / p
        by_cut = np.zeros(top)
        for k in range(top):
            by_cut[k] = (slope_low[grade == k + 1].sum() - slope_up[grade == k].sum()) / n
        push = (slope_up - slope_low) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate(
            [
                np.bincount(at, values * push[rows], minlength=width) + penalty * w,
                tail[:1],
                tail[1:] * np.exp(x[width + 1 :]),
            ]
        )
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:width], x[width] + np.concatenate([[0], np.cumsum(np.exp(x[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Learn from labelled documents; features are counted on the executors."""
    rows = materialize(labelled_sample(docs, labels, sample), "toxicity-sample")
    features, markers = telling_features(rows)
    if not features:
        return OrdinalModel()
    data = _vectors(rows, features)
    lengths = data["at"].map(len).to_numpy()
    at = np.concatenate([np.asarray(x, np.int64) for x in data["at"]])
    n = np.concatenate([np.asarray(x, np.float64) for x in data["n"]])
    at_row = np.repeat(np.arange(len(data)), lengths)
    whole = np.array([f in markers and not f.endswith("*") for f in features])
    part = np.array([f in markers and f.endswith("*") for f in features])
    hits = np.bincount(at_row, n * whole[at], minlength=len(data)) + np.bincount(
        at_row, n * part[at], minlength=len(data)
    ) / max(1, len(BEGINNINGS))
    grade = grades_of(data["toxic"].to_numpy(bool), hits)
    weights, cuts = fit_cumulative_link(at_row, at, n, grade, len(features))
    return OrdinalModel(dict(zip(features, weights.tolist(), strict=True)), cuts.tolist())


def severity(model: OrdinalModel, text: str | Column) -> Column:
    """``severity`` (expected grade) and ``p_toxic`` (chance of grade 1 or more) of a text."""

    @F.pandas_udf("severity double, p_toxic double")
    def expected_severity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for texts in batches:
            scores, words_in = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, text in enumerate(texts):
                words = distinct_words(text)
                words_in[i] = bool(words)
                for word in words.difference(known):
                    known[word] = sum(model.weights.get(f, 0.0) for f in word_features(word))
                scores[i] = math.fsum(map(known.__getitem__, words))
                if len(known) > CACHED_WORDS:
                    known = {}
            p = model.at_least(scores) * words_in[:, None]
            first = p[:, 0] if model.cuts else np.zeros(len(texts))
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": first})

    return expected_severity(text)


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, severity, p_toxic, toxic``."""
    model = fit(docs, labels, sample)
    scored = docs.select("doc_id", severity(model, F.col("text")).alias("s"))
    return scored.select("doc_id", "s.*", (F.col("s.p_toxic") >= 0.5).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that are more likely toxic than not."""
    model = fit(docs.select("doc_id", "text"), labels, sample)
    # The columns of the input are one column meanwhile, so their names meet no others.
    scored = docs.select(F.struct("*").alias("doc"), severity(model, F.col("text")).alias("s"))
    return scored.filter(F.col("s.p_toxic") < 0.5).select("doc.*")
