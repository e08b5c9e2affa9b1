"""Secrets in text: plain patterns, and character Markov models.

Base spans are leftmost matches that do not overlap, kind by kind, dropped where too short.
Further spans of kind ``markov`` are tokens of identifier characters that a Markov model of
random strings explains better than one of ordinary identifiers: the mean log-likelihood
ratio of their characters must reach a threshold. A token has 16 characters or more, one of
them a letter. Both models are trained on labelled tokens
of the corpus itself: random are the values that base patterns caught, ordinary are
tokens of the same characters outside of them. Training looks at two samples picked by a hash,
about ``SAMPLE`` documents each, a documented bound: one of the documents that match the base
patterns, one of all others; so secrets train the model however rare they are. Counts of
transitions are summed by task before they meet. A corpus without any secret gives a warning
and no ``markov`` spans. Base spans never change by what the method adds; ``markov`` spans
that overlap a base span are left out.

Spans are in code points with the end exclusive. A span covers the whole match. Null or empty
text has no spans. Rows that repeat are scanned each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import SHARES, sample_slots, ship, shipped

KINDS = ("assign", "access", "hex")
# The base patterns, and the least length of what counts.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: For Spark: what a text with a base span matches.
HOLDS_SECRET = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
    r"|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
)
#: A text without a run of this length has no hex span, which is faster to find out.
LONG_HEX = re.compile(r"[0-9a-f]{32}")
#: What the models look at: tokens of identifier characters, at least this long.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A number alone is no candidate; keys of letters only are, and long words are told apart by
#: the models.
LETTER = re.compile(r"[A-Za-z]")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE = 10_000
#: Least mean log-likelihood ratio by character, in nats.
LEAST_RATIO = 0.5
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            found.append(("assign", *m.span()))
    if "AKIA" in text:
        found.extend(
            ("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]
        )
    first = LONG_HEX.search(text)
    if first:
        found.extend(("hex", *m.span()) for m in HEX.finditer(text, first.start()) if len(m[0]) >= LEAST["hex"])
    return found


def codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def steps(tokens: list[str]) -> np.ndarray:
    """The transitions of tokens as numbers; each starts from a state of its own."""
    c = codes("\n" + "\n".join(tokens))
    return (c[:-1] * STATES + c[1:])[c[1:] < STATES - 1]


@dataclass
class MarkovRatio:
    """Log-likelihood ratio of each transition, random against ordinary."""

    ratio: np.ndarray
    threshold: float

    @staticmethod
    def of(random: np.ndarray, ordinary: np.ndarray, threshold: float = LEAST_RATIO) -> MarkovRatio:
        """From counts of transitions. Unseen ones count as half a time."""

        def logs(counts: np.ndarray) -> np.ndarray:
            square = counts.reshape(STATES, STATES) + 0.5
            return np.log(square / square.sum(1, keepdims=True)).ravel()

        return MarkovRatio(logs(random) - logs(ordinary), threshold)

    def score(self, token: str) -> float:
        return float(self.ratio[steps([token])].mean())


def secret_values(text: str) -> Iterator[tuple[str, int, int]]:
    """The random parts of the base matches: values, keys and digests."""
    for kind, start, end in base_spans(text):
        if kind == "assign":
            m = ASSIGN.match(text, start)
            yield m[2], m.start(2), end
        else:
            yield text[start:end], start, end


def train(docs: DataFrame, sample: int = SAMPLE) -> MarkovRatio | None:
    """Both models from the corpus; ``None`` where it holds no secret to learn from."""
    texts = docs.filter("text is not null").select(
        "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES)).alias("place"),
        F.col("text").rlike(HOLDS_SECRET).alias("holds"),
    )
    sizes = texts.agg(F.count_if("holds").alias("holds"), F.count_if(~F.col("holds")).alias("others")).first()
    share = {c: sample_slots(sample, sizes[c]) for c in ("holds", "others")}
    bound = F.when(F.col("holds"), share["holds"]).otherwise(share["others"])
    picked = texts.filter(F.col("place") < bound).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {label: np.zeros(STATES**2, np.int64) for label in ("random", "ordinary")}
        for batch in batches:
            for value in batch["text"]:
                text = value.as_py()
                found = list(secret_values(text))
                covered = [(start, end) for _, start, end in found]
                labelled = {
                    "random": [secret for secret, _, _ in found],
                    "ordinary": list(plain_tokens(text, covered)),
                }
                for label, tokens in labelled.items():
                    if tokens:
                        sums[label] += np.bincount(steps(tokens), minlength=STATES**2)
        for label, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                ["label", "step", "n"],
            )

    rows = picked.mapInArrow(run, "label string, step long, n long").groupBy("label", "step").agg(
        F.sum("n").alias("n")
    ).collect()
    sums = {"random": np.zeros(STATES**2), "ordinary": np.zeros(STATES**2)}
    for r in rows:
        sums[r["label"]][r["step"]] = r["n"]
    if not sums["random"].any():
        warnings.warn("no document holds a secret to train on, so there are no markov spans", stacklevel=2)
        return None
    return MarkovRatio.of(sums["random"], sums["ordinary"])


#: Ordinary identifiers: words of a text in the same characters. Those as long as candidates are
#: left out, since nobody knows which of them are keys.
PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9_/-]{3,}")


def plain_tokens(text: str, covered: list[tuple[int, int]]) -> Iterator[str]:
    for m in PLAIN.finditer(text):
        if len(m[0]) < 16 and not any(a < m.end() and m.start() < b for a, b in covered):
            yield m[0]


def markov_spans(text: str, model: MarkovRatio, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if any(a < end and start < b for _, a, b in base):
            continue
        if LETTER.search(m[0]) and model.score(m[0]) >= model.threshold:
            out.append(("markov", start, end))
    return out


def show(spans: list[tuple[str, int, int]]) -> str:
    order = (*KINDS, "markov")
    ranked = sorted(spans, key=lambda s: (s[1], order.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ranked)


def scan(docs: DataFrame, model: MarkovRatio | None) -> DataFrame:
    """``doc_id, kind, start, end`` lists by document, as arrays of structs."""
    spark = docs.sparkSession
    sent = ship(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(sent)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for value in batch["text"]:
                text = value.as_py() or ""
                base = base_spans(text)
                more = markov_spans(text, own, base) if own else []
                for i, kind in enumerate(KINDS):
                    columns[i].append(sum(k == kind for k, _, _ in base))
                columns[3].append(hashlib.sha256(show(base).encode()).hexdigest())
                columns[4].append(show(base + more))
                columns[5].append(len(more))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long",
    )


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train, then scan every document."""
    return scan(docs, train(docs, sample))
