"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are word bigram models of one form over one vocabulary: lower-case words, parted
by ASCII white space, known by 62-bit hashes. The target model counts the documents named as
targets, the background model all documents. With c for counts, N words, and V different words
in all documents or ``VOCABULARY``, whichever is more,

    p(w) = (c(w) + 1) / (N + V)
    p(w | h) = (c(h, w) + STRENGTH * p(w)) / (c(h) + STRENGTH)

and a document's score is the mean over its words of the loss under the target model minus
the loss under the background model; the lower, the more target-like.

Documents are dealt to blocks of about ``BLOCK_CHARS`` characters, as many as the corpus
needs. A block counts its n-grams once, all blocks' counts meet by n-gram, and a block gets
back only those n-grams that other blocks hold too. So neither model is ever in one place,
and what is moved grows with the input.

Null, empty and blank text has no words: ``n_tokens`` is 0 and the scores are null. Without a
target, the target model knows nothing but the vocabulary. Rows of one id share its target
mark and are scored each. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import mix, shuffle_partitions
from rosterlink.sources.tables import materialize

#: The least number of words that smoothing reckons with; what is above the words seen is for unseen ones.
VOCABULARY = (1 << 20) - 1
#: Keys are 62 bits of a hash below one bit that says whether it is a bigram's; no word has the
#: number of a document's start.
WORD_BITS = 62
START = (1 << WORD_BITS) - 1
STRENGTH = 20.0
BLOCK_CHARS = 16_000_000
TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")
JAVA_TOKEN = r"[^ \t\n\x0B\f\r]+"
#: N-grams travel in rows of many: keys by their differences, counts of all and of targets.
KINDS, CODEC = (np.int64, np.int64, np.int64), "zstd"
_VALUES = pa.schema(
    [("part", pa.int64()), ("distinct", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("t", pa.binary())]
)
_SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


class Slots:
    """Word hashes, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) % START
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def pairs(words: np.ndarray) -> np.ndarray:
    """Keys of the bigrams of a text; those of single words are below them."""
    before = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    hashed = mix(mix(before, 21) * np.uint64(31) + words.astype(np.uint64), 23)
    return (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64) | 1 << WORD_BITS


def block_ngrams(rows: pa.Table) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Document ids and words of a block, and which documents are targets."""
    slots, ids, words = Slots(), [], []
    marked = set()
    for doc, text, target in zip(rows["doc_id"], rows["text"], rows["target"], strict=True):
        if target.as_py():
            marked.add(doc.as_py())
        else:
            ids.append(doc.as_py())
            words.append(slots.of(text.as_py() or ""))
    return ids, words, np.array([i in marked for i in ids], bool)


def counted(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts: words, document starts and bigrams."""
    full = [w for w in words if len(w)]
    starts = np.full(len(full), START, np.int64)
    keys = np.concatenate([starts, *full, *map(pairs, full), np.empty(0, np.int64)])
    return np.unique(keys, return_counts=True)


def ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, and the place of each key among them."""
    every = np.concatenate([*keys, np.empty(0, np.int64)])
    order = np.argsort(every)
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    place = np.empty(len(every), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order
    first = np.flatnonzero(new)
    return every[first], np.diff(first, append=len(every)), place


def counted_at(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """``counted``, and the places among its keys of the document start, of all words and of all
    bigrams, one text after the other: from the sort, without a search for each."""
    full = [w for w in words if len(w)]
    # The keys of bigrams are above all others, so both kinds are sorted by themselves.
    double, m, two = ranked(list(map(pairs, full)))
    single, n, one = ranked([np.full(len(full), START, np.int64), *full])
    two += np.int32(len(single))
    first = int(one[0]) if len(full) else 0
    return np.concatenate([single, double]), np.concatenate([n, m]), first, one[len(full) :], two


def packed(keys: np.ndarray, *counts: np.ndarray) -> list[bytes]:
    """Ascending keys as their differences, and counts, compressed; all first bytes, then all
    second bytes and so on, so that the high ones take no room.
    """
    gaps = np.diff(keys, prepend=0)
    planes = [np.ascontiguousarray(v, kind).view(np.uint8).reshape(len(keys), -1).T for v, kind in zip((gaps, *counts), KINDS, strict=True)]
    return [pa.compress(p.tobytes(), CODEC, asbytes=True) for p in planes]


def unpacked(size: int, columns: list[bytes]) -> list[np.ndarray]:
    widths = [np.dtype(kind).itemsize for kind in KINDS]
    raw = [np.frombuffer(pa.decompress(c, size * w, CODEC), np.uint8) for c, w in zip(columns, widths, strict=True)]
    gaps, *counts = (
        np.ascontiguousarray(r.reshape(w, size).T).view(kind).ravel() for r, w, kind in zip(raw, widths, KINDS, strict=True)
    )
    return [np.cumsum(gaps), *counts]


def _rows(made: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in made], f.type) for i, f in enumerate(_VALUES)})


def count_block(parts: int):
    """A function of a block's documents: its counts in ``parts`` parts by key."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, words, target = block_ngrams(rows)
        keys, n = counted(words)
        own, m = counted([w for w, t in zip(words, target, strict=True) if t])
        t = np.zeros(len(keys), np.int64)
        t[np.searchsorted(keys, own)] = m
        part = mix(keys.astype(np.uint64), 3) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=parts + 1))
        made = []
        for at in np.split(order, cuts[1:]) if len(cuts) else []:
            made.append((int(part[at[0]]), None, key[0].as_py(), len(at), *packed(keys[at], n[at], t[at])))
        return _rows(made)

    return run


def add_up(key: tuple, rows: pa.Table) -> pa.Table:
    """From the counts of blocks, the sums of n-grams that several blocks hold, by block."""
    found = [
        (r["block"], *unpacked(r["size"], [r["keys"], r["n"], r["t"]])) for r in rows.to_pylist()
    ]
    every = np.concatenate([keys for _, keys, _, _ in found])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.flatnonzero(new)
    group = np.empty(len(every), np.int64)
    group[order] = np.cumsum(new) - 1
    shared = np.diff(first, append=len(ranked)) > 1
    sums = [
        np.add.reduceat(np.concatenate([f[i] for f in found])[order].astype(np.int64), first) for i in (2, 3)
    ]
    # A row without a block says how many different words the part holds.
    single = ranked[first] < START
    made, start = [(key[0].as_py(), int(single.sum()), None, 0, b"", b"", b"")], 0
    for block, keys, _, _ in found:
        own = group[start : start + len(keys)]
        start += len(keys)
        keep = shared[own]
        if keep.any():
            values = packed(keys[keep], *(s[own[keep]] for s in sums))
            made.append((key[0].as_py(), None, block, int(keep.sum()), *values))
    return _rows(made)


def score_block(totals: tuple[int, int], vocabulary: int):
    """A function of a block's documents and of the sums it got back; ``totals`` are N."""

    def run(rows: pa.Table, values: pa.Table) -> pa.Table:
        ids, words, target = block_ngrams(rows)
        lengths = [len(w) for w in words]
        keys, n, first, one, two = counted_at(words)
        del words
        marks = np.repeat(target, lengths)
        t = np.bincount(one[marks], minlength=len(keys)) + np.bincount(two[marks], minlength=len(keys))
        if len(one):
            t[first] = np.count_nonzero(target & (np.array(lengths) > 0))
        for r in values.to_pylist():
            got, all_n, all_t = unpacked(r["size"], [r["keys"], r["n"], r["t"]])
            at = np.searchsorted(keys, got)
            n[at], t[at] = all_n, all_t
        out: list[tuple] = []
        end = 0
        for doc, size in zip(ids, lengths, strict=True):
            if not size:
                out.append((doc, 0, None, None, None))
                continue
            begin, end = end, end + size
            own, double = one[begin:end], two[begin:end]
            before = np.concatenate([[first], own[:-1]])
            losses = []
            for counts, total in ((t, totals[1]), (n, totals[0])):
                single = (counts[own] + 1) / (total + vocabulary)
                losses.append(float(-np.log((counts[double] + STRENGTH * single) / (counts[before] + STRENGTH)).mean()))
            out.append((doc, size, *losses, losses[0] - losses[1]))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _SCORES.split(", ")]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def score_documents(docs: DataFrame, targets: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` for each row of ``docs``.

    ``targets`` has the ``doc_id`` of each target document.
    """
    marked = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = own.select("doc_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit(JAVA_TOKEN)).alias("words"))
    sums = sizes.join(marked.withColumn("t", F.lit(1)), "doc_id", "left").agg(
        F.sum("chars").alias("chars"), F.sum("words").alias("n"), F.sum(F.expr("words * t")).alias("t")
    ).first()
    blocks = max(1, -(-(sums["chars"] or 0) // block_chars))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    rows = own.select(block, "doc_id", "text", F.lit(False).alias("target")).unionByName(
        marked.select(block, "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("target"))
    )
    kind = "part long, distinct long, block long, size long, keys binary, n binary, t binary"
    parts = max(blocks, shuffle_partitions(docs.sparkSession))
    grams = rows.groupBy("block").applyInArrow(count_block(parts), kind)
    values = materialize(grams.groupBy("part").applyInArrow(add_up, kind), "ngram-sums")
    different = values.agg(F.sum("distinct")).first()[0] or 0
    return (
        rows.groupBy("block")
        .cogroup(values.filter("block is not null").groupBy("block"))
        .applyInArrow(score_block((sums["n"] or 0, sums["t"] or 0), max(VOCABULARY, different)), _SCORES)
    )
