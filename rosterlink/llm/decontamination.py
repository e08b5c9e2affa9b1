"""Documents that hold a benchmark item, by the q-gram lemma and alignment.

Text is compared in lower case with every stretch of white space as one blank. An item of n
characters may differ from its place in a document by e edits, where e is ``EDITS`` of n but
never so much that the lemma says nothing. If so, item and place share at least
n - q + 1 - q * e q-grams, and those lie on diagonals (place in the document minus place in
the item) no more than e apart. Shared q-grams are therefore counted in bands of 2 (e + 1)
diagonals, each of which overlaps the next by half. Bands that reach the bound are regions;
an item is aligned with the characters of a region, and a leak is an alignment with e edits
or fewer.

A text is looked at in overlapping stretches, each of which can hold a whole place, so that
what a stretch of repeated patterns shares with an item has a bound.

Items shorter than q are found as exact words. Null, empty or blank items match nothing; null
or empty documents hold nothing. Items are looked up in blocks of ``BLOCK_CHARS`` characters
in all, so what is broadcast has a bound; each block is one pass over the documents, and where
there are several, each pass is written before the next block is read. ``find_leaks`` leaves
items without id out, gives documents without id as null, and rows that repeat the same pairs
once; it reads no other columns. ``clean_documents`` decides row by row, whatever the ids of
documents and items, and keeps all columns of the rows it keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import ship, shipped
from rosterlink.sources.tables import materialize

Q, EDITS = 10, 0.08
#: Characters of items in one block, about.
BLOCK_CHARS = 4_000_000
#: Characters of a stretch of text, or four times the longest place if that is more.
STRETCH = 8_192
#: Slots of the table that rules out most q-grams before the exact look-up.
SLOT_BITS = 20
BASE = 0x100000001B3


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_budget(n: int, q: int = Q, share: float = EDITS) -> int:
    """Edits an item of n characters may have; at least one q-gram must survive them."""
    return max(0, min(int(share * n), (n - q) // q))


def qgram_hashes(text: str, q: int) -> np.ndarray:
    """A rolling hash of each q-gram, put together from those of half the length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.empty(0, np.uint64)
    out, have = np.zeros(len(codes) + 1, np.uint64), 0
    power, size = codes, 1
    rest = q
    while rest:
        if rest & 1:
            n = len(codes) - have - size + 1
            shift = np.uint64(pow(BASE, size, 2**64))
            out = out[:n] * shift + power[have : have + n]
            have += size
        rest >>= 1
        if rest:
            shift = np.uint64(pow(BASE, size, 2**64))
            power = power[: len(power) - size] * shift + power[size:]
            size *= 2
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Items:
    """An index of the q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDITS):
        self.q = q
        self.short = [(i, re.compile(rf"(?<!\w){re.escape(t)}(?!\w)")) for i, t in items if 0 < len(t) < q]
        long = [(i, t) for i, t in items if len(t) >= q]
        self.ids, self.texts = [i for i, _ in long], [t for _, t in long]
        self.edits = np.array([edit_budget(len(t), q, share) for t in self.texts], np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.least = lengths - q + 1 - q * self.edits
        #: Characters that a place of any item may take, edits included.
        self.reach = int((lengths + 4 * (self.edits + 1)).max(initial=0))
        grams = [qgram_hashes(t, q) for t in self.texts]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.hashes, self.first, self.count = np.unique(
            every[order], return_index=True, return_counts=True
        )
        self.maybe = np.zeros(1 << SLOT_BITS, bool)
        self.maybe[slots(self.hashes)] = True

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item number and the part of the text that a band with enough q-grams covers."""
        hashes = qgram_hashes(text, self.q)
        every = np.flatnonzero(self.maybe[slots(hashes)])
        if not len(every) or not len(self.hashes):
            return
        seen: set[tuple[int, int, int]] = set()
        stretch = max(STRETCH, 4 * self.reach)
        for begin in range(0, max(1, len(hashes) - self.reach), stretch - self.reach):
            a, b = np.searchsorted(every, [begin, begin + stretch])
            if a < b:
                new = set(self._regions_of(hashes, every[a:b], len(text))) - seen
                seen |= new
                yield from sorted(new)

    def _regions_of(self, hashes: np.ndarray, at: np.ndarray, chars: int) -> Iterator[tuple[int, int, int]]:
        """The regions of one stretch; ``at`` are its q-grams that items may have."""
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[found] == hashes[at]
        at, found = at[hit], found[hit]
        counts = self.count[found]
        first = np.cumsum(counts) - counts
        rows = np.repeat(self.first[found] - first, counts) + np.arange(int(counts.sum()))
        item, diagonal = self.item[rows], np.repeat(at, counts) - self.place[rows]
        # A place in the document counts once for an item and band, as a place in the item does.
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        for i in np.flatnonzero(enough[: len(self.ids)]).tolist():
            own = np.sort(diagonal[item == i])
            step = int(self.edits[i]) + 1
            low = (own // step) * step
            starts = np.unique(np.concatenate([low, low - step]))
            inside = np.searchsorted(own, starts + 2 * step) - np.searchsorted(own, starts)
            for start in starts[inside >= self.least[i]].tolist():
                end = start + 2 * step + len(self.texts[i]) + step
                yield i, max(0, start - step), min(chars, end)

    def leaks(self, text: str | None) -> dict[int, tuple[int, int]]:
        """By item id, the fewest edits and the end of the first place with so few."""
        content = plain(text)
        out: dict[int, tuple[int, int]] = {}
        for i, start, end in self.regions(content):
            edits, stop = align(self.texts[i], content[start:end])
            if edits <= self.edits[i]:
                key = self.ids[i]
                out[key] = min(out.get(key, (edits, start + stop)), (edits, start + stop))
        for key, pattern in self.short:
            if found := pattern.search(content):
                out[key] = min(out.get(key, (0, found.end())), (0, found.end()))
        return out


def align(item: str, region: str) -> tuple[int, int]:
    """Fewest edits between the item and any part of the region, and where that part ends.

    The cells of a column differ by one at most, so their differences are bits of two integers.
    """
    where: dict[str, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    n = len(item)
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, edits = full, 0, n
    best = (n, 0)
    for j, x in enumerate(region):
        match = where.get(x, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(diagonal | up)
        right_down = diagonal & up
        edits += bool(right_up & last) - bool(right_down & last)
        best = min(best, (edits, j + 1))
        right_up, right_down = right_up << 1, right_down << 1
        up = (right_down | ~(diagonal | right_up)) & full
        down = diagonal & right_up & full
    return best


def item_blocks(
    benchmark: DataFrame, block_chars: int = BLOCK_CHARS
) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """The different items in blocks whose size has a bound, one block at a time, each with
    whether it is the only one."""
    items = benchmark.filter("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    ).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield blocks == 1, [(r["item_id"], plain(r["text"])) for r in own.collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, item_id, edits, end`` for each document and item it holds.

    ``end`` is where the place ends, in characters of the text as it is compared.
    """
    spark = docs.sparkSession
    source = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, edits long, end long"

    def search(items: list[tuple[int, str]]) -> DataFrame:
        sent = ship(spark, Items(items, q, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped(sent)
            for batch in batches:
                rows = [
                    (doc.as_py(), item, n, end)
                    for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                    for item, (n, end) in index.leaks(text.as_py()).items()
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "end"]
                )

        return source.mapInArrow(run, kind)

    parts = []
    for alone, items in item_blocks(benchmark.filter("item_id is not null"), block_chars):
        part = search(items)
        parts.append(part if alone else materialize(part, "leaks"))
    if not parts:
        return spark.createDataFrame([], kind)
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. No text is shuffled."""
    spark = docs.sparkSession
    left = docs

    def holds(items: list[tuple[int, str]]) -> Column:
        # Whose item it is does not matter here, so items without id count too.
        sent = ship(spark, Items([(0, text) for _, text in items], q, edits))

        @F.pandas_udf("boolean")
        def holds_item(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shipped(sent)
            for texts in batches:
                yield pd.Series([bool(index.leaks(t)) for t in texts], dtype=bool)

        return holds_item("text")

    for alone, items in item_blocks(benchmark, block_chars):
        left = left.filter(~holds(items))
        left = left if alone else materialize(left, "clean-documents")
    return left
