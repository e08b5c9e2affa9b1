"""Runs of words that occur more than once in a corpus, and documents without them.

Words are what lies between ASCII white space. A *window* is ``window`` words in a row of one
row of the input; a word goes if it lies in a window whose words also start anywhere else, in
the same text or another one. Both copies go, and windows are judged on the input.

*Anchors* are the blocks of (window + 1) / 2 words that start at multiples of that length:
each window holds a whole one of its own text. A window's copy holds the same words, at any
place, so the anchor is *hit* by another of the rolling windows of block length. First all
rolling windows probe the anchors; then hits are extended: each window of full length around a
hit anchor is looked for again, and those that occur twice run together into maximal exact
repeats. A copy's own anchors are hit as well, so both ends of a repeat are found this way,
and no pair of places is ever formed.

Both searches are one exchange. Texts are dealt into blocks of bounded size; a block sends
each of its hashes once, sorted and packed into one row for each bucket, and a bucket answers
every block with one bit for each hash that it sent: whether it occurs again. A hash in a third
of all texts costs one entry a block. The number of blocks and buckets follows the text, and a
row of the exchange holds at least one hash, so rows never outnumber words. Anchors are compared
by 30 bits within a bucket of some million hashes; what they find too much, the second
search drops: it compares 78 bits within a bucket. Blocks must be the same whenever a task is
run again, so the rows are written once, numbered.

Null text has no words and stays null; empty and blank text has none either. A row is a document
whatever its id: rows that are repeated, with equal or null ids, are copies of each other.
Other columns are kept; those named like the results are replaced. One text is always handled
whole, in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rosterlink.llm.common import mix, sha256_hex, shuffle_partitions, spread
from rosterlink.sources.tables import materialize_observed

#: Words of a window that make a repeat.
WINDOW = 35
#: Bytes of text in a block, and hashes in a bucket (all words once, at the most).
BLOCK_BYTES, BUCKET_HASHES = 8 << 20, 1 << 20
#: Bytes of text that are hashed at a time.
RUN_BYTES = 1 << 20
#: The white space that parts words, the same as ``bytes.split`` knows.
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The low bits of an entry: it occurs twice in its block; the block asks about it.
TWICE, ASKED = 1, 2
#: A rolling window of anchor length, and a full window: what is left of hashes after the
#: bucket's bits, and the low bits above.
NARROW = np.dtype([("code", "<u4")])
WIDE = np.dtype([("high", "<u8"), ("code", "<u2")])


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers, the same in every task."""
    return mix(np.arange(1, count + 1, dtype=np.uint64), seed) | np.uint64(1)


def hash_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes times numbers that depend on the place in it."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACES[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    letters = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    place = letters - np.repeat(starts, lengths)
    values = multipliers(256, 11)[raw[letters]] * multipliers(int(lengths.max()), 12)[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64), 13)


def hash_windows(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of every ``length`` words in a row."""
    count = max(0, len(words) - length + 1)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(multipliers(length, seed)):
        total += words[i : i + count] * factor
    return mix(total, seed)


class Texts:
    """The words of a block of texts, hashed, one text after the other."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        self.hashes: list[np.ndarray] = []
        sizes: list[int] = []
        held: list[bytes] = []
        room = RUN_BYTES
        for value in texts:
            data = value.as_py() or b""
            held.append(data)
            room -= len(data)
            if room <= 0:
                self._take(held, sizes)
                held, room = [], RUN_BYTES
        self._take(held, sizes)
        self.words = np.concatenate([*self.hashes, np.empty(0, np.uint64)])
        self.hashes = []
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Place of each word in its text, and words from it to the end of the text.
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.place

    def _take(self, held: list[bytes], sizes: list[int]) -> None:
        sizes += [len(data.split()) for data in held]
        self.hashes.append(hash_words(b" ".join(held)))

    def windows(self, length: int) -> np.ndarray:
        """Where windows of this length start."""
        return np.flatnonzero(self.left >= length)


def block_length(window: int) -> int:
    """The longest anchor of which each window holds a whole one."""
    return (window + 1) // 2


class Entries:
    """The different hashes of a block in the order they are sent in."""

    def __init__(self, bucket: np.ndarray, parts: list[np.ndarray], asked: np.ndarray | None) -> None:
        order = np.lexsort((*reversed(parts), bucket))
        ranked = [x[order] for x in (bucket, *parts)]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ranked])
        first = np.flatnonzero(new)
        self.bucket, self.parts = ranked[0][first], [x[first] for x in ranked[1:]]
        self.twice = np.diff(first, append=len(order)) > 1
        #: The entry of each hash given.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.asked = np.ones(len(first), bool)
        if asked is not None:
            self.asked = np.zeros(len(first), bool)
            self.asked[self.of[asked]] = True

    def packets(self, block: int, kind: np.dtype) -> pa.Table:
        """One row for each bucket."""
        packed = np.empty(len(self.bucket), kind)
        for name, part in zip(kind.names, self.parts, strict=True):
            packed[name] = part
        packed["code"] |= self.twice * packed["code"].dtype.type(TWICE)
        packed["code"] |= self.asked * packed["code"].dtype.type(ASKED)
        edges = [0, *(np.flatnonzero(np.diff(self.bucket)) + 1).tolist(), len(packed)]
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
        return _rows(
            [int(self.bucket[a]) for a, _ in parts],
            [block] * len(parts),
            [packed[a:b].tobytes() for a, b in parts],
        )

    def marked(self, answers: pa.Table) -> np.ndarray:
        """By hash given, whether the answers say that it occurs again."""
        found = np.zeros(len(self.bucket), bool)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["packed"], strict=True):
            a, b = np.searchsorted(self.bucket, [bucket, bucket + 1])
            found[a:b] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=b - a)
        return found[self.of]


_PACKETS = "bucket int, block int, packed binary"


def _rows(buckets: list[int], blocks: list[int], packed: list[bytes]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "block": pa.int32(), "packed": pa.binary()}
    columns = (buckets, blocks, packed)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})


def answer(kind: np.dtype) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a bucket's packets: by block, a bit for each entry that it sent.

    The bit says that the block asks about the entry and that it occurs again, there or in
    another block. A block that would only get zeros gets no row.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), kind) for x in rows["packed"]]
        every = np.concatenate(parts)
        low = every["code"] >> every["code"].dtype.type(2)
        columns = [low, *(every[n] for n in kind.names if n != "code")]
        order = np.lexsort(columns)
        same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in columns])
        again = (every["code"] & TWICE) != 0
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= (every["code"] & ASKED) != 0
        made: tuple[list, list, list] = ([], [], [])
        ends = np.cumsum([len(p) for p in parts])
        for block, bits in zip(rows["block"].to_pylist(), np.split(again, ends[:-1]), strict=True):
            if bits.any():
                for column, x in zip(made, (key[0].as_py(), block, np.packbits(bits).tobytes()), strict=True):
                    column.append(x)
        return _rows(*made)

    return run


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def anchor_entries(texts: Texts, window: int, bits: int) -> tuple[np.ndarray, Entries]:
    """Where windows of anchor length start, and their entries; a block asks about anchors."""
    length = block_length(window)
    at = texts.windows(length)
    hashes = hash_windows(texts.words, length, 21)[at]
    code = (hashes << np.uint64(bits) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFC)
    return at, Entries(_top(hashes, bits), [code], texts.place[at] % length == 0)


def window_entries(
    texts: Texts, window: int, bits: int, answers: pa.Table
) -> tuple[np.ndarray, Entries]:
    """Starts of the windows whose first anchor is hit elsewhere, and their entries."""
    length = block_length(window)
    at, anchors = anchor_entries(texts, window, bits)
    hit = np.zeros(len(texts.words), bool)
    hit[at[anchors.marked(answers) & (texts.place[at] % length == 0)]] = True
    starts = texts.windows(window)
    starts = starts[hit[starts + -texts.place[starts] % length]]
    # Only the words around hits are hashed again.
    near = np.zeros(len(texts.words) + window, bool)
    one = two = np.empty(0, np.uint64)
    if len(starts):
        near[: len(texts.words)] = cover(len(texts.words), starts, window)
        kept = np.flatnonzero(near[: len(texts.words)])
        moved = np.searchsorted(kept, starts)
        one = hash_windows(texts.words[kept], window, 31)[moved]
        two = hash_windows(texts.words[kept], window, 32)[moved]
    high = one << np.uint64(bits) | two >> np.uint64(1) >> np.uint64(63 - bits)
    return starts, Entries(_top(one, bits), [high, two.astype(np.uint16) & np.uint16(0xFFFC)], None)


def cover(count: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``count`` words the windows that start there cover."""
    steps = np.zeros(count + 1, np.int64)
    steps[starts] += 1
    np.subtract.at(steps, starts + window, 1)
    return np.cumsum(steps[:-1]) > 0


def probe(window: int, bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a block's texts: all rolling windows of anchor length, each once."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, entries = anchor_entries(Texts(rows["text"]), window, bits)
        return entries.packets(key[0].as_py(), NARROW)

    return run


def extend(window: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's texts and answers: the full windows around hits, each once."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _rows([], [], [])
        _, entries = window_entries(Texts(rows["text"]), window, bits, answers)
        return entries.packets(rows["block"][0].as_py(), WIDE)

    return run


def remove(window: int, bits: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's texts and both answers: the texts that are left."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        texts = Texts(rows["text"])
        gone = np.zeros(len(texts.words), bool)
        full = pc.equal(answers["full"], True)
        if answers.num_rows:
            starts, entries = window_entries(texts, window, bits, answers.filter(pc.invert(full)))
            again = entries.marked(answers.filter(full))
            gone = cover(len(gone), starts[again], window)
        kept, spans, removed = [], [], []
        for value, start, size in zip(rows["text"], texts.starts.tolist(), texts.sizes.tolist(), strict=True):
            mine = gone[start : start + size]
            edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2])])
            removed.append(int(mine.sum()))
            data = value.as_py()
            if data is not None:
                words, left = data.split(), []
                for a, b in zip([0, *edges[1::2]], [*edges[0::2], size]):
                    left += words[a:b]
                data = b" ".join(left)
            kept.append(data)
        columns = [
            rows["rest"].combine_chunks(),
            pa.array(kept, pa.binary()),
            pa.array(texts.sizes, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(spans, schema.field("repeats").type),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_hashes: int = BUCKET_HASHES,
) -> DataFrame:
    """``docs`` with the words left in its text, one space between them, and ``n_words``,
    ``n_removed`` and ``repeats``.

    ``repeats`` lists the places of the words that went (``start``, ``end`` exclusive); adjoining
    repeats are one entry. The text is written once and shuffled once.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    made = ["n_words", "n_removed", "repeats"]
    others = [c for c in docs.columns if c not in (text_col, *made)]
    rest = [F.col(f"`{c}`") for c in others] or [F.lit(True).alias("row")]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.struct(*rest).alias("rest"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    # Sums of a task that is run again may count twice; they only size blocks and buckets.
    placed, sums = materialize_observed(numbered, "numbered-texts", size=F.sum(F.octet_length("text")))
    size = sums["size"] or 0
    spark = docs.sparkSession
    least = shuffle_partitions(spark)
    blocks = spread(size, block_bytes, 1)
    # A word takes five bytes or so with the space behind it.
    bits = max(0, (spread(size, 5 * bucket_hashes, 1) - 1).bit_length())
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block")
    # One block or bucket to a partition, so that no task gets many by chance.
    dealt, asked = max(least, blocks), max(least, 1 << bits)
    texts = placed.select(block, "rest", "text").repartitionById(dealt, "block")

    def by_block(answers: DataFrame) -> GroupedData:
        return answers.repartitionById(dealt, "block").groupBy("block")

    def answered(packets: DataFrame, kind: np.dtype) -> DataFrame:
        grouped = packets.repartitionById(asked, "bucket").groupBy("bucket")
        return grouped.applyInArrow(answer(kind), _PACKETS)

    hits = answered(texts.groupBy("block").applyInArrow(probe(window, bits), _PACKETS), NARROW)
    around = texts.groupBy("block").cogroup(by_block(hits)).applyInArrow(extend(window, bits), _PACKETS)
    both = hits.withColumn("full", F.lit(False)).unionByName(
        answered(around, WIDE).withColumn("full", F.lit(True))
    )
    shape = StructType(
        [
            StructField("rest", placed.schema["rest"].dataType),
            StructField("text", BinaryType()),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("repeats", _SPANS),
        ]
    )
    left = texts.groupBy("block").cogroup(by_block(both)).applyInArrow(
        remove(window, bits, to_arrow_schema(shape)), shape
    )
    return left.select(
        *[F.col("rest").getField(c).alias(c) for c in others], F.col("text").cast("string").alias(text_col), *made
    )


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: its words, those removed, and a digest of the words kept."""
    left = remove_repeats(docs.select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return left.select("doc_id", "n_words", "n_removed", sha256_hex(kept).alias("kept_sha256"))


def sql(window: int = WINDOW) -> str:
    """The same report in DuckDB's SQL, by counting every window of words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, p, md5(array_to_string(list_slice(w, p, p + {window - 1}), ' ')) AS h
      FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS p FROM d)),
g AS (SELECT r, p FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
t AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT t.*, max(g.p) OVER (PARTITION BY t.r ORDER BY i) > i - {window} AS gone
      FROM t LEFT JOIN g ON g.r = t.r AND g.p = t.i),
k AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        string_agg(word, ' ' ORDER BY i) FILTER (gone IS NOT TRUE) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
