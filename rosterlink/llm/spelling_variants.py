"""Words of a corpus that are one edit apart, and the common spelling that each stands for.

A word's *letter counts* are a vector, and the squared distance of two of them is 2 if one
letter was replaced and 1 if one came in or went. NumPy products of blocks of such vectors
(Gram matrices) give all squared distances of a block at once, for words of one length and of
adjacent lengths; pairs at most two apart are kept and their edits verified letter by letter.

All against all would be too much, so the letters are dealt into groups of about equal use. An
edit touches two groups at most: a word meets, for each two groups left out, only the words
with the same counts of all other letters. Every pair that can be near meets so, and it counts
under one choice of groups alone. There is one group more for each fourfold vocabulary. A crowd of words
with the same counts becomes a triangle of cells of bounded size, spread over tasks; pairs
never leave a task, only the number of near words and the best of them by word.

Words: maximal runs of A to Z, a to z and U+00C0 to U+00FF, with A to Z in lower case only. Where
97 divides the CRC-32 of ``<id>:<run>``, the code point at that number modulo the length is
left out (a planted misspelling). Those of ``min_letters`` or more that occur ``min_count``
times or more take part. A word's form is its near word with the largest count (the first in code
point order among equals) if that is ``ratio`` times its own or more; its root is where forms
lead to. Null text has no words, a null id is an empty one, and rows count as often as they
are there. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import mix, shuffle_partitions, spread
from rosterlink.operators.lookups import lookup_join
from rosterlink.sources.tables import materialize, materialize_observed

# Fixed values that the contract sets: the divisor, the least length and count, the ratio.
DIVISOR, MIN_LETTERS, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Letters of a run in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Words that are counted in a task before they are passed on; bytes of a text held as a list.
HELD_WORDS, LONG_TEXT = 200_000, 1 << 20
#: Words and bytes of a side of a cell; words whose products are formed together.
TILE_WORDS, TILE_BYTES, PACK_WORDS = 4096, 1 << 20, 256
#: Bytes of a block of products.
PRODUCT_BYTES = 16 << 20
#: Rows that a partition of the word table and of the cells should hold.
PARTITION_ROWS = 100_000


def misspelt(run: bytes, number: int) -> bytes:
    """The run without the code point that its checksum names, where 97 divides that."""
    if number % DIVISOR:
        return run
    letters = run.decode()
    at = number % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def words_of(doc_id: object, text: bytes) -> Iterator[tuple[bytes, int]]:
    """The words of a text with their number; one word can come twice."""
    lowered = text.lower()  # bytes: A to Z only
    if len(lowered) > LONG_TEXT:
        found = Counter(m[0] for m in RUN.finditer(lowered))
    else:
        found = Counter(RUN.findall(lowered))
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        yield misspelt(run, zlib.crc32(run, begun)), n


def letters_in(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def count_words(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT
) -> DataFrame:
    """``word, n`` of all words that take part; tasks add up before they pass words on."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                for word, n in words_of(doc_id, text.as_py()):
                    if letters_in(word) >= min_letters:
                        sums[word] += n
                if len(sums) >= HELD_WORDS:
                    yield passed_on()
        yield passed_on()

    rows = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    words = rows.mapInArrow(counted, "word binary, n long")
    sums = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return sums.select(F.col("word").cast("string").alias("word"), "n")


def letter_groups(words: DataFrame, count: int) -> np.ndarray:
    """The group of each of the 256 first code points: letters by falling use, each to the group that
    is used least so far. The table of letters has 90 rows at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter"))
    used = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()
    load, group = [0] * count, np.zeros(256, np.int64)
    for row in sorted(used, key=lambda r: (-r["n"], r["letter"])):
        least = load.index(min(load))
        group[ord(row["letter"])] = least
        load[least] += row["n"]
    return group


class Letters:
    """Words in Latin-1, one byte a letter, with what can be counted in them."""

    def __init__(self, words: pa.Array) -> None:
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        self.codes = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        self.starts = ends[:-1].astype(np.int64) - ends[0]
        self.lengths = np.diff(ends).astype(np.int64)
        self.row = np.repeat(np.arange(len(words)), self.lengths)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By word, the sum of a value for each letter."""
        return np.add.reduceat(values[self.codes], self.starts)

    def counts(self) -> np.ndarray:
        """By word, how often it has each of the letters that occur."""
        seen = np.unique(self.codes)
        place = np.searchsorted(seen, self.codes)
        flat = np.bincount(self.row * len(seen) + place, minlength=len(self.lengths) * len(seen))
        # Products and their sums are whole numbers, which both kinds hold exactly so far.
        exact = np.float32 if int(self.lengths.max()) < 2**11 else np.float64
        return flat.reshape(len(self.lengths), len(seen)).astype(exact)

    def touched(self, a: np.ndarray, b: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """By pair, which groups of letters the counts differ in."""
        sums = np.stack([self.sums(np.where(group == g, _WEIGHTS, np.uint64(0))) for g in range(groups)], axis=1)
        return sums[a] != sums[b]

    def spelt(self, rows: np.ndarray) -> np.ndarray:
        """The letters of rows of one length, a row of a matrix each."""
        width = int(self.lengths[rows[0]]) if len(rows) else 0
        return self.codes[self.starts[rows, None] + np.arange(width)]


#: A random weight for each letter; sums of them stand for letter counts.
_WEIGHTS = mix(np.arange(256, dtype=np.uint64), 41)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words of one length differ in one letter."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b``, longer by one letter, is ``a`` with a letter put in: what agrees from
    the front and what agrees from the back make up all of ``a``."""
    width = a.shape[1]
    front, back = a != b[:, :-1], (a != b[:, 1:])[:, ::-1]
    agree = [np.where(x.any(axis=1), x.argmax(axis=1), width) for x in (front, back)]
    return agree[0] + agree[1] >= width


def close_pairs(letters: Letters, meet: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet and are one edit apart; the second is as long as the first or
    one longer.

    Pairs whose letter counts are at most two apart, squared, come from products of a block of
    rows with all rows of their length and of the next; ``meet`` says which of them to look at.
    """
    counts = letters.counts()
    half = (counts**2).sum(axis=1, keepdims=True) / -2
    # Products of these two are half the squared distance, negative.
    one, two = np.hstack([counts, half, half * 0 + 1]), np.hstack([counts, half * 0 + 1, half])
    of_length = {int(n): np.flatnonzero(letters.lengths == n) for n in np.unique(letters.lengths)}
    for n, rows in of_length.items():
        spelt = letters.spelt(rows)
        for others, edit in ((rows, replaced), (of_length.get(n + 1), inserted)):
            if others is None:
                continue
            longer = spelt if others is rows else letters.spelt(others)
            step = max(1, PRODUCT_BYTES // (4 * len(others) * (1 + n // 8)))
            for i in range(0, len(rows), step):
                gram = one[rows[i : i + step]] @ two[others].T
                x, y = np.divmod(np.flatnonzero(gram >= -1), len(others))
                x += i
                keep = meet(rows[x], others[y])
                if others is rows:
                    keep &= x < y
                x, y = x[keep], y[keep]
                near = edit(spelt[x], longer[y])
                yield rows[x[near]], others[y[near]]


def meeting_rows(words: DataFrame, group: np.ndarray, groups: int) -> DataFrame:
    """Each word once for each choice of two groups: the choice, and a hash of the counts of the
    other groups."""
    choices = list(combinations(range(groups), 2))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = Letters(batch["word"])
            sums = [letters.sums(np.where(group == g, _WEIGHTS, np.uint64(0))) for g in range(groups)]
            every = np.add.reduce(sums)
            for number, (a, b) in enumerate(choices):
                key = mix(every - sums[a] - sums[b], 50 + number).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), number, np.int32)), pa.array(key), batch["word"], batch["n"]],
                    ["choice", "key", "word", "n"],
                )

    latin = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    return latin.mapInArrow(keyed, "choice int, key long, word binary, n long")


def cells(rows: DataFrame, tile_words: int = TILE_WORDS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The rows once for each cell of the triangle that their crowd of words forms."""
    sizes = rows.groupBy("choice", "key").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.length("word")).alias("bytes")
    )
    tiles = F.greatest(F.ceil(F.col("k") / tile_words), F.ceil(F.col("bytes") / tile_bytes))
    # A word alone meets nobody. Sizes hold each key once, so a crowded key can be split.
    crowds = sizes.filter("k > 1").select("choice", "key", tiles.cast("int").alias("tiles"))
    placed = lookup_join(rows, crowds, ["choice", "key"]).filter(F.col("tiles").isNotNull())
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread_out = placed.withColumn("tile", tile).withColumn("other", other)
    return spread_out.select(
        "choice", "key", F.least("tile", "other").alias("left"),
        F.greatest("tile", "other").alias("right"), "tile", "word", "n",
    )


def near_in(pack: pa.Table, group: np.ndarray, groups: int) -> pa.RecordBatch:
    """Of whole cells, by word the number of its near words there and the best of them."""
    letters = Letters(pack["word"].combine_chunks())
    choices = np.array(list(combinations(range(groups), 2)))
    choice, key, left, right, tile = (
        pack[c].to_numpy() for c in ("choice", "key", "left", "right", "tile")
    )
    new = np.zeros(len(choice), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (choice, key, left, right)])
    cell = np.cumsum(new)

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (cell[a] == cell[b]) & ((left[a] == right[a]) | (tile[a] != tile[b]))

    a, b = (np.concatenate(x) for x in zip(*close_pairs(letters, meet), strict=True))
    # A pair that differs in one group alone counts where that one is left out with the first other.
    touched = letters.touched(a, b, group, groups)
    single = touched.sum(axis=1) == 1
    one = touched.argmax(axis=1)
    two = np.where(single, (one == 0).astype(np.int64), groups - 1 - touched[:, ::-1].argmax(axis=1))
    mine = choices[choice[a]] if len(a) else np.empty((0, 2), np.int64)
    own = (mine[:, 0] == np.minimum(one, two)) & (mine[:, 1] == np.maximum(one, two))
    a, b = np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])
    words, n = pack["word"].combine_chunks(), pack["n"].to_numpy()
    rank = np.empty(len(n), np.int64)
    rank[np.array(pc.sort_indices(words))] = np.arange(len(n))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(a[first])),
            pa.array(np.diff(first, append=len(a)).astype(np.int64)),
            pa.array(-n[b[first]]),
            words.take(pa.array(b[first])),
        ],
        ["word", "n_near", "minus", "best"],
    )


def near_words(words: DataFrame, count: int, tile_words: int = TILE_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of ``words`` (``count`` rows) that have near words."""
    groups = max(4, (count.bit_length() - 11) // 2)
    group = letter_groups(words, groups)
    met = cells(meeting_rows(words, group, groups), tile_words)
    at = ["choice", "key", "left", "right"]
    rows = count * groups * (groups - 1) // 2
    parts = spread(rows, PARTITION_ROWS, shuffle_partitions(words.sparkSession))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({})
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held.num_rows else pa.Table.from_batches([batch])
            keys = [held[c].to_numpy() for c in at]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            start = 0
            while len(ends) and ends[-1] > start:
                more = ends[ends >= start + PACK_WORDS]
                end = int(more[0] if len(more) else ends[-1])
                yield near_in(held.slice(start, end - start), group, groups)
                start = end
            held = held.slice(start)
        if held.num_rows:
            yield near_in(held, group, groups)

    found = (
        met.repartition(parts, *at)
        .sortWithinPartitions(*at)
        .mapInArrow(nearest, "word binary, n_near long, minus long, best binary")
    )
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "best")).alias("top")
    )
    return best.select(
        F.decode("word", "ISO-8859-1").alias("word"), "n_near",
        (-F.col("top.minus")).alias("best_n"), F.decode("top.best", "ISO-8859-1").alias("best"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each round a word takes over where its form leads to.

    Counts double along a chain of forms, so it has 63 words at most and six rounds do.
    """
    lead = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    now, seen = materialize_observed(lead, "roots", moved=F.count(F.lit(1)))
    while seen["moved"]:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = lookup_join(now, next_, ["root"])
        now, seen = materialize_observed(
            moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "roots", moved=F.max(F.col("_moved").cast("int")),
        )
        now = now.drop("_moved")
    return now


def variant_groups(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that takes part."""
    counted = count_words(docs.select("doc_id", "text"), min_letters, min_count)
    # The number of words sets only how many groups and partitions there are.
    words, seen = materialize_observed(counted, "words", k=F.count(F.lit(1)))
    near = near_words(words, seen["k"] or 0)
    known = words.join(near, "word", "left")
    worth = F.col("best_n") >= ratio * F.col("n")
    told = materialize(
        known.select(
            "word", F.when(worth, F.col("best")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(worth, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    return told.join(roots(told.select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
