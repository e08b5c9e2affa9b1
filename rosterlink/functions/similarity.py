"""Jaro-Winkler similarity over UTF-8 bytes as an Arrow-batched function.

Spark has no built-in for it. The kernel works on the offsets and bytes of Arrow columns: it
compares all pairs of a batch at once, one byte position at a time, and looks at each distinct
pair of the batch only once. No text becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PREFIX_LENGTH = 4
PREFIX_WEIGHT = 0.1
BOOST_ABOVE = 0.7
CHUNK = 8192
#: Left texts of a matrix of pairs, its most pairs, the least that pay, and pairs looked at together otherwise.
BLOCK_TEXTS, BLOCK_PAIRS, LEAST_PAIRS, FEW_PAIRS = 1024, 1 << 14, 1 << 11, 1 << 17
WORD = 64
#: Classes of bytes that are counted to bound a similarity.
CLASSES = 64


class Texts:
    """Texts as bytes, each by its number."""

    def __init__(self, texts: pa.Array) -> None:
        raw = texts.cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        held = raw.buffers()[2]
        self.data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        self.starts = ends[:-1].astype(np.int64)
        self.lengths = np.diff(ends).astype(np.int64)
        self._classes: np.ndarray | None = None
        self._heads: np.ndarray | None = None

    def matrix(self, rows: np.ndarray, width: int, pad: int) -> np.ndarray:
        """Bytes of the rows, cut or filled up to one width with a byte that UTF-8 never uses."""
        lengths = np.minimum(self.lengths[rows], width)
        out = np.full((len(rows), width), pad, np.uint8)
        first = np.repeat(self.starts[rows], lengths)
        step = np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.arange(width) < lengths[:, None]] = self.data[first + step]
        return out

    def classes(self) -> np.ndarray:
        """By class, how many of its bytes each text has, up to 255."""
        if self._classes is None:
            row = np.repeat(np.arange(len(self.lengths)), self.lengths)
            every = self.letters_of(row)
            flat = np.bincount(row * CLASSES + every % CLASSES, minlength=len(self.lengths) * CLASSES)
            self._classes = np.ascontiguousarray(np.minimum(flat, 255).astype(np.uint8).reshape(-1, CLASSES).T)
        return self._classes

    def heads(self) -> np.ndarray:
        """The first bytes of each text as one number, those it lacks as bytes that UTF-8 never uses."""
        if self._heads is None:
            every = self.matrix(np.arange(len(self.lengths)), PREFIX_LENGTH, 0xFF).astype(np.uint32)
            self._heads = every @ (1 << np.arange(0, 8 * PREFIX_LENGTH, 8, dtype=np.uint32))
        return self._heads

    def letters_of(self, row: np.ndarray) -> np.ndarray:
        """The bytes of all texts, one text after the other; ``row`` says whose each is."""
        begins = np.cumsum(self.lengths) - self.lengths
        return self.data[self.starts[row] + np.arange(len(row)) - begins[row]]


def _words(bits: int, count: int) -> np.ndarray:
    """A whole number as little-endian 64-bit words."""
    return np.array([bits >> WORD * k & (1 << WORD) - 1 for k in range(count)], dtype=np.uint64)


def _boosted(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


def _places(letters: np.ndarray, count: int) -> np.ndarray:
    """By text and byte, where in the text the byte is, as bits of ``count`` words."""
    out = np.zeros((len(letters), 256, count), np.uint64)
    rows = np.arange(len(letters))
    for k in range(letters.shape[1]):
        out[rows, letters[:, k], k // WORD] |= np.uint64(1 << k % WORD)
    return out


def _same_window(
    left: Texts, i: np.ndarray, right: Texts, j: np.ndarray, window: int, least: float
) -> np.ndarray:
    """Similarities of pairs that share one match window.

    The free positions of the left text are bits; each position of the right text takes the
    lowest free bit with the same byte inside the window. Where the matches alone rule out
    ``least``, transpositions are not looked at and the result is what there would be without.
    """
    n_left, n_right = left.lengths[i], right.lengths[j]
    wide_left, wide_right = int(n_left.max()), int(n_right.max())
    if wide_left == 0 or wide_right == 0:
        return np.zeros(len(i))
    count = -(-wide_left // WORD)
    different, own = np.unique(i, return_inverse=True)
    a = left.matrix(different, count * WORD, 0xFF)
    b = right.matrix(j, wide_right, 0xFE)
    places = _places(a[:, :wide_left], count)
    free = np.full((len(i), count), ~np.uint64(0))
    hits = np.zeros((wide_right, len(i)), dtype=bool)
    rows, letters = np.arange(len(i)), np.ascontiguousarray(b.T)
    flat, first, only = places.reshape(-1, count), own * 256, free[:, 0]
    for k in range(wide_right):
        low_end = max(0, k - window)
        if low_end >= wide_left:
            break
        reach = _words((1 << k + window + 1) - (1 << low_end), count)
        if count == 1:
            word = flat[first + letters[k], 0]
            word &= only
            word &= reach[0]
            only ^= word & (~word + np.uint64(1))
        else:
            open_bits = flat[first + letters[k]] & free & reach
            at = (open_bits != 0).argmax(axis=1)
            word = open_bits[rows, at]
            free[rows, at] ^= word & (~word + np.uint64(1))
        hits[k] = word != 0
    hit = hits.T
    m = hits.sum(axis=0)
    depth = min(PREFIX_LENGTH, wide_left, wide_right)
    prefix = np.cumprod(a[own, :depth] == b[:, :depth], axis=1).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = m / n_left + m / n_right
        jaro = np.where(m > 0, (known + 1.0) / 3.0, 0.0)
        look = np.flatnonzero((m > 0) & (_boosted(jaro, prefix) >= least))
        if len(look):
            used = np.unpackbits((~free[look]).view(np.uint8), axis=1, bitorder="little").astype(bool)
            # Both list the matched bytes pair by pair, in their order.
            differs = a[own[look]][used] != b[look][hit[look]]
            pair = np.repeat(np.arange(len(look)), m[look])
            half = np.bincount(pair, weights=differs, minlength=len(look)) // 2
            jaro[look] = (known[look] + (m[look] - half) / m[look]) / 3.0
    return _boosted(jaro, prefix)


def similarities(
    left: Texts, i: np.ndarray, right: Texts, j: np.ndarray, least: float = 0.0
) -> np.ndarray:
    """Similarity of ``left`` number ``i[k]`` and ``right`` number ``j[k]``; where it is below
    ``least``, some number below that may stand for it. Pairs with one match window go together."""
    longest = np.maximum(left.lengths[i], right.lengths[j])
    windows = np.maximum(longest // 2 - 1, 0)
    order = np.lexsort((i, windows))
    ends = np.flatnonzero(np.diff(windows[order], append=-1)) + 1
    result = np.zeros(len(i))
    start = 0
    for end in ends.tolist():
        window = int(windows[order[start]])
        # Longer texts take more words for each byte, so fewer pairs go together.
        step = max(1, CHUNK // (1 + 2 * window // WORD) ** 2)
        for at in range(start, end, step):
            part = order[at : min(end, at + step)]
            result[part] = _same_window(left, i[part], right, j[part], window, least)
        start = end
    return result


def _letter_places(
    texts: Texts, rows: np.ndarray, count: int, kind: type
) -> tuple[np.ndarray, np.ndarray]:
    """By word, letter and text, where in the text the letter is, as bits; and the number of each
    byte's letter. Letter 0 stands for all bytes that none of the texts has."""
    bits = np.dtype(kind).itemsize * 8
    held = texts.matrix(rows, int(texts.lengths[rows].max()), 0xFF)
    known = np.unique(held)
    known = known[known != 0xFF]
    letter = np.zeros(256, np.int64)
    letter[known] = 1 + np.arange(len(known))
    out = np.zeros((count, len(known) + 1, len(rows)), kind)
    every = np.arange(len(rows))
    for k in range(held.shape[1]):
        out[k // bits, letter[held[:, k]], every] |= kind(1 << k % bits)
    out[:, 0] = 0
    return out, letter


def _differing(
    places: np.ndarray, coded: np.ndarray, used: np.ndarray, hits: np.ndarray, at: np.ndarray | None
) -> np.ndarray:
    """How many matched letters of a matrix of pairs differ from those at their place in the order
    of the other text; with ``at``, only for these pairs."""
    shape = hits.shape[1:]
    if at is not None:
        row, column = np.divmod(at, shape[1])
        used = used.reshape(len(places), -1)[:, at]
        flat, begin = places.reshape(len(places), -1), coded * shape[1]
    out = np.zeros(used.shape[1:], np.uint16 if len(hits) < 1 << 16 else np.int64)
    for k, want in enumerate(hits):
        if at is not None:
            want, here = want.ravel()[at], begin[row, k] + column
        for q, place in enumerate(places):
            low = np.negative(used[q])
            low &= used[q]
            low *= want
            used[q] ^= low
            own = np.take(place, coded[:, k], axis=0) if at is None else flat[q][here]
            np.invert(own, out=own)
            own &= low
            out += own != 0
            if q + 1 < len(places):
                want = want & (low == 0)
    if at is None:
        return out
    every = np.zeros(shape, out.dtype)
    every.ravel()[at] = out
    return every


def _block(
    left: Texts, i: np.ndarray, places: np.ndarray, letter: np.ndarray, right: Texts, j: np.ndarray, least: float
) -> np.ndarray:
    """Similarities of all of ``i`` with all of ``j``, which have one length; a row for each of
    ``j``. As in ``_same_window``, with the pairs as a matrix."""
    kind, bits = places.dtype.type, places.dtype.itemsize * 8
    n_left, n_right = left.lengths[i], int(right.lengths[j[0]])
    shape = len(j), len(i)
    if n_right == 0:
        return np.zeros(shape)
    b = right.matrix(j, n_right, 0xFE)
    coded = letter[b]
    window = np.maximum(np.maximum(n_left, n_right) // 2 - 1, 0)
    # The lowest x bits, for each x.
    lowest = np.array([(1 << x) - 1 for x in range(bits + 1)], kind)
    free = np.full((len(places), *shape), ~kind(0))
    hits = np.zeros((n_right, *shape), bool)
    word, low = np.empty(shape, kind), np.empty(shape, kind)
    for k in range(n_right):
        for q, place in enumerate(places):
            last = np.clip(k + window + 1 - q * bits, 0, bits)
            first = np.clip(k - window - q * bits, 0, bits)
            np.take(place, coded[:, k], axis=0, out=word)
            word &= lowest[last] ^ lowest[first]
            word &= free[q]
            np.negative(word, out=low)
            low &= word
            if q:
                low *= ~hits[k]
            free[q] ^= low
            hits[k] |= low != 0
    m = hits.sum(axis=0)
    a = left.matrix(i, PREFIX_LENGTH, 0xFF)
    prefix, alike = np.zeros(shape, np.int64), np.ones(shape, bool)
    for k in range(min(PREFIX_LENGTH, n_right)):
        alike &= a[:, k] == b[:, k, None]
        prefix += alike
    with np.errstate(divide="ignore", invalid="ignore"):
        known = m / n_left + m / n_right
        jaro = np.where(m > 0, (known + 1.0) / 3.0, 0.0)
        look = (m > 0) & (_boosted(jaro, prefix) >= least)
        if look.any():
            # The places used, from the left, against the hits, from the left: both in the order of their texts.
            differs = _differing(places, coded, ~free, hits, np.flatnonzero(look) if look.mean() < 0.5 else None)
            jaro[look] = (known[look] + (m[look] - differs[look] // 2) / m[look]) / 3.0
    return _boosted(jaro, prefix)


def similarity_blocks(
    left: Texts, i: np.ndarray, right: Texts, j: np.ndarray, least: float = 0.0
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similarities of all of ``left`` numbers ``i`` with all of ``right`` numbers ``j``, part by
    part: places in ``i``, places in ``j`` and a matrix with a row for each of the latter. Where
    one is below ``least``, some number below that may stand for it."""
    words = np.where(left.lengths[i] <= WORD // 2, 0, -(-left.lengths[i] // WORD))
    lengths = right.lengths[j]
    order = np.argsort(lengths, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []
    for count in np.unique(words).tolist():
        every = np.flatnonzero(words == count)
        for start in range(0, len(every), BLOCK_TEXTS):
            own = every[start : start + BLOCK_TEXTS]
            rows, few = i[own], []
            places, letter = _letter_places(left, rows, max(1, count), np.uint64 if count else np.uint32)
            step = max(1, BLOCK_PAIRS // (len(own) * max(1, count)))
            for group in groups:
                if len(group) * len(own) < LEAST_PAIRS * max(1, count) ** 2:
                    few.append(group)
                    continue
                for at in range(0, len(group), step):
                    part = group[at : at + step]
                    yield own, part, _block(left, rows, places, letter, right, j[part], least)
            # Lengths too rare for a matrix to pay.
            rest = np.concatenate(few) if few else order[:0]
            step = max(1, FEW_PAIRS // len(own))
            for at in range(0, len(rest), step):
                part = rest[at : at + step]
                a, b = np.tile(rows, len(part)), np.repeat(j[part], len(own))
                yield own, part, similarities(left, a, right, b, least).reshape(len(part), len(own))


def at_most(left: Texts, i: np.ndarray, right: Texts, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarities: as if all bytes that both texts have were matched, in
    order, and the beginnings were as alike as they are."""
    shared = np.zeros(len(i), np.uint16)
    a, b = left.classes(), right.classes()
    long = (left.lengths[i] > 255) | (right.lengths[j] > 255)
    for k in np.flatnonzero(a.any(axis=1) & b.any(axis=1)):
        shared += np.minimum(a[k][i], b[k][j])
    shared = np.where(long, np.minimum(left.lengths[i], right.lengths[j]), shared)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (shared / left.lengths[i] + shared / right.lengths[j] + 1.0) / 3.0
    jaro = np.where(shared > 0, jaro, 0.0)
    # Bytes that both lack count as alike, which no upper bound minds.
    differ = left.heads()[i] ^ right.heads()[j]
    prefix = np.zeros(len(i), np.int64)
    for k in range(1, PREFIX_LENGTH + 1):
        prefix += differ & np.uint32((1 << 8 * k) - 1) == 0
    return _boosted(jaro, prefix)


def jaro_winkler_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of ``left[i]`` and ``right[i]``."""
    every = np.arange(len(left))
    return similarities(Texts(pa.array(left, pa.string())), every, Texts(pa.array(right, pa.string())), every)


def _numbered(texts: pa.Array) -> tuple[Texts, np.ndarray]:
    """The distinct texts, and the number of each row's; -1 for null."""
    coded = texts.dictionary_encode()
    return Texts(coded.dictionary), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def jaro_winkler_arrays(left: pa.Array, right: pa.Array) -> pa.Array:
    """Null where either side is null; each distinct pair is worked out once."""
    a, i = _numbered(left)
    b, j = _numbered(right)
    known = (i >= 0) & (j >= 0)
    pairs, slot = np.unique(i[known] * max(1, len(b.lengths)) + j[known], return_inverse=True)
    out = np.zeros(len(i))
    if len(pairs):
        out[known] = similarities(a, pairs // len(b.lengths), b, pairs % len(b.lengths))[slot]
    return pa.array(out, mask=~known)


jaro_winkler = F.arrow_udf(jaro_winkler_arrays, DoubleType())
