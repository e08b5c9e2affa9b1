"""Near-duplicate documents by Order MinHash and banded alignment.

A text is its words in lower case. Its k-mers are three words in a row, labelled with the
number of times the same three words came before, so that repeats count. A sketch takes the
``KEPT`` k-mers with the least hashes and keeps them in text order, which makes it sensitive
to edit similarity and not only to shared k-mers. Texts that agree in one of ``SKETCHES``
sketches are candidates. A link is verified by banded alignment of the words: 1 - edit
distance / length of the longer text must be 0.8 or more.

Texts of few words have too few k-mers for that. Where the shorter text has ``SHORT`` words or
fewer, candidates are exact: a text cut into one piece more than edits are allowed keeps a
piece whole, near its place. Texts that share such a piece are candidates too.

Classes are the connected components of verified links. Equal word sequences are one text
from the start. Candidates are first compared with the least text of their sketch; texts
that then are in different components are all looked at in blocks of bounded size, so no link
is lost, while a group of any size that hangs together costs one comparison for each member
and sketch.

Null text, and text without a word, is a class of its own. A text of fewer than three words
has one k-mer. Rows with equal ids are one document with one of their texts: null if one
of them is null, else the one with the least MD5.
The class is the least document id in it. Other columns are not read. Null ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import WORD, mix
from rosterlink.llm.components import components
from rosterlink.sources.tables import materialize, materialize_observed

SHINGLE, SIMILARITY = 3, 0.8
#: Sketches of a text, and k-mers that each of them keeps. Scattered edits at the limit leave
#: 0.8 ** 3 of the k-mers, which is 0.34 of those of both texts; such a pair agrees in a sketch
#: with a chance of 0.34 ** 2 and misses all of them with one of 1 in 300.
SKETCHES, KEPT = 48, 2
#: Words of a text up to which candidates are found by whole pieces.
SHORT = 32
CACHED_WORDS = 200_000
#: Words of the texts in one block of a sketch; bins of a bag of words.
BLOCK_WORDS, BINS = 400_000, 1_024
#: K-mers times sketches that are ranked at once; an odd factor that spreads bits.
MATRIX, SPREAD = 1 << 16, np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row, by their start."""
    n = max(1, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(hashes))):
        out = mix(out * np.uint64(31) + hashes[i : i + n], 7)
    return out


def kmers(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers in text order, each labelled with its earlier occurrences."""
    out = runs(hashes, size)
    n = len(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(out + label * np.uint64(0x9E3779B97F4A7C15), 11)


def sketches(found: np.ndarray, seeds: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Hashes of the least k-mers in text order, one for each seed."""
    out = []
    rows = max(1, MATRIX // len(found))
    for i in range(0, len(seeds), rows):
        ranked = (found[None, :] ^ seeds[i : i + rows, None]) * SPREAD
        ranked ^= ranked >> np.uint64(32)
        ranked *= SPREAD
        if len(found) > kept:
            # Few are kept, so looking for the least again and again is the quickest.
            least, every = [], np.arange(len(ranked))
            for _ in range(kept):
                least.append(ranked.argmin(axis=1))
                ranked[every, least[-1]] = ~np.uint64(0)
            best = np.sort(np.stack(least, axis=1), axis=1)
        else:
            best = np.broadcast_to(np.arange(len(found)), (len(ranked), len(found)))
        value = np.zeros(len(ranked), np.uint64)
        for k in range(best.shape[1]):
            value = mix(value * np.uint64(31) + found[best[:, k]], 13)
        out.append(value ^ seeds[i : i + rows])
    return np.concatenate(out)


def sketch_seeds(number: int = SKETCHES) -> np.ndarray:
    return mix(np.arange(number, dtype=np.uint64), 5_000)


def edits_of(n: int) -> int:
    """The most edits of a pair whose longer text has ``n`` words."""
    return int((1 - SIMILARITY) * n + 1e-9)


def piece_places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a text of ``n`` words can hold a piece of a text that is not longer: a code of
    that text's length and the number of the piece, its start here and its words.

    A text of m words is cut into one piece more than the edits of any pair in which it is the
    shorter. Of a pair within them, some piece stays whole and is moved by no more than the
    edits before it, and the ones behind it, can move it.
    """
    found = []
    for m in range(n - edits_of(n), min(n, SHORT) + 1):
        longest = m
        while longest + 1 - edits_of(longest + 1) <= m:
            longest += 1
        edits, moved = edits_of(longest), n - m
        if not edits:
            continue  # only equal texts, which are one already
        cuts = [m * i // (edits + 1) for i in range(edits + 2)]
        for i, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            low = max(0, start - i, start + moved - (edits - i))
            high = min(n - (end - start), start + i, start + moved + edits - i)
            found += [(m * 1_000 + i, at, end - start) for at in range(low, high + 1)]
    code, at, size = (np.array([f[c] for f in found], np.int64) for c in range(3))
    return code.astype(np.uint64), at, size


def pieces(hashes: np.ndarray, places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Keys of a text's pieces; two texts within the edits share one if the shorter has
    ``SHORT`` words or fewer. ``places`` remembers ``piece_places`` by length."""
    n = len(hashes)
    if n - edits_of(n) > SHORT:
        return np.empty(0, np.uint64)
    if n not in places:
        places[n] = piece_places(n)
    code, at, size = places[n]
    out = [
        mix(runs(hashes, k)[at[size == k]] + code[size == k] * np.uint64(0x9E3779B97F4A7C15), 17)
        for k in np.unique(size).tolist()
    ]
    return np.unique(np.concatenate([*out, np.empty(0, np.uint64)]))


def text_digest(words: list[str]) -> str | None:
    """What equal word sequences have in common; null for none."""
    return xxhash.xxh3_128_hexdigest(" ".join(words)) if words else None


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, pick, text_id, n, keys, pieces``; a text without words has null ``text_id`` and no
    keys. Of rows with equal ids, the one with the least ``pick`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, seeds, places = WordHashes(), sketch_seeds(), {}
        for batch in batches:
            ids, numbers, keys, parts = [], [], [], []
            for value in batch["text"]:
                words = words_of(value.as_py())
                numbers.append(len(words))
                ids.append(text_digest(words))
                if words:
                    h = hashed.of(words)
                    keys.append(sketches(kmers(h), seeds).view(np.int64))
                    parts.append(pieces(h, places).view(np.int64))
                else:
                    keys.append(None)
                    parts.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["pick"], pa.array(ids, pa.string()), pa.array(numbers, pa.int64()),
                    *(pa.array(k, pa.list_(pa.int64())) for k in (keys, parts)),
                ],
                ["doc_id", "pick", "text_id", "n", "keys", "pieces"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _pick().alias("pick")).mapInArrow(
        run, "doc_id long, pick string, text_id string, n long, keys array<long>, pieces array<long>"
    )


def _pick() -> Column:
    """By what one of several texts with one id is chosen: null first, then by digest."""
    return F.coalesce(F.md5("text"), F.lit(""))


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is ``most`` or less, else ``most + 1``.

    A band of ``most`` diagonals on each side of the main one is aligned column by column; the
    differences between neighbouring cells of a column are the bits of two integers.
    """
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    if n == 0:
        return m
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Row i of column j is bit i - (j - most) of the window; rows above the text match nothing.
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full ^ ((1 << most) - 1), 0
    bottom = 1 << (width - 1)
    # The cell followed lies on the lower edge of the band, then on the last row.
    distance = min(most, n)
    for j, x in enumerate(b):
        shift = j - most
        bits = where.get(x, 0)
        match = (bits >> shift if shift >= 0 else bits << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if j + most < n:
            distance += not diagonal & bottom
        else:
            last = 1 << (n - 1 - shift)
            distance += bool(right_up & last) - bool(right_down & last)
        up = (right_down | ~((diagonal >> 1) | right_up)) & full
        down = (diagonal >> 1) & right_up
    return distance if distance <= most else most + 1


def similar(a: str | None, b: str | None, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length reaches ``least`` for the words of two texts.

    The band grows step by step, so that texts which hardly differ cost little.
    """
    return similar_words(words_of(a), words_of(b), least)


def similar_words(x: list[str], y: list[str], least: float = SIMILARITY) -> bool:
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    band = min(most, 8)
    while True:
        if edit_distance(x, y, band) <= band:
            return True
        if band == most:
            return False
        band = min(most, band * 4)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar; ``texts`` has ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["text_a"], batch["text_b"], strict=True)
            keep = pa.array([similar(x.as_py(), y.as_py()) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(keep)

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def _bags(hashes: list[np.ndarray]) -> np.ndarray:
    """How many words of each text fall into each of ``BINS`` bins."""
    out = np.zeros((len(hashes), BINS), np.uint16)
    for row, h in zip(out, hashes, strict=True):
        row[:] = np.minimum(np.bincount((h >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 65_535)
    return out


def _compare_cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between texts of one sketch that are in different components.

    A pair is looked at where its first common sketch is. Two texts can be similar only if
    they share enough words, whatever their order; bins of words bound that number from above
    and rule out most pairs before any is aligned.
    """
    s, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    ids, top, component, n, block = (
        rows[c].to_numpy() for c in ("doc_id", "top", "component", "n", "block")
    )
    keys = np.array(rows["keys"].to_pylist(), np.int64)
    words = [words_of(t) for t in rows["text"].to_pylist()]
    hashed = WordHashes()
    bags = _bags([hashed.of(w) for w in words])
    forest = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while forest[c] != c:
            forest[c] = forest[forest[c]]
            c = forest[c]
        return c

    links: list[tuple[int, int]] = []
    for i in range(len(ids)):
        fit = (ids > ids[i]) & (component != component[i])
        fit &= np.minimum(n, n[i]) >= SIMILARITY * np.maximum(n, n[i])
        if low != high:
            fit &= block != block[i]
        if top[i] == ids[i]:
            continue  # compared with all texts of the sketch before
        at = np.flatnonzero(fit & (ids != top[i]))
        at = at[~(keys[at, :s] == keys[i, :s]).any(axis=1)]
        for j in range(0, len(at), 4_096):
            part = at[j : j + 4_096]
            shared = np.minimum(bags[part], bags[i]).sum(axis=1, dtype=np.int64)
            # Counts at the limit of a bin say nothing about such a text.
            open_end = (bags[part] == 65_535).any(axis=1) | (bags[i] == 65_535).any()
            for k in part[open_end | (shared >= SIMILARITY * np.maximum(n[part], n[i]) - 1e-6)].tolist():
                a, b = root(int(component[i])), root(int(component[k]))
                if a != b and similar_words(words[i], words[k]):
                    forest[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[k])))
    return pa.table({name: pa.array([x[c] for x in links], pa.int64()) for c, name in enumerate("ab")})


def links_apart(buckets: DataFrame, grouped: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts that share a sketch but are in different components so far.

    ``buckets``: ``s, key, doc_id, n, top``; ``grouped``: ``node, component``; ``texts``: ``doc_id,
    text, keys``, or ``keys`` in the buckets. A sketch with many words in its texts is cut into
    blocks by a hash; each pair of blocks is one group of bounded size. Texts and keys join only
    the rows of these groups, and of the keys only those of earlier sketches go on. Pairs are
    looked at inside the task and only links leave it.
    """
    carried = [] if "keys" in texts.columns else ["keys"]
    apart = buckets.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "s", "key", "doc_id", "n", *carried, F.col("top.doc_id").alias("top"),
        F.coalesce("component", "doc_id").alias("component"),
    )
    sizes = apart.groupBy("s", "key").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.sum("n").alias("words")
    ).filter("first < last")
    blocks = sizes.select("s", "key", F.ceil(F.col("words") / BLOCK_WORDS).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = (
        apart.join(blocks, ["s", "key"])
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .select("*", other)
        .select(
            "s", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "block", "doc_id", "top", "component", "n", *carried,
        )
    )
    whole = cells.join(texts, "doc_id").withColumn("keys", F.slice("keys", F.lit(1), F.col("s")))
    return whole.groupBy("s", "key", "low", "high").applyInArrow(_compare_cell, "a long, b long")


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for each different document id."""
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = materialize(
        sketched(known)
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("text_id", "n", "keys", "pieces"), F.col("pick")).alias("s"))
        .select("doc_id", "s.*"),
        "sketches",
    )
    copies = signed.filter("text_id is not null").groupBy("text_id").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    firsts = signed.join(copies.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    # Pieces come after all sketches, as one more number, and pairs that share a sketch are done there.
    keyed = firsts.select("doc_id", "n", F.posexplode("keys").alias("s", "key")).unionByName(
        firsts.select("doc_id", "n", F.lit(SKETCHES).alias("s"), F.explode("pieces").alias("key"))
    )
    shared = keyed.groupBy("s", "key").agg(
        F.min(F.struct("doc_id", "n")).alias("top"), F.count(F.lit(1)).alias("size")
    ).filter("size > 1")
    near = F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")
    members = materialize(
        keyed.join(shared.select("s", "key", "top"), ["s", "key"]), "buckets"
    )
    first_pairs = materialize(
        members.select(
            F.col("top.doc_id").alias("a"), F.col("doc_id").alias("b"), "n",
            F.col("top.n").alias("m"),
        )
        .filter("a <> b").filter(near).select("a", "b").distinct(),
        "first-pairs",
    )
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(members.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id").agg(F.min_by("text", _pick()).alias("text"))
    )
    links = materialize(verified(first_pairs, texts), "links")
    grouped = components(links)
    known = texts.join(signed.select("doc_id", "keys"), "doc_id")
    more = materialize(links_apart(members, grouped, known), "more-links")
    grouped = components(links.unionByName(more))
    roots = grouped.select(F.col("node").alias("first"), "component")
    classes = copies.join(roots, "first", "left").select(
        "text_id", F.coalesce("component", "first").alias("class_id")
    )
    return signed.join(classes, "text_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one with the least id. Null ids stay."""
    classes = duplicate_classes(docs.select("doc_id", "text"))
    copies = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("copy"))
    # The columns of the input are one column meanwhile, so their names meet no others.
    whole = docs.select(F.struct("*").alias("doc"))
    return whole.join(copies, F.col("doc.doc_id").cast("long") == F.col("copy"), "left_anti").select("doc.*")
