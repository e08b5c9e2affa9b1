"""Byte-level BPE encoding and decoding by an index of pair occurrences.

Words get numbers as texts are read; a text that waits for its ids is the numbers of its words.
The distinct words are laid out in one array of symbols, a bounded part at a time. The index
holds, for each pair that can be merged, all its positions. Ranks that are active are applied in
ascending order, each to all its positions at once, and every merge updates the positions of the
pairs beside it. The vocabulary is that of a tokenizers JSON file, whose path is a parameter.

Null text counts as empty: it has no ids. Ids that the vocabulary lacks fail on decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Below this character lies none of ``UNKNOWN_LETTERS``.
LOW = "\u0530"
#: Words and their characters at which the cache starts anew. Neither changes a result.
CACHED_WORDS, CACHED_CHARS = 200_000, 8_000_000
#: Characters of text, or new words, whose new words are merged before the next text.
BATCH_CHARS, BATCH_WORDS = 8_000_000, 50_000
#: Bytes of words in one index, if there is more than one word. None of these changes a result.
INDEXED_BYTES = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizers JSON file as plain lists, small enough to send to every task."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or file["normalizer"]:
        raise ValueError("only byte-level BPE without a normalizer is supported")
    if pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        raise ValueError("prefix space, own split and ignore_merges are not supported")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        raise ValueError("added tokens that strip or match whole words are not supported")
    alphabet, ids = byte_alphabet(), model["vocab"]
    spelled = {i: bytes(alphabet[c] for c in token) for token, i in ids.items()}
    spelled |= {i: content.encode() for content, i in special.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    by_byte = {b: ids[c] for c, b in alphabet.items()}
    return {
        "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges],
        "spelled": spelled,
        "bytes": [by_byte[b] for b in range(256)],
        "special": special,
    }


def _not_overlapping(p: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions whose pairs may share a symbol, those merged from left to right."""
    keep, taken = [], -1
    for spot, following in zip(p.tolist(), after[p].tolist(), strict=True):
        if spot != taken:
            keep.append(spot)
            taken = following
    return np.array(keep, np.int64)


class Rows:
    """Rows of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of(rows: list[list[int]], kind: type = np.int64) -> Rows:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return Rows(np.fromiter(chain.from_iterable(rows), kind, int(lengths.sum())), lengths)

    def plus(self, *others: Rows) -> Rows:
        rows = [self, *others]
        return Rows(
            np.concatenate([r.flat for r in rows]), np.concatenate([r.lengths for r in rows])
        )

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The rows asked for, one after the other."""
        lengths = self.lengths[at]
        first = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        return self.flat[np.repeat(self.starts[at] - first, lengths) + np.arange(total)]


class Numbers(dict):
    """Numbers words from 0 in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Codec:
    """Encodes and decodes texts; made once per task."""

    def __init__(self, vocabulary: dict):
        self.merges = vocabulary["merges"]
        rank = {a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.keys = np.fromiter(rank, np.int64, len(rank))
        self.key_ranks = np.fromiter(rank.values(), np.int64, len(rank))
        order = np.argsort(self.keys)
        self.keys, self.key_ranks = self.keys[order], self.key_ranks[order]
        self.by_byte = np.array(vocabulary["bytes"], np.int32)
        self.special = vocabulary["special"]
        spelled = vocabulary["spelled"]
        size = max(spelled) + 1
        self.spelled = Rows.of([list(spelled.get(i, b"")) for i in range(size)], np.uint8)
        self.decimal = Rows.of([list(f"{i},".encode()) for i in range(size)], np.uint8)
        named = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.named = regex.compile(f"({'|'.join(named)})") if named else None
        self.split = regex.compile(split_pattern())
        self.split_low = re.compile(low_pattern())
        self.forget()

    def forget(self) -> None:
        """Start the cache anew, with the added tokens alone."""
        self.known = Numbers((token, number) for number, token in enumerate(self.special))
        self.ids = Rows.of([[i] for i in self.special.values()], np.int32)
        self.known_chars = 0

    def words(self, text: str) -> list[str]:
        split = self.split_low if text.isascii() or max(text) < LOW else self.split
        if self.named is None or not any(s in text for s in self.special):
            return split.findall(text)
        out: list[str] = []
        for part in self.named.split(text):
            out.extend([part] if part in self.special else split.findall(part))
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and the number of each word's, by the index of pair
        occurrences over all of them.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)
        flat = np.full(int(ends[-1]) if len(words) else 0, -1, np.int32)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = self.by_byte[np.frombuffer(b"".join(words), np.uint8)]
        at, ranks = self._pairs(flat)
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        active, first = np.unique(ranks, return_index=True)
        places = {
            int(r): array("i", part.astype(np.int32).tobytes())
            for r, part in zip(active, np.split(at, first[1:]), strict=True)
        } if len(active) else {}
        symbols = flat
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b, made = self.merges[r]
            p = np.unique(np.frombuffer(places.pop(r), np.int32))
            p = p[(symbols[p] == a) & (symbols[after[p]] == b)]
            if a == b:
                p = _not_overlapping(p, after)
            q = after[p]
            symbols[p], symbols[q] = made, -2
            s = after[q]
            after[p], before[s] = s, p
            left, right = symbols[before[p]].astype(np.int64), symbols[s].astype(np.int64)
            keys = np.concatenate([left << 32 | made, made << 32 | right])
            at = np.concatenate([before[p], p])
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[found] == keys) & (np.concatenate([left, right]) >= 0))
            for new, spot in zip(
                self.key_ranks[found[hit]].tolist(), at[hit].tolist(), strict=True
            ):
                if new in places:
                    places[new].append(spot)
                else:
                    places[new] = array("i", (spot,))
                    heapq.heappush(heap, new)
        left = symbols >= 0
        before_end = np.concatenate([[0], np.cumsum(left)])
        stops = before_end[ends - 1] if len(words) else ends
        return symbols[left], np.diff(stops, prepend=0)

    def _pairs(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ranks of the pairs that can be merged."""
        if len(flat) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = np.where(
            (flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1].astype(np.int64) << 32 | flat[1:], -1
        )
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[found] == keys)
        return at, self.key_ranks[found[at]]

    def learn(self) -> Rows:
        """The ids of all known words, after those that have none yet are merged."""
        new = list(islice(self.known, len(self.ids.lengths), None))
        self.known_chars += sum(map(len, new))
        words = [w.encode() for w in new]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.flatnonzero(np.diff(ends // INDEXED_BYTES)) + 1
        parts = zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)], strict=True)
        self.ids = self.ids.plus(*[Rows(*self.merge(words[a:b])) for a, b in parts])
        return self.ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.spelled.gather(ids).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def encoded(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. What waits for them is the numbers of its words, not the words."""
        batch: list[np.ndarray] = []
        size = 0
        for text in texts:
            if not batch and (len(self.known) > CACHED_WORDS or self.known_chars > CACHED_CHARS):
                self.forget()
            words = self.words(text)
            batch.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            size += len(text)
            if size >= BATCH_CHARS or len(self.known) - len(self.ids.lengths) >= BATCH_WORDS:
                yield from map(self.learn().gather, batch)
                batch, size = [], 0
        yield from map(self.learn().gather, batch)


# Letters and numbers of the newest Unicode that the vocabulary's library does
# not know yet; it treats them as other characters.
UNKNOWN_LETTERS = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf
a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f
12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def split_pattern() -> str:
    """``SPLIT`` with its classes of letters and numbers, without ``UNKNOWN_LETTERS``."""
    ranges = [r.split("-") for r in UNKNOWN_LETTERS.split()]
    late = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ranges)
    letters, numbers = f"[\\p{{L}}--[{late}]]", f"[\\p{{N}}--[{late}]]"
    filled = SPLIT.replace("[{L}]", letters).replace("[{N}]", numbers)
    return "(?V1)" + filled.replace("[^\\s{L}{N}]", f"[^\\s{letters}{numbers}]")


def low_pattern() -> str:
    """The same split for texts whose characters are all below ``LOW``, as plain classes.

    The standard library is several times as fast on such classes as on properties.
    """
    low = [chr(c) for c in range(ord(LOW))]

    def members(name: str) -> str:
        return "".join(re.escape(c) for c in low if regex.match(name, c))

    filled = SPLIT.replace("{L}", members(r"\p{L}")).replace("{N}", members(r"\p{N}"))
    return filled.replace(r"[^\s", "[^" + members(r"\s")).replace(r"\s", f"[{members(r'\s')}]").replace(
        r"\S", f"[^{members(r'\s')}]"
    )


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encoder(spark: SparkSession, path: str):
    """A column function: text to ids."""
    vocabulary = _broadcast(spark, path)

    @F.pandas_udf("array<int>")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary.value)
        for texts in batches:
            yield pd.Series([ids.tolist() for ids in codec.encoded(x or "" for x in texts)])

    return bpe_encode


def decoder(spark: SparkSession, path: str):
    """A column function: ids to text. Null ids count as none."""
    vocabulary = _broadcast(spark, path)

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary.value)
        for rows in batches:
            yield pd.Series([codec.decode([] if x is None else x) for x in rows])

    return bpe_decode


def digests(spark: SparkSession, path: str, text: str | Column) -> Column:
    """Number of ids, digest of the ids and digest of what they decode to, in one pass.

    Ids never leave the task, which matters where only their number or digest is wanted. Texts
    stay in Arrow and become strings one at a time.
    """
    vocabulary = _broadcast(spark, path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def bpe_digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(vocabulary.value)
        for texts in batches:
            counts, coded, decoded = [], [], []
            for ids in codec.encoded(x.as_py() or "" for x in texts):
                counts.append(len(ids))
                coded.append(hashlib.sha256(codec.decimal.gather(ids)[:-1]).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return bpe_digests(text)


def bpe_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id and the digests. Other columns are not read."""
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        digests(docs.sparkSession, path, F.col(text_col)).alias("d"),
    )
    return found.select("doc_id", "d.*")
