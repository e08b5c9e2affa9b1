"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put in another order.

Texts travel as UTF-8 bytes, and a cut is a number of code points, so the byte that a cut
stands for has to be looked up. A *learned rank index* does that: straight segments are fitted
to the byte offsets of all code point boundaries of a run of texts so that none is further off
than ``error`` bytes, a cut is predicted from its segment, and the residual stored for that
boundary makes the prediction exact. Runs of one-byte letters are one segment with no residuals
at all; other scripts take a few more.

``fill_in_middle`` returns the rearranged texts, ``restored`` the texts they came from. Cuts
and forms follow from the id alone, so a run can be repeated. Null text is empty text; a null
id is hashed like an empty one. Rows with the same id and text come out alike, and no row is
dropped. A byte that begins no code point belongs to the one before it (the first byte of a
text always begins one), so text that is not valid UTF-8 comes back as it was. Other columns
of the input are kept by ``fill_in_middle``; those named like its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import sha256_hex

# The marks, and the shares of a hundred that the contract sets.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

#: Bytes that a segment may be off by; bytes of text that are indexed at a time.
ERROR, RUN_BYTES = 100, 4 << 20
#: Boundaries that the fit looks at first; it looks at twice as many each time all of them fit.
FIRST_LOOK = 256


def fit_segments(offsets: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ranks, offsets there and slopes of segments that stay within ``error``.

    A segment begins at a boundary and grows while some slope keeps all boundaries so far
    within the bound: each of them narrows the range of slopes that are left.
    """
    firsts, bases, slopes = [], [], []
    start, end = 0, len(offsets)
    while start < end:
        base, look = offsets[start], FIRST_LOOK
        while True:
            steps = np.arange(1, min(look, end - start))
            rise = offsets[start + 1 : start + 1 + len(steps)] - base
            low = np.maximum.accumulate((rise - error) / steps)
            high = np.minimum.accumulate((rise + error) / steps)
            broken = np.flatnonzero(low > high)
            if len(broken) or start + look >= end:
                break
            look *= 2
        fits = int(broken[0]) if len(broken) else len(steps)
        firsts.append(start)
        bases.append(base)
        slopes.append((low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0)
        start += fits + 1
    return np.array(firsts, np.int64), np.array(bases, np.int64), np.array(slopes, np.float64)


class RankIndex:
    """From the rank of a boundary among all boundaries to its offset."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        self.firsts, self.bases, self.slopes = fit_segments(offsets, error)
        ranks = np.arange(len(offsets))
        off = offsets - self.predict(ranks)
        # The bound leaves room for rounding, so a residual takes one byte up to 126.
        self.residuals = off.astype(np.int8 if error <= 126 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.firsts, ranks, side="right") - 1
        line = self.bases[at] + self.slopes[at] * (ranks - self.firsts[at])
        return np.rint(line).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Offsets of the first bytes of all code points, and the end of the data."""
    begins = (data & 0xC0) != 0x80
    begins[starts[starts < end]] = True
    return np.append(np.flatnonzero(begins), end)


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows ``a`` to ``b`` that hold at most ``most`` bytes together, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def cut_texts(
    texts: pa.Array, picks: np.ndarray, error: int = ERROR, run_bytes: int = RUN_BYTES
) -> Iterator[tuple[np.ndarray, ...]]:
    """Byte buffers and cuts by run of texts.

    ``picks`` has two whole numbers for each text; modulo the number of places between code
    points they are its cuts. Yields rows ``a`` to ``b``, the bytes, and by text its start, first
    cut, second cut and end in them, then its code points, and those before each cut.
    """
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    for a, b in runs(places, run_bytes):
        own = places[a : b + 1].astype(np.int64) - places[a]
        part = data[places[a] : places[b]]
        at = boundaries(part, own[:-1], int(own[-1]))
        index = RankIndex(at, error)
        ranks = np.searchsorted(at, own)
        n = np.diff(ranks)
        cuts = np.sort(picks[a:b] % (n + 1)[:, None], axis=1)
        found = index.offset(ranks[:-1, None] + cuts)
        yield a, b, part.tobytes(), own[:-1], found[:, 0], found[:, 1], own[1:], n, cuts[:, 0], cuts[:, 1]


_CUT = "n long, prefix_chars long, middle_chars long, output binary"


def _arrange(rows: DataFrame, error: int, run_bytes: int) -> DataFrame:
    """``rest, n, form, prefix_chars, middle_chars, output`` from rows with text, form and picks."""
    schema = f"rest {rows.schema['rest'].dataType.simpleString()}, form string, {_CUT}"

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, form = batch["text"], batch["form"].to_pylist()
            picks = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1)
            for a, b, data, start, one, two, end, n, before, upto in cut_texts(texts, picks, error, run_bytes):
                made = []
                for f, s, x, y, e in zip(form[a:b], start, one, two, end, strict=True):
                    prefix, middle, suffix = data[s:x], data[x:y], data[y:e]
                    if f == "psm":
                        made.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                    elif f == "spm":
                        made.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                    else:
                        made.append(data[s:e])
                plain = np.array([f == "plain" for f in form[a:b]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["rest"].slice(a, b - a),
                        batch["form"].slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(before, pa.int64(), mask=plain),
                        pa.array(upto - before, pa.int64(), mask=plain),
                        pa.array(made, pa.binary()),
                    ],
                    ["rest", "form", "n", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(arranged, schema)


def _group(digest: str, number: int) -> Column:
    """The ``number``-th group of eight hex digits as a whole number."""
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    error: int = ERROR,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``docs`` without its text, and ``n, form, prefix_chars, middle_chars, output``.

    ``form`` is ``plain``, ``psm`` or ``spm``. ``transformed`` of a hundred texts are rearranged,
    ``suffix_first`` of a hundred of these with the suffix first; a text that holds a mark stays
    plain, and so does an empty one. Cuts are null in plain rows. No shuffle.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seed = F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    hashed = docs.select(
        F.struct(*rest).alias("rest"), text.alias("text"), sha256_hex(seed.cast("binary")).alias("digest")
    )
    holds_mark = [F.contains("text", F.lit(m.decode())) for m in (PREFIX, SUFFIX, MIDDLE)]
    form = (
        F.when(F.col("text") == "", "plain")
        .when(holds_mark[0] | holds_mark[1] | holds_mark[2], "plain")
        .when(_group("digest", 3) % 100 >= transformed, "plain")
        .when(_group("digest", 4) % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    rows = hashed.select(
        "rest", F.col("text").cast("binary").alias("text"), form.alias("form"),
        _group("digest", 1).alias("h1"), _group("digest", 2).alias("h2"),
    )
    done = _arrange(rows, error, run_bytes)
    return done.select("rest.*", *made[:-1], F.col("output").cast("string").alias("output"))


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of. The marks found first are the ones put in: a text
    that held one is plain, and none can begin inside another."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
    third = output.index(MIDDLE, second)
    first = output[len(PREFIX) : second]
    next_ = output[second + len(PREFIX) : third]
    middle = output[third + len(MIDDLE) :]
    return first + middle + next_ if form == "psm" else next_ + middle + first


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text again, from the rearranged text and its form."""

    @F.arrow_udf("binary")
    def restored_text(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        pairs = zip(outputs.to_pylist(), forms.to_pylist(), strict=True)
        return pa.array([restore(o, f) for o, f in pairs], pa.binary())

    return restored_text(F.col(output).cast("binary"), form).cast("string")


def middle_report(docs: DataFrame) -> DataFrame:
    """One row per document: form, cuts, and digests of the output and of the text rebuilt."""
    done = fill_in_middle(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha256_hex(F.col("output").cast("binary")).alias("output_sha256"),
        sha256_hex(restored().cast("binary")).alias("restored_sha256"),
    )


SQL = """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
        ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM g),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
          THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM c"""
