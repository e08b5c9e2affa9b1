"""Repeated runs of lines, and documents without their later copies. DataFrame functions only.

A document is a sequence of line ids, and every position a suffix of its sequence. Prefix
doubling ranks the suffixes by their first 1, 2, 4, ... lines: a suffix's name at a level is
the first position in the corpus that begins with the same lines, and the name at the next
level follows from a pair of names. Suffixes whose prefix is alone drop out, so the rounds
shrink and end by themselves. Suffixes of one name form an interval of the suffix array whose
common prefix has at least that many lines; the deepest level at which a suffix has an
earlier copy tells how far its run of lines is a copy.

A line goes when an earlier copy exists of the line itself, if it has ``min_words`` words or
more, or of any run of ``min_lines`` lines that holds it. Order is by document id (null
first), then by text, then by line. Rows that agree in id and text are one document and
fare alike. Null text has no lines and stays null; empty text is one empty line. Lines are
parted by "\\n" only; words are parted by white space. Other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlink.sources.tables import materialize, materialize_observed

#: Words that make a single line worth deleting; lines that make a run of any lines so.
MIN_WORDS, MIN_LINES = 5, 4


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[ \t\n\f\r]+"), lambda w: w != ""))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each different text once: its digest, the first document that has it, and by line a
    digest and the number of words. Lines are hashed before rows are moved.
    """
    lines = _lines("text")
    hashed = docs.filter(F.col("text").isNotNull()).select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc"),
        F.unhex(F.md5("text")).alias("digest"),
        F.transform(lines, lambda t: F.unhex(F.md5(t))).alias("ids"),
        F.transform(lines, lambda t: F.least(_words(t), F.lit(32_767)).cast("short")).alias("words"),
    )
    return hashed.groupBy("digest").agg(
        F.min("doc")["doc_id"].alias("doc_id"), F.first("ids").alias("ids"),
        F.first("words").alias("words"),
    )


def line_positions(texts: DataFrame) -> DataFrame:
    """``doc_id, digest, line``, a line id and the number of words; ``texts`` are distinct."""
    lines = texts.select(
        "doc_id", "digest", F.posexplode(F.arrays_zip("ids", "words")).alias("line", "x")
    )
    return lines.select("doc_id", "digest", "line", F.col("x.ids").alias("line_id"), F.col("x.words").alias("words"))


def _named(level: DataFrame, key: list[str]) -> DataFrame:
    """Suffixes whose key others share, with the first of their positions as their name.

    The shared keys are written before the join, so that both sides of it are dealt out for
    the join alone and a key with very many rows can be split.
    """
    at = F.struct("doc_id", "digest", "line")
    groups = level.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("name"))
    shared = materialize(groups.filter("n > 1"), "shared-lines")
    return level.join(shared, key).drop(*key, "n")


def copied_suffixes(texts: DataFrame) -> list[DataFrame]:
    """By level k, the suffixes whose first 2^k lines occur more than once, each with a name.

    Columns ``doc_id, digest, line, words, name``. Each level is written out, which ends the
    lineage of the rounds in something that outlives an executor.
    """
    named, seen = materialize_observed(
        _named(line_positions(texts), ["line_id"]), "lines-0", any=F.max(F.lit(1))
    )
    levels: list[DataFrame] = []
    while seen["any"] is not None:
        levels.append(named)
        step = 2 ** (len(levels) - 1)
        text = Window.partitionBy("doc_id", "digest").orderBy("line").rangeBetween(step, step)
        pairs = named.withColumn("next", F.max("name").over(text)).filter("next is not null")
        pairs = pairs.withColumn("pair", F.struct("name", "next")).drop("name", "next")
        named, seen = materialize_observed(
            _named(pairs, ["pair"]), f"lines-{len(levels)}", any=F.max(F.lit(1))
        )
    return levels


def repeated_runs(levels: list[DataFrame]) -> DataFrame:
    """Maximal runs of lines that copy earlier ones, line by line.

    ``doc_id, digest, start, length, source`` where ``source`` is the place of the earlier
    copy. Suffixes that follow each other and copy places that follow each other are one run.
    """
    at = F.struct("doc_id", "digest", "line")
    deep = [
        level.filter(F.col("name") != at).select(
            "doc_id", "digest", "line", F.lit(2**k).alias("length"), F.col("name").alias("source")
        )
        for k, level in enumerate(levels)
    ]
    every = reduce(DataFrame.unionByName, deep)
    best = every.groupBy("doc_id", "digest", "line").agg(
        F.max(F.struct("length", "source")).alias("best")
    ).select("doc_id", "digest", "line", "best.*")
    diagonal = (
        F.col("source.doc_id"), F.col("source.digest"),
        F.col("line") - F.col("source.line"),
    )
    text = Window.partitionBy("doc_id", "digest").orderBy("line")
    before = F.lag(F.struct(*diagonal, F.col("line") + 1)).over(text)
    starts = best.withColumn(
        "run",
        F.when(before.eqNullSafe(F.struct(*diagonal, F.col("line"))), 0).otherwise(1),
    ).withColumn("run", F.sum("run").over(text))
    runs = starts.groupBy("doc_id", "digest", "run").agg(
        F.min("line").alias("start"),
        (F.max(F.col("line") + F.col("length")) - F.min("line")).alias("length"),
        F.min_by("source", "line").alias("source"),
    )
    return runs.drop("run")


def deleted_lines(levels: list[DataFrame], min_words: int, min_lines: int) -> DataFrame:
    """``digest, gone``: the numbers of the lines of a text that go, in ascending order.

    These are the lines of the maximal runs of ``min_lines`` or more, and single copied lines of
    ``min_words`` or more.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    runs = repeated_runs(levels).filter(F.col("length") >= min_lines)
    at = F.struct("doc_id", "digest", "line")
    single = levels[0].filter((F.col("name") != at) & (F.col("words") >= min_words))
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    gone = runs.select("digest", covered.alias("line")).unionByName(single.select("digest", "line"))
    lines = F.collect_set(F.col("line").cast("int"))
    return gone.groupBy("digest").agg(F.sort_array(lines).alias("gone"))


def _gone(lines: str) -> Column:
    """From ascending line numbers, an array that says for each line whether it goes."""
    numbers = F.col(lines)

    def stretch(number: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(numbers, i - 1)).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(False), number - before - 1), F.array(F.lit(True)))

    return F.flatten(F.transform(numbers, stretch))


def _shortened(docs: DataFrame, min_words: int, min_lines: int) -> DataFrame:
    """``rest, text, lines, lines_deleted`` with the text that is left; ``rest`` holds all other
    columns of the input, so that their names meet none of those used here."""
    texts = materialize(distinct_texts(docs.select("doc_id", "text")), "texts")
    levels = copied_suffixes(texts)
    known = texts.select("digest", F.struct("doc_id").alias("first"))
    if levels:
        known = known.join(deleted_lines(levels, min_words, min_lines), "digest", "left")
    else:
        known = known.withColumn("gone", F.lit(None).cast("array<int>"))
    known = known.withColumnRenamed("gone", "numbers")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    whole = docs.select(rest.alias("rest"), "text", F.unhex(F.md5("text")).alias("digest"))
    joined = whole.join(known, "digest", "left")
    lines = _lines("text")
    later = F.struct(F.col("rest.doc_id").cast("long").alias("doc_id")) != F.col("first")
    copied = F.transform(lines, lambda t: _words(t) >= min_words)
    all_gone = F.transform(lines, lambda t: F.lit(True))
    gone = (
        F.when(later & (F.size(lines) >= min_lines), all_gone)
        .when(later, copied)
        .when(F.col("numbers").isNotNull(), _gone("numbers"))
        .otherwise(F.array().cast("array<boolean>"))
    )
    left = F.filter(
        F.zip_with("split", "gone", lambda t, g: F.when(~F.coalesce(g, F.lit(False)), t)),
        lambda t: t.isNotNull(),
    )
    counted = F.when(F.col("text").isNotNull(), F.size("split")).otherwise(0)
    shortened = (
        joined.withColumn("split", lines)
        .withColumn("gone", gone)
        .withColumn("left", F.when(F.col("text").isNotNull(), left))
    )
    return shortened.select(
        "rest",
        F.when(F.size("left") == F.size("split"), F.col("text"))
        .otherwise(F.array_join("left", "\n"))
        .alias("text"),
        counted.cast("long").alias("lines"),
        (counted - F.when(F.col("text").isNotNull(), F.size("left")).otherwise(0))
        .cast("long")
        .alias("lines_deleted"),
    )


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES
) -> DataFrame:
    """``docs`` with the lines left in ``text``, and ``lines`` and ``lines_deleted``.

    Columns of these two names are replaced if the input has them.
    """
    made = ["text", "lines", "lines_deleted"]
    kept = [F.col("rest").getField(c).alias(c) for c in docs.columns if c not in made]
    return _shortened(docs, min_words, min_lines).select(*kept, *made)


def drop_copied_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left; documents that lose every line go.

    A column ``n_chars`` is set to the length of the new text; all others stay as they are.
    """
    left = _shortened(docs, MIN_WORDS, MIN_LINES)
    kept = left.filter("lines_deleted = 0 or lines_deleted < lines")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("rest").getField(c).alias(c))
    return kept.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: lines, lines deleted, and a digest of the text that is left."""
    left = dedup_lines(docs.select("doc_id", "text"))
    return left.select(
        "doc_id", F.col("lines").alias("n_lines"), F.col("lines_deleted").alias("n_deleted"),
        F.md5("text").alias("left_md5"),
    )


def sql(min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> str:
    """The same report in DuckDB's SQL, by counting every run of ``min_lines`` lines."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS t, unnest(range(len(ls))) AS line, len(ls) AS n FROM d
      WHERE text IS NOT NULL),
w AS (SELECT *, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS words,
        CASE WHEN line + {min_lines} <= n THEN string_agg(t, chr(10)) OVER (PARTITION BY doc_id ORDER BY line
          ROWS BETWEEN CURRENT ROW AND {min_lines - 1} FOLLOWING) END AS run FROM l),
m AS (SELECT *, min((doc_id, line)) OVER (PARTITION BY md5(t), t) < (doc_id, line) AS copy1,
        run IS NOT NULL AND min((doc_id, line)) OVER (PARTITION BY md5(run), run) < (doc_id, line) AS copy_run
      FROM w),
g AS (SELECT *, (copy1 AND words >= {min_words}) OR bool_or(copy_run) OVER (PARTITION BY doc_id ORDER BY line
        ROWS BETWEEN {min_lines - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
        md5(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS left_md5
      FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, left_md5
FROM d LEFT JOIN r USING (doc_id)"""
