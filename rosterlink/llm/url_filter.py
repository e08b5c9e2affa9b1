"""Captures of URLs against a dated block list, as a temporal join.

A list entry puts a pattern on the list or takes it off at some time; the entry holds until
the next one for the same pattern. A capture is judged by the entries that hold when it was
fetched. A pattern is a host, which covers its subdomains, or a host and path segments, which
cover what lies below. So a capture has one key for each suffix of its host of two labels or
more, and one for each prefix of its path.

Entries and capture keys are put in one order by (key, time) and dealt out by range, so the
rows of a key that is very frequent spread over tasks by time. Each task walks its rows and
remembers the last entry; what it cannot know is only the state at its start, which is one
row per task and is filled in afterwards.

An entry counts from its own instant on; of entries of one pattern at one instant, the
greatest entry id wins. Host letters are compared in lower case, path letters as they are;
user, port, query and fragment do not count. A URL that is null or has no host matches
nothing, as does a null fetch time. Entries without pattern, time or id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.common import shuffle_partitions
from rosterlink.sources.tables import materialize

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def host(url: str | Column) -> Column:
    """Host in lower case, without user, port and last dot; empty if there is none."""
    name = F.lower(F.regexp_extract(url, URL, 1))
    return F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def segments(url: str | Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda s: s != "")


def capture_keys(url: str | Column) -> Column:
    """All patterns that would cover the URL."""
    name, path = host(url), segments(url)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (i == 1) | (F.size(labels) - i >= 1)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    paths = F.when(F.size(path) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))),
            lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")),
        )
    )
    return F.when(name != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


_KIND = "page_id long, url string, key string, at long, listed boolean, entry_at long, entry_id long, open boolean, task int, last boolean"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give captures the last entry of their key in this task; the last row says how it ends."""
    task = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _KIND.split(", ")]
    key: str | None = None
    entry: tuple | None = None
    first: str | None = None
    schema = pa.schema(
        zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()], strict=True)
    )
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch[c].to_pylist() for c in ("key", "at", "id", "listed", "page_id", "url")]
        for k, at, entry_id, listed, page, url in zip(*columns, strict=True):
            if k != key:
                first = k if key is None else first
                key, entry = k, None
            if listed is not None:
                entry = (listed, at, entry_id)
            elif entry is not None:
                rows.append((page, url, k, at, *entry, False, task, False))
            elif k == first:
                rows.append((page, url, k, at, None, None, None, True, task, False))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
        )
    if key is not None:
        end = (None, first, key, None, *(entry or (None, None, None)), False, task, True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(end, schema, strict=True)], schema=schema
        )


def entries_at_fetch(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, at, key, listed, entry_at, entry_id``: by capture and key, the entry that holds.

    ``captures``: ``page_id, url, at``; ``entries``: ``pattern, at, entry_id, listed``. Times
    are whole numbers on one scale.
    """
    asked = captures.filter("at is not null").select(
        F.explode(capture_keys("url")).alias("key"), "at", F.lit(1).alias("kind"),
        F.coalesce("page_id", F.lit(0)).alias("id"), F.lit(None).cast("boolean").alias("listed"), "page_id", "url",
    )
    stated = entries.filter("pattern is not null and at is not null and entry_id is not null").select(
        F.col("pattern").alias("key"), "at", F.lit(0).alias("kind"), F.col("entry_id").alias("id"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
    )
    order = ["key", "at", "kind", "id"]
    spark = captures.sparkSession
    walked = materialize(
        asked.unionByName(stated)
        .repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("key", "at", "id", "listed", "page_id", "url")
        .mapInArrow(_walk, _KIND),
        "walked",
    )
    # One row for each task: the state that the next one begins with.
    ends = sorted(walked.filter("last").select("task", "url", "key", "listed", "entry_at", "entry_id").collect())
    starts, held = [], (None, (None, None, None))
    for end in ends:
        first, own = end["url"], (end["listed"], end["entry_at"], end["entry_id"])
        starts.append((end["task"], *(held[1] if held[0] == first else (None, None, None))))
        if own[0] is None and end["key"] == first and held[0] == first:
            own = held[1]
        held = (end["key"], own)
    carried = spark.createDataFrame(starts, "task int, listed boolean, entry_at long, entry_id long")
    columns = ["page_id", "url", "at", "key", "listed", "entry_at", "entry_id"]
    known = walked.filter("not open and not last").select(columns)
    # ``carried`` has one row per task, which bounds its size.
    late = walked.filter("open").select("page_id", "url", "at", "key", "task").join(F.broadcast(carried), "task")
    return known.unionByName(late.select(columns)).filter("listed is not null")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, blocked, n_active, pattern, listed_at``: the longest pattern that holds counts.

    One row for each different capture of ``captures`` (``page_id, url, at``).
    """
    whole = captures.select("page_id", "url", "at").distinct()
    active = entries_at_fetch(whole.filter("url is not null"), entries).filter("listed")
    best = active.groupBy("page_id", "url", "at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.max(F.struct(F.length("key").alias("size"), F.col("key").alias("pattern"), F.col("entry_at").alias("listed_at"))).alias("b"),
    )
    same = (
        whole["page_id"].eqNullSafe(best["page_id"])
        & whole["url"].eqNullSafe(best["url"])
        & (whole["at"] == best["at"])
    )
    return whole.join(best, same, "left").select(
        whole["page_id"], F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "b.pattern", "b.listed_at",
    )


# The tables have no list and no fetch times; both are derived from them.
SECONDS, START, STRIDE = 2_592_000, 1_704_067_200, 7_919


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures, fetched at a moment that follows from their id, in microseconds."""
    second = START + F.pmod(F.col("page_id") * STRIDE, F.lit(SECONDS))
    return pages.select("page_id", "url", (second * 1_000_000).alias("at"))


def event_entries(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Events as list entries about the page whose id is the event's user.

    error and signup put its host on the list and take it off; click and view its host with
    the first path segment; purchase puts its host with the whole path on the list.
    """
    kind, path = F.col("event_type"), segments("url")
    first, whole = F.slice(path, 1, 1), F.array_join(path, "/")
    pattern = (
        F.when(kind.isin("error", "signup"), host("url"))
        .when(kind.isin("click", "view"), F.concat(host("url"), F.lit("/"), F.array_join(first, "/")))
        .when(kind == "purchase", F.concat(host("url"), F.lit("/"), whole))
    )
    about = pages.filter("url is not null").select(F.col("page_id").alias("user_id"), "url")
    return events.join(about, "user_id").select(
        pattern.alias("pattern"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").alias("entry_id"), kind.isin("error", "click", "purchase").alias("listed"),
    )


_HOST = rf"regexp_replace(regexp_replace(lower(regexp_extract(url, '{URL}', 1)), '^.*@', ''), '\.?(:[0-9]*)?$', '')"
_PATH = rf"list_filter(string_split(regexp_extract(url, '{URL}', 2), '/'), lambda s: s <> '')"
SQL = f"""
WITH p AS (SELECT page_id, url, ({START} + (page_id * {STRIDE}) % {SECONDS}) * 1000000 AS fetched,
  {_HOST} AS host, {_PATH} AS path FROM pages),
e AS (SELECT CASE WHEN event_type IN ('error', 'signup') THEN host
    WHEN event_type IN ('click', 'view') THEN host || '/' || array_to_string(path[1:1], '/')
    WHEN event_type = 'purchase' THEN host || '/' || array_to_string(path, '/') END AS pattern,
  epoch_us(ts) AS stated, event_id, event_type IN ('error', 'click', 'purchase') AS listed
  FROM events JOIN p ON p.page_id = user_id),
h AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (SELECT page_id, url, fetched, unnest(list_concat(
    list_transform(list_filter(range(1, len(labels) + 1), lambda i: i = 1 OR len(labels) - i >= 1),
      lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')))) AS key FROM h),
s AS (SELECT k.page_id, k.url, k.key, arg_max(listed, (e.stated, event_id)) AS listed, max(e.stated) AS listed_at
  FROM k JOIN e ON e.pattern = k.key AND e.stated <= k.fetched GROUP BY ALL),
b AS (SELECT page_id, url, count(*) AS n_active, arg_max(key, (length(key), key)) AS pattern,
  arg_max(listed_at, (length(key), key)) AS listed_at FROM s WHERE listed GROUP BY ALL)
SELECT p.page_id, b.page_id IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, pattern, listed_at
FROM p LEFT JOIN b ON b.page_id = p.page_id AND b.url = p.url"""
