"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets the signs of its projections on ``BITS`` random directions, one
after the other, as one number; vectors are ordered by it and compared with the neighbours in
a bounded window by their exact cosine. Passes use other directions, and verified pairs of all
passes are united. The first passes look at all vectors, as many as spread vectors need. Each
pass also works out, from a vector's distance to the cuts and from how many bits its window
stands for, with what chance the vector met a partner at the threshold. Vectors for which the
passes so far do not add up to ``RECALL`` lie in a crowd; they go through further passes among
themselves, whose cuts come from the crowd, until so few are left that all their pairs are compared.

Equal vectors are one vector with a count. A window gives only what hangs together in it
(a forest), so a large group makes no more rows than it has members. All pairs inside of
a component are then compared in blocks of bounded size, spread over tasks, which gives the exact
number of links there, however many neighbours a window had no room for.

Vectors that are null, empty, zero, or with null or non-finite components link with nothing and
are components of their own; vectors of different lengths never link. Rows that repeat a
``vec_id`` are vectors of their own: each has its row, links and component. Null ids are left
out. Components are single or double precision, as they come; cosines are in double precision, of
vectors scaled so that none overflows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rosterlink.llm.common import shuffle_partitions, spread
from rosterlink.llm.components import components
from rosterlink.sources.tables import materialize, materialize_observed

COSINE, RECALL = 0.95, 0.99
#: Bits of a projection key; neighbours on each side that a vector is compared with at least.
BITS, WINDOW = 63, 512
#: Further passes between two looks at who is left; the window doubles each time up to a limit.
ROUND, WIDEST = 4, 2048
#: Vectors from which the cuts of a further pass are taken.
CUT_SAMPLE = 1000
#: Vectors left of which all pairs are compared.
FEW = 16_384
#: Vectors of a block in which all pairs are compared; vectors of a sorted partition.
BLOCK, PARTITION = 1024, 50_000


def passes_for(vectors: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold was met in a window with chance ``recall``.

    Two vectors agree in one sign with chance 1 - angle / pi, and are at most a window apart
    where their keys agree until fewer vectors than the window are left.
    """
    shared = max(0.0, math.log2(max(1, vectors) / window) + 1)
    met = (1 - math.acos(cosine) / math.pi) ** shared
    return 3 if met >= 1 - 1e-9 else max(3, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def directions(width: int, number: int) -> np.ndarray:
    """The first ``width`` coordinates of a pass's directions, the same at every width."""
    return np.random.default_rng(7_000 + number).standard_normal((width, BITS)).T


def sign_keys(x: np.ndarray, number: int, cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors, and their projections; a cut is 0 where none is given."""
    along = x @ directions(x.shape[1], number).T
    signs = along >= (0.0 if cuts is None else cuts)
    return signs.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)), along


def crowd_cuts(vectors: DataFrame, number: int) -> np.ndarray:
    """Cuts of a pass: quantiles of the projections of a sample, so that the crowd is cut."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(number)), "vec_id").limit(CUT_SAMPLE).select("embedding")
    x = unit(rows.toArrow()["embedding"].combine_chunks())
    along = x @ directions(x.shape[1], number).T
    share = np.random.default_rng(9_000 + number).uniform(0.2, 0.8, BITS)
    return np.array([np.quantile(along[:, b], share[b]) for b in range(BITS)])


_GRID = np.linspace(-6, 6, 4_001)
_LOG_NORMAL = np.log([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID])


def log_together(along: np.ndarray, cuts: np.ndarray | None, cosine: float) -> np.ndarray:
    """By vector and number of bits, the log of the chance that a partner at the threshold has
    the same first bits. Given one projection, that of the partner is normal around ``cosine``
    times it.
    """
    cut = 0.0 if cuts is None else cuts
    side = np.where(along >= cut, 1.0, -1.0)
    margin = side * (cosine * along - cut) / math.sqrt(max(1e-12, 1 - cosine**2))
    return np.cumsum(np.interp(margin, _GRID, _LOG_NORMAL), axis=1).astype(np.float32)


def log_missed(keys: np.ndarray, together: np.ndarray, window: int, first: bool) -> np.ndarray:
    """The log of the chance that a vector's window missed a partner at the threshold.

    ``keys`` are in order; nothing comes before them if they are ``first``. A window holds all
    vectors with as many first bits as are shared by no vector outside of it; at an open end,
    by none at that end. Vectors that share all bits are in random order.
    """
    n, at = len(keys), np.arange(len(keys))
    bits = np.zeros(n, np.int64)
    for far, beyond, closed in ((at - window, at < window, first), (at + window, at + window >= n, False)):
        differ = keys ^ keys[np.clip(far, 0, n - 1)]
        shared = BITS - np.frexp(differ.astype(np.float64))[1]
        # Near 2 ** k, a rounded number may count one bit more, which shares one bit less.
        shared = np.where((shared < BITS) & (differ >> np.maximum(BITS - 1 - shared, 0) == 0), shared + 1, shared)
        bits = np.maximum(bits, np.where(beyond & closed, 0, shared + 1))
    alike = np.searchsorted(keys, keys, "right") - np.searchsorted(keys, keys)
    chance = np.exp(np.where(bits > 0, together[at, np.clip(bits, 1, BITS) - 1], 0.0))
    chance = chance * np.where(bits > BITS, np.minimum(1.0, window / alike), 1.0)
    return np.log(np.maximum(1 - chance, 1e-12))


def unit(rows: pa.Array) -> np.ndarray:
    """Vectors in double precision, each of length 1; shorter ones are filled up with zeros."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = widths(rows)
    x = np.zeros((len(rows), int(lengths.max(initial=0))))
    x[np.arange(x.shape[1]) < lengths[:, None]] = flat
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def widths(rows: pa.Array) -> np.ndarray:
    return pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)


def finite() -> Column:
    """Whether a vector can have an angle: not null, finite, not zero."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall("embedding", lambda c: c == 0)
    fit = (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))
    return F.coalesce(F.col("embedding").isNotNull() & fit, F.lit(False))


class Forest:
    """Which rows hang together, as links that lead to a least row."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def window_links(rows: pa.Array, window: int, cosine: float) -> list[tuple[int, int]]:
    """A forest of the pairs at the threshold among rows at most ``window`` apart."""
    x, n = unit(rows), widths(rows)
    forest, out = Forest(len(x)), []
    for start in range(0, len(x), window):
        near = slice(start, start + window), slice(start, start + 2 * window)
        linked = np.triu(x[near[0]] @ x[near[1]].T, 1) >= cosine
        if n.min() != n.max():
            linked &= n[near[0], None] == n[near[1]]
        hits = np.argwhere(linked) + start
        out.extend((i, j) for i, j in hits.tolist() if forest.unite(i, j))
    return out


def sorted_pass(
    vectors: DataFrame, number: int, partitions: int, window: int, cosine: float, cuts: np.ndarray | None = None
) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of one pass, and ``vec_id, missed`` by ``log_missed``. Where two sorted
    partitions meet, the ends of both are compared in a step of their own, so that a window
    does not end with its partition.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, _ = sign_keys(unit(batch["embedding"]), number, cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch["vec_id"], batch["embedding"]], ["key", "vec_id", "embedding"]
            )

    kind = vectors.schema["embedding"].dataType
    values = pa.list_(pa.float32() if isinstance(kind.elementType, FloatType) else pa.float64())
    rows_of = f"vec_id long, embedding {kind.simpleString()}"
    edge_of = f"a long, b long, border int, {rows_of}, missed double"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        kept: pa.Table | None = None
        first = True
        keys, together, seen = [], [], []

        def rows(links: list, border: int, ends: pa.Table | None) -> pa.RecordBatch:
            n, m = len(links), 0 if ends is None else ends.num_rows
            ids = pa.array([None] * n, pa.int64())
            vecs = pa.array([None] * n, values)
            if ends is not None:
                ids, vecs = ends["vec_id"].combine_chunks(), ends["embedding"].combine_chunks()
            a, b = ([x[i] for x in links] + [None] * m for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([border] * (n + m), pa.int32()), ids, vecs,
                    pa.nulls(n + m, pa.float64()),
                ],
                ["a", "b", "border", "vec_id", "embedding", "missed"],
            )

        for batch in batches:
            now = pa.table({"vec_id": batch["vec_id"], "embedding": batch["embedding"]})
            if now.num_rows == 0:
                continue
            if first:
                yield rows([], place - 1, now.slice(0, window))
                first = False
            key, along = sign_keys(unit(batch["embedding"]), number, cuts)
            keys.append(key)
            together.append(log_together(along, cuts, cosine))
            seen.append(batch["vec_id"].to_numpy())
            # The last rows of the batch before are the window of the first rows of this one.
            both = now if kept is None else pa.concat_tables([kept, now])
            ids = both["vec_id"].to_numpy()
            near = window_links(both["embedding"].combine_chunks(), window, cosine)
            links = [(int(ids[i]), int(ids[j])) for i, j in near]
            if links:
                yield rows(links, -1, None)
            kept = both.slice(max(0, both.num_rows - window))
        if kept is not None:
            yield rows([], place, kept)
            missed = log_missed(np.concatenate(keys), np.concatenate(together), window, place == 0)
            none = pa.nulls(len(missed), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    none, none, pa.nulls(len(missed), pa.int32()), pa.array(np.concatenate(seen)),
                    pa.nulls(len(missed), values), pa.array(missed),
                ],
                ["a", "b", "border", "vec_id", "embedding", "missed"],
            )

    def meet(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("key", "ascending"), ("tie", "ascending")])
        ids = rows["vec_id"].to_numpy()
        near = window_links(rows["embedding"].combine_chunks(), window, cosine)
        return pa.table({c: pa.array([int(ids[p[i]]) for p in near], pa.int64()) for i, c in enumerate("ab")})

    tie = F.xxhash64("vec_id", F.lit(number))
    ordered = (
        vectors.select("vec_id", "embedding")
        .mapInArrow(keyed, f"key long, {rows_of}")
        .withColumn("tie", tie)
        .repartitionByRange(partitions, "key", "tie")
        .sortWithinPartitions("key", "tie")
        .drop("key", "tie")
    )
    found = materialize(ordered.mapInArrow(windows, edge_of), f"pass-{number}")
    ends = found.filter("border is not null and vec_id is not null").select("border", "vec_id", "embedding")
    rekeyed = ends.mapInArrow(
        lambda batches: _with_border(batches, number, cuts), f"border int, key long, {rows_of}"
    ).withColumn("tie", tie)
    met = rekeyed.groupBy("border").applyInArrow(meet, "a long, b long")
    links = found.filter("vec_id is null").select("a", "b").unionByName(met)
    return links, found.filter("missed is not null").select("vec_id", "missed")


def _with_border(batches: Iterator[pa.RecordBatch], number: int, cuts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, _ = sign_keys(unit(batch["embedding"]), number, cuts)
        yield pa.RecordBatch.from_arrays(
            [batch["border"], pa.array(key), batch["vec_id"], batch["embedding"]],
            ["border", "key", "vec_id", "embedding"],
        )


def links_inside(members: DataFrame, cosine: float) -> DataFrame:
    """``vec_id, n``: the vectors a vector is linked with in its component, counted with copies.

    ``members`` has ``component, vec_id, copies, embedding``. A component is cut into blocks
    by a hash, and each pair of blocks is one group, so no group outgrows two blocks.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = members.join(sizes, "component").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = cut.select("component", "vec_id", "copies", "embedding", "block", other).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "vec_id", "copies", "embedding",
    )

    def count(key: tuple, group: pa.Table) -> pa.Table:
        rows = group["embedding"].combine_chunks()
        x, size = unit(rows), widths(rows)
        linked = x @ x.T >= cosine
        linked &= size[:, None] == size
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:  # pairs inside one block are counted where it meets itself
            side = group["block"].to_numpy()
            linked &= side[:, None] != side[None, :]
        n = linked.astype(np.float64) @ group["copies"].to_numpy().astype(np.float64)
        return pa.table({"vec_id": group["vec_id"], "n": pa.array(n.astype(np.int64))})

    parts = cells.groupBy("component", "low", "high").applyInArrow(count, "vec_id long, n long")
    return parts.groupBy("vec_id").agg(F.sum("n").alias("n"))


def found_links(distinct: DataFrame, number: int, window: int, cosine: float) -> list[DataFrame]:
    """Links ``a, b`` of all passes over ``number`` different vectors, further passes included."""
    out: list[DataFrame] = []
    left, count, width = distinct.withColumn("missed", F.lit(0.0)), number, window
    first = passes = passes_for(number, window, cosine)
    least = min(4, shuffle_partitions(distinct.sparkSession))
    while count > FEW or not out:
        partitions = spread(count, PARTITION, 1 if count < 2 * width else least)
        misses = [left.select("vec_id", "missed")]
        for _ in range(passes):
            cuts = crowd_cuts(left, len(out)) if len(out) >= first else None
            links, missed = sorted_pass(left, len(out), partitions, width, cosine, cuts)
            out.append(materialize(links, f"links-{len(out)}"))
            misses.append(missed)
        total = reduce(DataFrame.unionByName, misses).groupBy("vec_id").agg(F.sum("missed").alias("missed"))
        total = total.filter(F.col("missed") > math.log(1 - RECALL))
        left, seen = materialize_observed(
            left.drop("missed").join(total, "vec_id"), "crowded", n=F.count(F.lit(1))
        )
        count = seen["n"]
        width, passes = min(2 * width, max(WIDEST, window)), ROUND
    if count:
        out.append(materialize(all_links(left, count, cosine), "links-crowded"))
    return out


def all_links(vectors: DataFrame, count: int, cosine: float) -> DataFrame:
    """Links ``a, b`` among ``count`` vectors by comparing all pairs, each two blocks in one group."""
    blocks = -(-count // BLOCK)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    cells = vectors.select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), other
    ).select("vec_id", "embedding", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        links = window_links(rows["embedding"].combine_chunks(), len(ids), cosine)
        return pa.table({c: pa.array([int(ids[p[i]]) for p in links], pa.int64()) for i, c in enumerate("ab")})

    return cells.groupBy("low", "high").applyInArrow(compare, "a long, b long")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.filter("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    # Different vectors get numbers of their own, since ids may repeat; ids come back last.
    distinct = materialize(
        rows.filter(finite())
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("vec_id", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    number = distinct.count()
    passes = found_links(distinct, number, window, cosine)
    grouped = materialize(
        components(reduce(DataFrame.unionByName, passes)).withColumnRenamed("node", "vec_id"), "grouped-vectors"
    )
    inside = links_inside(distinct.join(grouped, "vec_id"), cosine)
    named = distinct.select("vec_id", "first").join(grouped, "vec_id")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    per_vector = (
        distinct.join(grouped, "vec_id", "left").join(inside, "vec_id", "left").join(least, "component", "left")
        .select(
            "embedding", F.coalesce("least", "first").alias("component_id"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    linked = rows.filter(finite()).join(per_vector, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.filter(~finite()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(bad).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION
      SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
