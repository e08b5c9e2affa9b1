"""Line dedup, Order MinHash, embeddings and components against brute force."""

import hashlib
import math
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import embedding_dedup, line_dedup, order_minhash
from rosterlink.llm.components import components
from rosterlink.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import PROSE


def least_members(nodes, links):
    """By node, the least node that links lead to."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return least


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)] + [(99, i) for i in range(45, 60)],
    [(5, 5), (1, 2), (2, 1), (2, 3), (8, 7)],
    [],
])
def test_components(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in got} == least_members(nodes, [x for x in links if x[0] != x[1]])


# Lines


def plain_line_dedup(rows, min_words, min_lines):
    """Texts left by document, walking the corpus from the first line to the last."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        gone = [False] * len(lines)
        runs = [tuple(lines[i : i + min_lines]) for i in range(len(lines) - min_lines + 1)]
        for i, line in enumerate(lines):
            if len(line.split()) >= min_words and ((line,) in seen or line in lines[:i]):
                gone[i] = True
        for i, run in enumerate(runs):
            if ("run", run) in seen or run in runs[:i]:
                gone[i : i + min_lines] = [True] * min_lines
        seen.update([(line,) for line in lines] + [("run", r) for r in runs])
        out[doc] = "\n".join(line for line, g in zip(lines, gone, strict=True) if not g)
    return out


def corpus(seed, size=40):
    rng = random.Random(seed)
    pool = [f"line {i} has words enough here" if i % 3 else f"l{i}" for i in range(25)]
    docs = []
    for i in range(size):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 12))]
        if docs and rng.random() < 0.5:
            other = rng.choice(docs).split("\n")
            at = rng.randrange(len(other))
            lines[rng.randint(0, len(lines)):0] = other[at : at + rng.randint(1, 9)]
        docs.append(rng.choice(docs) if docs and rng.random() < 0.15 else "\n".join(lines))
    return docs


@pytest.mark.parametrize(("seed", "min_words", "min_lines"), [(1, 5, 4), (2, 5, 2), (3, 99, 8), (4, 1, 1)])
def test_lines_against_a_plain_walk(documents, seed, min_words, min_lines):
    rows = list(enumerate(corpus(seed)))
    got = line_dedup.dedup_lines(documents(rows), min_words, min_lines).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_line_dedup(rows, min_words, min_lines)
    assert all(0 <= r["lines_deleted"] <= r["lines"] for r in got)


def test_repeated_runs_are_real_and_maximal(documents):
    rows = list(enumerate(corpus(7)))
    texts = line_dedup.distinct_texts(documents(rows))
    runs = line_dedup.repeated_runs(line_dedup.copied_suffixes(texts)).collect()
    lines = {i: t.split("\n") for i, t in rows}
    assert runs
    for r in runs:
        a, b = lines[r["doc_id"]], lines[r["source"]["doc_id"]]
        i, j, n = r["start"], r["source"]["line"], r["length"]
        assert a[i : i + n] == b[j : j + n] and len(a[i : i + n]) == n
        assert (r["source"]["doc_id"], j) < (r["doc_id"], i)


def test_lines_have_no_python_in_the_plan(documents):
    docs = documents(["a b c d e\nx", "a b c d e\ny"])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_odd_texts(documents, odd_texts):
    docs = documents(odd_texts).withColumnRenamed("source", "lines")
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(odd_texts)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["text"] is None and by_id[0]["lines"] == 0
    assert by_id[1]["text"] == "" and by_id[5]["text"] == by_id[6]["text"] == "a b"
    assert [r["text"] for r in got if r["doc_id"] == 7] == [PROSE[0]] * 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    left = line_dedup.drop_copied_lines(documents([PROSE[0], PROSE[0], PROSE[1]]))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]


# Texts


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_distance(a, b, most):
    assert order_minhash.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_kmers_count_occurrences():
    once = order_minhash.kmers(np.arange(10, dtype=np.uint64))
    again = order_minhash.kmers(np.array([*range(10), 3, 4, 5, 6, 7], np.uint64))
    assert set(once.tolist()) <= set(again.tolist())
    assert len(set(again.tolist())) == len(again)


def test_near_copies_are_classes(documents):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, truth = [], []
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
            truth.append(group)
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.duplicate_classes(docs).collect()}
    similar = [
        (i, j) for i, j in combinations(range(len(rows)), 2) if order_minhash.similar(rows[i], rows[j])
    ]
    assert got == least_members(range(len(rows)), similar)
    kept = order_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_a_shared_passage_does_not_join_texts(documents):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [f"{passage} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    got = order_minhash.duplicate_classes(documents(rows)).collect()
    assert all(r["doc_id"] == r["class_id"] for r in got)


def edited_words(base, edits, rng):
    """Words after so many scattered changes of one word, among them words lost and new."""
    out = list(base)
    for at in sorted(rng.sample(range(len(base)), edits), reverse=True):
        new, how = f"new{rng.randrange(10**9)}", rng.random()
        out[at : at + 1] = [] if how < 0.15 else [new, base[at]] if how < 0.3 else [new]
    return out


@pytest.mark.parametrize("low, high, least", [(5, 32, 1.0), (33, 300, 0.97)])
@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_scattered_edits_are_found(documents, low, high, least, similarity):
    rng = random.Random(13)
    rows = []
    while len(rows) < 240:
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randint(low, high))]
        edits = int((1 - similarity) * len(base) + 1e-9)
        pair = [" ".join(w) for w in (base, edited_words(base, edits, rng))]
        if edits and order_minhash.similar(*pair):
            rows += pair
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.duplicate_classes(documents(rows)).collect()}
    found = [got[i] == got[i + 1] for i in range(0, len(rows), 2)]
    assert sum(found) >= least * len(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=4, max_size=30), st.randoms(use_true_random=False))
def test_no_short_pair_is_without_a_common_piece(base, rng):
    a = [f"w{b}" for b in base]
    b = edited_words(a, rng.randint(0, len(a) // 4), rng)
    hashed = order_minhash.WordHashes()
    if a != b and order_minhash.similar_words(a, b):
        assert np.intersect1d(*(order_minhash.pieces(hashed.of(w), {}) for w in (a, b))).size


def test_near_copies_odd_texts(documents, odd_texts):
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.duplicate_classes(documents(odd_texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert order_minhash.duplicate_classes(documents([])).count() == 0


# Vectors


def plain_links(vectors):
    e = np.stack([np.asarray(v, np.float64) for v in vectors])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return np.argwhere(np.triu(e @ e.T >= embedding_dedup.COSINE, 1)).tolist()


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 32))
    vectors = [c + 0.12 * rng.standard_normal(32) for c in centres for _ in range(rng.integers(1, 5))]
    vectors += [centres[0] + 0.14 * rng.standard_normal(32) for _ in range(150)] + [centres[1]] * 40
    vectors = [np.asarray(v, np.float32) for v in vectors]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.linked_vectors(df, window=64).collect()}
    links = plain_links(vectors)
    wanted = least_members(range(len(vectors)), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(vectors))
    assert len(links) > 5000
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * degree.sum()
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert np.mean([got[i]["component_id"] == wanted[i] for i in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    vectors = [np.asarray(base + 0.1 * rng.standard_normal(16), np.float32) for _ in range(90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.linked_vectors(df).collect()}
    degree = np.bincount(np.array(plain_links(vectors)).ravel(), minlength=90)
    assert [got[i] for i in range(90)] == degree.tolist()


def test_passes_grow_with_the_number():
    numbers = [embedding_dedup.passes_for(n) for n in (10**3, 10**5, 10**7, 10**9)]
    assert numbers == sorted(numbers) and numbers[0] < numbers[-1] < 100


@pytest.mark.parametrize("few", [300, 16_384])
def test_pairs_in_a_crowd_are_met(spark, monkeypatch, few):
    """A third of the vectors lie in a cone without linking; pairs are planted in it."""
    monkeypatch.setattr(embedding_dedup, "FEW", few, raising=False)
    rng = np.random.default_rng(5)
    n, width, window = 9_000, 64, 16

    def units(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = units(rng.standard_normal((n, width)))
    middle = units(rng.standard_normal((1, width)))
    x[: n // 3] = units(middle + 0.5 * x[: n // 3])
    x[: n // 3] = x[rng.permutation(n // 3)]
    pairs = [(i, n + i) for i in range(300)]
    aside = rng.standard_normal((300, width))
    aside = units(aside - (aside * x[:300]).sum(1, keepdims=True) * x[:300])
    x = np.vstack([x, 0.955 * x[:300] + math.sqrt(1 - 0.955**2) * aside])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.linked_vectors(rows, window=window).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_vectors_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1),
        (6, [1.0, 0.0], 1), (7, [1.0, 0.0], 2), (8, [2.0, 0.1], 3), (9, [0.0, 1.0], 3), (9, [0.0, 1.0], 3),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.linked_vectors(df).collect()]
    assert sorted(got) == [
        *[(i, 0, i, True) for i in range(6)], (6, 2, 6, True), (7, 2, 6, False), (8, 2, 6, False),
        (9, 1, 9, True), (9, 1, 9, True),
    ]
    assert embedding_dedup.linked_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_line_dedup", "op2_embedding_dedup", "op9_url_filter"])
def test_queries_against_sql(spark, name):
    from rosterlink.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    wanted = con.sql(ORACLE[name]).to_arrow_table().to_pylist()
    got = QUERIES[name](spark, SMALL).toArrow().to_pylist()
    rows = [sorted(str(sorted(r.items())) for r in x) for x in (got, wanted)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("block_words", [60, 10**6])
def test_texts_that_stay_apart_from_the_first_are_compared(spark, documents, monkeypatch, block_words):
    from pyspark.sql import functions as F

    monkeypatch.setattr(order_minhash, "BLOCK_WORDS", block_words)
    rng = random.Random(12)
    rows = ["nothing like the others " * 8]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(32)]
        rows += [" ".join(base), " ".join([*base[:10], "other", *base[11:]])]
    docs = documents(rows)
    buckets = docs.select(
        F.lit(0).alias("s"), F.lit(7).cast("long").alias("key"), "doc_id", F.lit(32).cast("long").alias("n"),
        F.array_repeat(F.lit(7).cast("long"), 24).alias("keys"),
        F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(32).cast("long").alias("n")).alias("top"),
    )
    grouped = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    got = order_minhash.links_apart(buckets, grouped, docs.select("doc_id", "text")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(i, i + 1) for i in range(3, 25, 2)]


def test_rows_with_one_id_are_one_document_with_one_text(spark, documents):
    """The text that is sketched is the one that is aligned, whichever that is."""
    words = [f"w{i}" for i in range(60)]
    one, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    for text in (one, other):
        near = text.replace("5", "five", 1)
        rows = [(1, one), (1, other), (2, near)]
        got = {r["doc_id"]: r["class_id"] for r in order_minhash.duplicate_classes(documents(rows)).collect()}
        chosen = min(one, other, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        assert got == {1: 1, 2: 1 if text == chosen else 2}


VECTOR = "vec_id long, embedding array<double>"


def plain_vectors(rows):
    """By row: links and component, from all pairs."""
    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return None
        x, y = np.array(a, np.longdouble), np.array(b, np.longdouble)
        if not np.isfinite(x.astype(float)).all() or not np.isfinite(y.astype(float)).all() or not x.any() or not y.any():
            return None
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    n = len(rows)
    links = [(i, j) for i, j in combinations(range(n), 2) if (c := cosine(rows[i][1], rows[j][1])) is not None and c >= 0.95]
    top = least_members(range(n), links)
    least = {}
    for i in range(n):
        least[top[i]] = min(least.get(top[i], rows[i][0]), rows[i][0])
    count = [sum(i in p for p in links) for i in range(n)]
    return sorted((rows[i][0], count[i], least[top[i]], rows[i][0] == least[top[i]]) for i in range(n))


def test_vectors_of_any_length_size_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [
        (10, [1e200, 1e200]), (11, [1e200, 1.01e200]), (12, [1e-200, 1e-200]),
        (1, [0.0, 1.0]), (1, [1.0, 0.0]), (5, [0.0, 2.0]), (1, [0.0, 1.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]),
        (20, [1.0, 0.0, 0.0]), (21, [1.0, 0.0, 0.0]), (22, [1.0]), (23, [3.0]), (24, []), (25, [0.0, 0.0]),
    ]
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(rng.choice([2, 3]))]) for i in range(60)]
    got = embedding_dedup.linked_vectors(spark.createDataFrame(rows, VECTOR))
    assert sorted(tuple(r) for r in got.collect()) == plain_vectors(rows)
    wide = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    wide += [(300 + i, [x + rng.gauss(0, 0.02) for x in wide[i][1]]) for i in range(100)] + [(500 + i, v[:5]) for i, v in wide[:50]]
    links, _ = embedding_dedup.sorted_pass(spark.createDataFrame(wide, VECTOR), 0, 3, 16, 0.95)
    found = {tuple(sorted(r)) for r in links.collect()}
    vector = dict(wide)
    assert found and all(len(vector[a]) == len(vector[b]) for a, b in found)
