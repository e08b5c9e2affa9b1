import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlink.functions.similarity import (
    Texts,
    at_most,
    jaro_winkler,
    jaro_winkler_arrays,
    jaro_winkler_pairs,
    similarities,
    similarity_blocks,
)


@pytest.mark.parametrize(
    "a, b, value",
    [
        ("martha", "marhta", 0.961111),
        ("abcd", "abxy", 0.666667),
        ("abcdz", "abcqr", 0.813333),
        ("dixon", "dicksonx", 0.813333),
        ("québec", "quebec", 0.879365),
        ("a", "", 0.0),
        ("", "", 0.0),
        ("a", "a", 1.0),
    ],
)
def test_known_values(a, b, value):
    assert jaro_winkler_pairs([a], [b])[0] == pytest.approx(value, abs=1e-6)


words = st.text(alphabet="abcdé ñ漢", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=40))
def test_same_as_an_independent_engine(pairs):
    values = ", ".join("(" + ", ".join("'" + x + "'" for x in p) + ")" for p in pairs)
    wanted = duckdb.sql(f"SELECT jaro_winkler_similarity(a, b) FROM (VALUES {values}) t(a, b)").fetchall()
    got = jaro_winkler_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [w[0] for w in wanted], rtol=0, atol=1e-12)


def test_null_in_null_out(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(jaro_winkler("a", F.col("b"))).collect()] == [1.0, None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=40))
def test_bounds_are_never_below_the_similarity(pairs):
    left, right = (Texts(pa.array(x, pa.string())) for x in zip(*pairs))
    every = np.arange(len(pairs))
    assert (at_most(left, every, right, every) >= similarities(left, every, right, every) - 1e-12).all()


def test_slices_and_repeated_pairs():
    a = pa.array(["x", "martha", None, "martha", "", "dixon"]).slice(1)
    b = pa.array(["x", "marhta", "a", "marhta", "", None]).slice(1)
    got = jaro_winkler_arrays(a, b).to_pylist()
    assert got[0] == got[2] == pytest.approx(0.961111, abs=1e-6) and got[1] is got[4] is None and got[3] == 0.0
    assert jaro_winkler_arrays(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("longest, many", [(9, 90), (30, 120), (70, 400), (150, 60)])
def test_matrices_of_pairs_are_the_pairs(longest, many):
    rng = np.random.default_rng(longest)
    drawn = ["".join(rng.choice(list("abcdé ñ漢"), rng.integers(0, longest))) for _ in range(many)]
    ends = ["".join(rng.choice(list("abcd"), 5)) for _ in range(many)]
    texts = Texts(pa.array([*drawn, *[f"society of {e}" for e in ends], "x" * 70, "", ""], pa.string()))
    i, j = np.arange(0, len(texts.lengths), 2), np.arange(len(texts.lengths))
    for least in (0.0, 0.7):
        got = np.full((len(j), len(i)), -1.0)
        for a, b, alike in similarity_blocks(texts, i, texts, j, least):
            assert (got[np.ix_(b, a)] == -1).all()
            got[np.ix_(b, a)] = alike
        wanted = similarities(texts, np.tile(i, len(j)), texts, np.repeat(j, len(i))).reshape(got.shape)
        reach = wanted >= least
        assert (got[reach] == wanted[reach]).all() and (got[~reach] < least).all() and (got >= 0).all()
