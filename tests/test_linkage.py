import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.fixed import fixed_params
from checks.fixtures import grants
from rosterlink.functions.levels import LinkageModel
from rosterlink.operators import blocking, clustering, comparing, lookups, scoring, training
from rosterlink.operators.normalizing import add_stripped_name
from rosterlink.plans import grants_flow, linkage
from rosterlink.sources import results, tables
from tests.conftest import SMALL

MODEL = LinkageModel()
COLUMNS = ["unique_id", "recipient_type", "recipient_legal_name_en", "recipient_legal_name_fr",
           "recipient_operating_name_en", "recipient_business_number", "recipient_postal_code",
           "recipient_city", "research_organization_name_en"]
SCHEMA = "unique_id long, " + ", ".join(f"{c} string" for c in COLUMNS[1:])


def make_records(spark, rows):
    """Rows of (type, name, number, postal, city); the id is the row number."""
    full = [(i, t, n, None, None, b, p, c, None) for i, (t, n, b, p, c) in enumerate(rows)]
    return add_stripped_name(spark.createDataFrame(full, SCHEMA))


def rules_hold(a, b):
    """The first blocking rule two records satisfy, by hand."""
    def same(*fs):
        return all(f(a) is not None and f(a) == f(b) for f in fs)

    def name(k=None):
        return lambda r: r[1] if k is None or r[1] is None else r[1][:k]

    number, postal, city = (lambda r: r[2]), (lambda r: r[3]), (lambda r: r[4])
    rules = [same(number), same(name(), postal), same(name(), city), same(postal, name(6)), same(city, name(5))]
    return next((k for k, hit in enumerate(rules, 1) if hit), None)


record = st.tuples(
    st.sampled_from(["F", "N"]),
    st.sampled_from([None, "alpha one", "alpha two", "beta", "canadian beta"]),
    st.sampled_from([None, "1", "2"]),
    st.sampled_from([None, "p", "q"]),
    st.sampled_from([None, "c", "d"]),
)


@settings(max_examples=8, deadline=None)
@given(st.lists(record, min_size=2, max_size=40), st.sampled_from([2, 10**9]))
def test_weighted_pairs_are_all_record_pairs(spark, rows, per_cell):
    profiles = blocking.collapse_profiles(make_records(spark, rows))
    pairs = blocking.candidate_pairs(profiles, pairs_per_cell=per_cell)
    got = {r["match_rule"]: r["n"] for r in pairs.groupBy("match_rule").agg(F.sum("n_pairs").alias("n")).collect()}
    wanted = {}
    for a, b in itertools.combinations(rows, 2):
        rule = rules_hold(a, b) if a[0] == b[0] else None
        if rule:
            wanted[rule] = wanted.get(rule, 0) + 1
    assert got == wanted
    ids = pairs.select("id_l", "id_r").collect()
    assert len(ids) == len(set(ids))


def test_large_blocks_form_each_pair_once(spark):
    """A block of many profiles in a triangle of cells: rows are copied along one side only, and
    the sides of a pair stay in the order of their ids, texts included."""
    n, tiles = 300, 6
    rows = [("F", f"name {i % 7} {i}", "1", None, f"c{i % 3}") for i in range(n)]
    profiles = blocking.collapse_profiles(make_records(spark, rows))
    pairs = blocking.block_pairs(profiles, pairs_per_cell=(n // tiles) ** 2).collect()
    assert len(pairs) == len({(r["id_l"], r["id_r"]) for r in pairs}) == n * (n - 1) // 2
    for r in pairs:
        assert r["id_l"] < r["id_r"]
        assert (r["l_recipient_legal_name_en"], r["r_recipient_legal_name_en"]) == (rows[r["id_l"]][1], rows[r["id_r"]][1])
        assert (r["l_recipient_city"], r["r_recipient_city"]) == (rows[r["id_l"]][4], rows[r["id_r"]][4])


def test_blocking_is_an_equi_join(spark):
    profiles = blocking.collapse_profiles(make_records(spark, [("F", "a", "1", "p", "c")] * 2))
    plan = blocking.block_pairs(profiles)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prior_needs_no_pairs(spark):
    rows = [("F", n, b, p, None) for n, b, p in itertools.product(["x", "y"], ["1", "2", None], ["p", None])] * 2
    profiles = blocking.collapse_profiles(make_records(spark, rows))
    caught = sum(
        1 for a, b in itertools.combinations(rows, 2)
        if (a[2] is not None and a[2] == b[2]) or (a[1] == b[1] and a[3] is not None and a[3] == b[3])
    )
    n = len(rows)
    got = training.estimate_prior(profiles).first()["prior"]
    assert got == pytest.approx(min(1 - 1e-7, caught / 0.7 / (n * (n - 1) / 2)))


def components_by_union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def check_components(spark, edges):
    """In one task, and in rounds of tasks that hold few links."""
    df = spark.createDataFrame(edges, "a long, b long")
    wanted = components_by_union([(a, b) for a, b in edges if a != b])
    for task_links in (clustering.TASK_LINKS, 3, 0):
        rows = clustering.connected_components(df, task_links).collect()
        assert {r["node"]: r["component"] for r in rows} == wanted and len(rows) == len(wanted)


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(50)],
        [(0, i) for i in range(1, 40)],
        [(99, i) for i in range(40)],
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)],
        [(1, 2), (2, 1), (1, 2), (7, 7)],
        [(5, 5)],
    ],
    ids=["chain", "star", "star from above", "triangles", "doubles", "loop only"],
)
def test_components(spark, edges):
    check_components(spark, edges)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_components_of_any_graph(spark, edges):
    check_components(spark, edges)


def test_components_of_odd_links(spark):
    links = [("b", "a"), ("a", "b"), (None, "a"), ("c", None), ("d", "d"), ("c", "b")]
    got = clustering.connected_components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}
    none = spark.createDataFrame([], "a long, b long")
    assert clustering.connected_components(none).count() == 0


def test_isolated_nodes_stay_alone(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    pairs = spark.createDataFrame([(1, 3, 0.96), (3, 4, 0.94)], "id_l long, id_r long, match_probability double")
    got = {r["id"]: r["cluster_id"] for r in clustering.cluster_pairs(pairs, nodes).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4}


def test_lookup_join_is_a_left_join(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(60)], "id long, k long")
    lookup = spark.createDataFrame([(k, f"v{k}" if k else None) for k in range(4)], "k long, v string")
    got = lookups.lookup_join(df, lookup, ["k"])
    wanted = df.join(lookup, "k", "left").select("id", "k", "v")
    assert got.columns == ["id", "k", "v"]
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(wanted.collect(), key=lambda r: r["id"])


def test_copies_stay_apart_without_evidence(spark):
    """Two equal records with little in common but a very common city are not one entity."""
    city = [("F", None, None, None, "c")] * 3
    named = [("F", "rare name", "123", "p", "c")] * 3
    others = [("F", f"other {i}", str(1000 + i), f"z{i}", None) for i in range(300)]
    records = make_records(spark, city + named + others)
    profiles = blocking.collapse_profiles(records)
    carry = comparing.tf_carried()
    weighed = comparing.attach_term_frequencies(profiles)
    vectors = comparing.comparison_vectors(blocking.candidate_pairs(weighed, carry=carry), carry=carry)
    scored = scoring.score_pairs(vectors, fixed_params(spark))
    got = {r["unique_id"]: r["cluster_id"]
           for r in linkage.cluster_records(records, profiles, scored).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3} | {i: i for i in range(6, 306)}


def test_null_places_matter_in_the_profile_key(spark):
    rows = [(0, "F", None, None, "x", None, None, None, None), (1, "F", None, None, None, "x", None, None, None)]
    keys = linkage.with_profile_key(add_stripped_name(spark.createDataFrame(rows, SCHEMA)))
    assert keys.select(*linkage.PROFILE_KEY).distinct().count() == 2


def test_small_shards_are_left_out(spark):
    records = make_records(spark, [("F", "a", "1", None, None)] * 2 + [("G", "b", "2", None, None), (None, "c", None, None, None), ("X", "d", None, None, None)])
    assert {r["unique_id"] for r in blocking.shard_filter(records).collect()} == {0, 1}
    clusters = records.filter("recipient_type = 'F'").selectExpr("*", "0L AS cluster_id")
    report = {r["recipient_type"]: (r["n_rows"], r["entities"], r["status"])
              for r in clustering.shard_report(records, clusters).collect()}
    assert report["F"] == (2, 1, "ok")
    assert report["G"] == (1, 1, "skipped (too few)")
    assert report["I"] == (0, 0, "skipped (too few)")


def test_unique_ids_have_no_gaps(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "x")
    ids = [r[0] for r in blocking.with_unique_id(df).select("unique_id").collect()]
    assert sorted(ids) == list(range(1000))


def pair_count(df, *keys):
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg((n * (n - 1) / 2).alias("p")).agg(F.sum("p")).first()[0]


def test_linking_finds_the_true_entities(spark, tmp_path):
    raw = tables.materialize(grants(spark, SMALL), "raw")
    names, linked = grants_flow.canonical_grants(raw, "gid")
    clusters = tables.materialize(linked.clusters, "clusters")
    right = pair_count(clusters, "recipient_type", "truth", "cluster_id")
    assert right / pair_count(clusters, "cluster_id") > 0.95
    assert right / pair_count(clusters, "recipient_type", "truth") > 0.8
    assert names.count() == clusters.select("cluster_id").distinct().count()
    assert clusters.groupBy("cluster_id").agg(F.count_distinct("recipient_type").alias("k")).filter("k > 1").count() == 0
    sums = linked.params.groupBy("shard", "comparison").agg(F.sum("m").alias("m"))
    assert all(r["m"] == pytest.approx(1, abs=1e-3) for r in sums.collect())
    results.save_model(linked.params, str(tmp_path / "model"))
    back = results.load_model(spark, str(tmp_path / "model"))
    assert sorted(map(tuple, back.select(*linked.params.columns).collect())) == sorted(map(tuple, linked.params.collect()))


def test_unlinked_rows_can_be_kept(spark):
    records = make_records(spark, [("F", "a", "1", None, None)] * 2 + [("G", "b", "2", None, None), (None, "c", None, None, None)])
    kept = linkage.link_and_cluster(records, params=fixed_params(spark), keep_unclustered=True).clusters
    got = {r["unique_id"]: r["cluster_id"] for r in kept.collect()}
    assert set(got) == {0, 1, 2, 3} and got[2] is None and got[3] is None
