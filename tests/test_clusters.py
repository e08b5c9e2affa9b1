import pytest

from rosterlink.operators import canonical, verifying


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [
        (1, 0, "a", None, "F", 1.0), (2, 0, "b", None, "F", 2.0), (3, 0, None, None, None, None),
        (4, 9, "x", "lab", "Z", None), (5, 9, "x", "lab", "S", None), (6, 9, "y", None, "S", None),
        (7, 12, None, None, None, None),
    ]
    return spark.createDataFrame(
        rows, "unique_id long, cluster_id long, recipient_legal_name string, "
        "research_organization_name string, recipient_type string, agreement_value double",
    )


def test_canonical_names(clusters):
    got = {r["cluster_id"]: tuple(r)[1:] for r in canonical.canonical_entities(clusters).collect()}
    assert got == {
        0: ("a (Festivals)", "F", 3.0, 3),  # tied names: the least, a name before null
        9: ("lab", "Z", 0.0, 3),  # unknown label, all amounts null
        12: (None, None, 0.0, 1),
    }


def test_mode_with_and_without_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "k int, v string")
    assert canonical.most_frequent(df, ["k"], "v").first()["v"] == "a"
    assert canonical.most_frequent(df, ["k"], "v", count_null=True).first()["v"] is None


def test_overview(clusters):
    row = verifying.cluster_overview(clusters).first()
    assert (row["total_rows"], row["n_clusters"], row["mean_size"], row["median_size"], row["singletons"]) == (7, 3, 2.3, 3.0, 1)
    assert verifying.cluster_overview(clusters.limit(0)).first()["mean_size"] is None


def test_null_counts_as_a_type(clusters):
    got = {r["cluster_id"]: r["n_types"] for r in verifying.cross_type_clusters(clusters).collect()}
    assert got == {0: 2, 9: 2}


def test_attributes_need_the_id(clusters):
    with pytest.raises(ValueError):
        verifying.attach_attributes(clusters, clusters.drop("unique_id"), ["recipient_city"])
    assert verifying.attach_attributes(clusters, clusters, ["recipient_type"]) is clusters


def test_search_returns_whole_entities(clusters):
    df = clusters.withColumnRenamed("recipient_legal_name", "recipient_legal_name_en")
    assert {r["unique_id"] for r in verifying.entity_search(df, "B").collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        verifying.entity_search(df, "  ")


def test_samples_repeat(clusters):
    first, second = (verifying.sample_clusters(clusters, 2, 42).collect() for _ in range(2))
    assert sorted(first) == sorted(second) and len({r["cluster_id"] for r in first}) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_per_group_are_cut_before_the_shuffle(spark):
    from rosterlink.operators import enriching, profiling

    df = spark.createDataFrame([("a", 1)], "k string, i int")
    assert "Partial" in plan_of(profiling.sample_per_group(df, "k", ["i"])).split("WindowGroupLimit")[-1]
    values = spark.createDataFrame([("x", "org", "v", 1)], f"{enriching.NAME} string, field string, value string, n long")
    contexts = spark.createDataFrame([("x", True, 1)], f"{enriching.NAME} string, has_bn boolean, n long")
    assert "WindowGroupLimit" in plan_of(enriching.render_prompt(contexts, values))
