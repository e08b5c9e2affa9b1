"""Hand-off tables that are no more than columns of the grants are not written whole."""

import pytest

from checks import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name, wanted, idle", [
    ("postal_summary", "recipient_postal_code", "recipient_legal_name"),
    ("cross_type_clusters", "recipient_type", "recipient_legal_name"),
    ("cross_type_clusters", "truth", "recipient_postal_code"),
])
def test_only_the_columns_read_are_worked_out(spark, name, wanted, idle):
    found = queries.QUERIES[name](spark, SMALL)
    assert all("/grants-" in path for path in found.inputFiles())
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert wanted in above and idle not in above


def test_views_hold_what_the_operators_make(spark):
    from rosterlink.operators import normalizing

    made = normalizing.normalize_grants(queries.stage(spark, SMALL, "grants"))
    view = queries.stage(spark, SMALL, "normalized")
    assert view.columns == made.columns and view.exceptAll(made).count() == 0
    clusters = queries.stage(spark, SMALL, "true_clusters")
    assert clusters.count() == made.count()
    assert clusters.groupBy("truth").agg({"unique_id": "min", "cluster_id": "max"}).filter(
        "`min(unique_id)` <> `max(cluster_id)`"
    ).count() == 0
