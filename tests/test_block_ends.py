"""Pairs of names from the first and last profiles of a block against those of all profiles."""

from pyspark.sql import functions as F

from checks import queries
from rosterlink.operators import blocking
from tests.conftest import SMALL

MODEL, NM = queries.MODEL, queries.NM


def names(profiles):
    return blocking.block_pairs(profiles).select(F.col(f"l_{NM}").alias("a"), F.col(f"r_{NM}").alias("b")).distinct()


def test_ends_have_all_pairs_of_names(spark):
    profiles = queries.stage(spark, SMALL, "profiles")
    whole, part = names(profiles), names(blocking.block_ends(profiles, NM))
    assert whole.count() == part.count() > 0 and whole.exceptAll(part).count() == 0


def test_many_profiles_of_one_name_make_no_square(spark):
    """Both orders of two names, and a name with itself, from four of 120 profiles."""
    kinds = ", ".join(f"{c} string" for c in MODEL.columns)
    rows = [
        (n, 1, "N", *[{NM: f"common {n % 2}", "recipient_postal_code": "K1A0B1",
                       "recipient_operating_name_en": f"other {n}"}.get(c) for c in MODEL.columns])
        for n in range(120)
    ]
    profiles = spark.createDataFrame(rows, f"id long, n long, recipient_type string, {kinds}")
    ends = blocking.block_ends(profiles, NM)
    assert ends.columns == profiles.columns
    assert {r["id"] for r in ends.collect()} == {0, 1, 118, 119}
    found = {tuple(r) for r in names(ends).collect()}
    assert found == {tuple(r) for r in names(profiles).collect()} and len(found) == 4
