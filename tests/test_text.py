import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.functions import vocabulary as V
from rosterlink.functions.rules import first_match, person_name_pattern, recipient_rules
from rosterlink.operators import classifying, normalizing, profiling

NBSP = " "


def column(spark, values, make):
    """Result of ``make`` for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def test_split_bilingual(spark):
    values = ["a|b|c", "|b", "a|", "", None, "plain"]
    assert column(spark, values, lambda c: text.split_bilingual(c)[0]) == ["a", "", "a", "", None, "plain"]
    assert column(spark, values, lambda c: text.split_bilingual(c)[1]) == ["b", "b", "", None, None, None]


def test_clean_name_strips_before_deleting_stops(spark):
    values = [f"{NBSP}\tFoo Inc.{NBSP}", "foo .", " ÉCOLE ", None, " . "]
    assert column(spark, values, text.clean_name) == ["foo inc", "foo ", "école", None, ""]


def test_business_number(spark):
    values = ["00000000", "xxxxxxx", "Non actif", "n/a", "123456789RT0001", "12345678",
              "123456788012345", " 012 345 677 RC ", "999999999", "", None]
    expected = [None, None, None, None, None, None, "123456788", "012345677", None, None, None]
    assert column(spark, values, text.normalize_business_number) == expected


def test_postal_code_needs_a_domestic_country(spark):
    rows = [(" h0h 0h0 ", "CA"), (" h0h 0h0 ", " canada "), (" h0h 0h0 ", "US"), (" h0h 0h0 ", None),
            ("12345", "CA"), (None, "CA"), (f"h0h{NBSP}0h0", "Canada")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, k string")
    got = df.orderBy("i").select(text.normalize_postal_code(F.col("c"), F.col("k"))).collect()
    assert [r[0] for r in got] == ["H0H0H0", "H0H0H0", " h0h 0h0 ", " h0h 0h0 ", None, None, "H0H0H0"]


def test_blank_to_null_keeps_padding(spark):
    assert column(spark, ["", f" {NBSP}\t", " a ", None], text.blank_to_null) == [None, None, " a ", None]


def test_remove_whitespace(spark):
    assert column(spark, [f" G C\t-{NBSP}1\n", None], text.remove_whitespace) == ["GC-1", None]


def strip_by_loop(name):
    if name is None:
        return None
    rest = name.lower().strip()
    while True:
        hit = next((p for p in V.COMMON_PREFIXES if rest.startswith(p + " ")), None)
        if hit is None:
            return rest or None
        rest = rest[len(hit) + 1:]


def test_prefixes_by_hand(spark):
    values = ["national canadian association x", "canadian", "canadian  x", "", None, "Canadian Red Cross",
              "society ", "canadiana x"]
    assert column(spark, values, text.strip_common_prefixes) == [strip_by_loop(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*V.COMMON_PREFIXES, "x", "red cross", "", " "]), max_size=5)
                .map(" ".join), min_size=1, max_size=30))
def test_prefixes_as_a_loop_would(spark, values):
    assert column(spark, values, text.strip_common_prefixes) == [strip_by_loop(v) for v in values]


def test_person_names(spark):
    values = ["doe, jane", "a b c, d", "a, b, c", "doe, " + "x" * 19, "doe, " + "x" * 18, "doe,jane",
              "doe", "a b, c d e", None]
    assert column(spark, values, person_name_pattern) == [
        True, False, False, False, True, False, False, False, None]


@pytest.mark.parametrize(
    "name, number, research, label",
    [
        ("first nation council", None, None, "N"),
        ("québec ltée", None, None, "F"),
        ("conseil métis", None, None, "A"),
        ("town museum", None, None, "N"),
        ("town of foo", None, None, "G"),
        ("the incé house", None, None, None),
        ("CÉGEP du nord", None, None, "S"),
        ("plain", "123 RR0001", None, "N"),
        ("plain", "123 rr0001", None, None),
        ("plain", None, "some lab", "S"),
        ("plain", None, "", None),
        ("doe, jane", None, None, "P"),
        (None, None, None, None),
        (None, "RR1", None, "N"),
        ("big radio", None, None, "F"),
    ],
)
def test_rules_in_order(spark, name, number, research, label):
    df = spark.createDataFrame(
        [(name, number, research)],
        "recipient_legal_name_en string, bn_raw string, research_organization_name_en string",
    )
    assert df.select(first_match(recipient_rules())).first()[0] == label


def test_an_empty_label_counts_as_original(spark):
    df = spark.createDataFrame(
        [("a inc", "", None, None), ("a inc", None, None, None), ("zzz", None, None, None)],
        "recipient_legal_name_en string, recipient_type string, bn_raw string, "
        "research_organization_name_en string",
    )
    got = classifying.classify_with_provenance(df).select(
        "recipient_type_new", "recipient_type_source", "recipient_type_confidence").collect()
    assert [tuple(r) for r in got] == [("", "original", 1.0), ("F", "deterministic", 1.0), (None, None, None)]


def test_replaced_columns_go_last(spark):
    from checks.fixtures import grants
    from tests.conftest import SMALL

    raw = grants(spark, SMALL)
    columns = normalizing.normalize_grants(raw).columns
    assert columns[-3:] == ["recipient_business_number", "recipient_postal_code", "ref_number"]
    assert columns[raw.columns.index("ref_number")] == "ref_number_raw"
    assert columns[raw.columns.index("recipient_business_number")] == "bn_raw"


def test_null_and_empty_share_a_label(spark):
    df = spark.createDataFrame([("",), (None,), ("x",), ("x",)], "c string")
    got = {r["value"]: (r["n"], r["pct"]) for r in profiling.value_distribution(df, "c").collect()}
    assert got == {"(empty)": (2, 50.0), "x": (2, 50.0)}


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "ref_number string, recipient_business_number string")
    assert profiling.completeness(df).first()["fill_rate"] is None
    assert profiling.key_uniqueness(df).first()["all_unique"] is True
    assert profiling.id_format_census(df).first()["other_format"] == 0
    assert profiling.value_distribution(df, "ref_number").count() == 0


def test_search_text_is_not_a_pattern(spark):
    df = spark.createDataFrame([("a.b", None), ("axb", None), (None, "A.B")], "x string, y string")
    assert profiling.search_any(df, "a.b", ["x", "y"]).count() == 2
    assert profiling.search_any(df, "a.b", ["x", "y"], regex=True).count() == 3
