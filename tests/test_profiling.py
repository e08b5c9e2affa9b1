"""The report reads its table twice, and is the sections done one by one."""

import re

from pyspark.sql import functions as F

from checks.fixtures import grants
from rosterlink.operators import profiling
from tests.conftest import SMALL


def test_report_scans_its_table_twice(spark, tmp_path, monkeypatch):
    grants(spark, SMALL).write.parquet(str(tmp_path / "grants"))
    df = spark.read.parquet(str(tmp_path / "grants"))
    eager = []
    write = profiling.materialize

    def scans(part):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        return sum("ref_number" in x for x in re.findall(r"Relation \[[^\]]*\]", plan))

    def watched(part, label):
        eager.append(scans(part))
        return write(part, label)

    monkeypatch.setattr(profiling, "materialize", watched)
    assert scans(profiling.profile_report(df)) == 1 and eager == [1]


def test_report_is_its_sections(spark):
    df = grants(spark, SMALL)
    got = {(r["section"], r["key"], r["metric"]): r["value"] for r in profiling.profile_report(df).collect()}
    for r in profiling.completeness(df).collect():
        for m in ("total", "filled", "null_count", "empty_count", "fill_rate"):
            assert got.pop(("completeness", r["column"], m)) == r[m]
    for r in profiling.separator_census(df).collect():
        assert got.pop(("bilingual_names", r["column"], "pct")) == r["pct"]
        assert got.pop(("bilingual_names", r["column"], "with_separator")) == r["with_separator"]
    for section, part in (("business_number_formats", profiling.id_format_census(df)), ("unique_names", profiling.distinct_name_census(df)), ("shape", profiling.table_shape(df))):
        for m, v in part.first().asDict().items():
            assert got.pop((section, None, m)) == v
    for r in profiling.value_distribution(df, "recipient_type").collect():
        assert (got.pop(("recipient_types", r["value"], "n")), got.pop(("recipient_types", r["value"], "pct"))) == (r["n"], r["pct"])
    for r in profiling.top_k_values(df).collect():
        assert got.pop(("top_owner_orgs", r["value"], "n")) == r["n"]
    assert not got


def test_report_of_few_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert {r["section"] for r in profiling.profile_report(df).collect()} == {"shape"}
    empty = grants(spark, SMALL).limit(0)
    values = {(r["section"], r["metric"]): r["value"] for r in profiling.profile_report(empty).filter(F.col("key").isNull()).collect()}
    assert values["shape", "total_rows"] == 0 and values["unique_names", "distinct_exact"] == 0
    assert values["business_number_formats", "coverage_pct"] is None
