import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def sorted_rows(table):
    rows = [tuple((r[c] is None, str(r[c])) for c in sorted(r)) for r in table.to_pylist()]
    return sorted(rows)


def plain(t):
    return str(t).replace("large_", "")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, other_engine, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    wanted = other_engine.sql(SQL[name]).to_arrow_table()
    assert {f.name: plain(f.type) for f in got.schema} == {f.name: plain(f.type) for f in wanted.schema}
    assert sorted_rows(got) == sorted_rows(wanted)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "canonical_name", "recipient_type", "total_funding", "grant_count"]
    assert df.count() > 0
