"""The flow from a CSV export to named tables, run twice."""

import os

import pytest

from checks.fixtures import grants
from rosterlink.operators import enriching
from rosterlink.operators.enriching import Reply
from rosterlink.plans import grants_flow
from rosterlink.plans.grants_flow import grants_from_csv
from rosterlink.sources import tables
from rosterlink.sources.results import load_model, read_snapshot
from tests.conftest import SMALL


def written_csv(spark, tmp_path):
    raw = grants(spark, SMALL).drop("gid", "truth")
    raw = raw.withColumn("agreement_start_date", raw["agreement_start_date"].cast("date"))
    raw.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
        str(tmp_path / "csv")
    )
    return raw


def test_a_broken_run_goes_on_after_its_last_step(spark, tmp_path, monkeypatch):
    raw = written_csv(spark, tmp_path)
    reads, links = [], []
    read, link = grants_flow.read_grants_csv, grants_flow.link_and_cluster
    monkeypatch.setattr(grants_flow, "read_grants_csv", lambda *a: reads.append(1) or read(*a))

    def breaks(df):
        links.append(1)
        if len(links) == 1:
            raise RuntimeError("lost")
        return link(df)

    monkeypatch.setattr(grants_flow, "link_and_cluster", breaks)
    folder = tables.shared_folder(spark)
    before = {p for p, _, _ in os.walk(folder)}

    def run(stamp):
        return grants_from_csv(spark, str(tmp_path / "csv"), raw.columns, str(tmp_path / "out"), stamp)

    with pytest.raises(RuntimeError, match="lost"):
        run("1")
    names = run("1")["canonical_names"]
    assert (len(reads), len(links)) == (1, 2) and names.count() > 0
    assert run("1")["canonical_names"].count() == names.count() and len(links) == 2
    run("2")
    assert (len(reads), len(links)) == (2, 3)
    assert {p for p, _, files in os.walk(folder) if files} <= before  # no intermediate is left


def test_answered_waves_are_not_asked_again(spark, tmp_path):
    rows = [("0", i, [f"n{i}"], f"p{i}") for i in range(40)]
    batches = spark.createDataFrame(rows, "bucket string, batch_no long, names array<string>, prompt string")
    calls = spark.sparkContext.accumulator(0)
    lost = tmp_path / "lost"

    def score(prompt):
        calls.add(1)
        return Reply(200, "[]")

    scored = enriching.score_batches

    def fails_late(own, *a, **how):
        if not lost.exists() and (tmp_path / "a" / "_finished" / "r" / "answers" / "wave=1").exists():
            lost.touch()
            raise RuntimeError("lost")
        return scored(own, *a, **how)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(enriching, "score_batches", fails_late)
        with pytest.raises(RuntimeError, match="lost"):
            enriching.score_in_waves(batches, score, str(tmp_path / "a"), "r", wave_batches=10, partitions=2)
        done = calls.value
        assert 0 < done < 40
        rows = enriching.score_in_waves(batches, score, str(tmp_path / "a"), "r", wave_batches=10, partitions=2).collect()
    assert calls.value == 40 and sorted(r["batch_no"] for r in rows) == list(range(40))
    assert {r["status"] for r in rows} == {"success"}


def test_second_run_asks_only_unanswered_names(spark, tmp_path):
    raw = written_csv(spark, tmp_path)
    calls = spark.sparkContext.accumulator(0)

    def score(prompt):
        calls.add(1)
        broken = len(prompt) % 5 == 0 and calls is not None
        return Reply(500, "no") if broken else Reply(200, '[{"type": "N", "confidence": 0.8}]')

    def run(stamp, cached):
        return grants_from_csv(
            spark, str(tmp_path / "csv"), raw.columns, str(tmp_path / "out"), stamp,
            score_fn=score, scorer="m", endpoint="e", cached=cached,
        )

    first = run("1", False)
    asked = calls.value
    verdicts = read_snapshot(spark, str(tmp_path / "out" / "verdicts"), "1")
    unanswered = verdicts.filter("not success").count()
    assert asked == verdicts.count() and 0 < unanswered < asked
    names = sorted(map(str, first["canonical_names"].collect()))
    second = run("2", True)
    assert calls.value == asked + unanswered
    assert sorted(map(str, second["canonical_names"].collect())) == names
    totals = second["linkage_totals"].first()
    assert totals["rows_processed"] == raw.count() and 0 < totals["entities"] < totals["rows_linked"]
    assert second["shard_report"].count() > 0
    assert load_model(spark, str(tmp_path / "out" / "model")).count() > 0
    assert (tmp_path / "out" / "entity_clusters" / "recipient_type=N").exists()
