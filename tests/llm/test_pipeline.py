"""The pipeline against its stages done plainly, one after the other."""

import os
import re
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import pytest

import corpus_pipeline
from rosterlink.llm import bpe, decontamination, order_minhash, toxicity
from rosterlink.llm.common import SHARES, sample_slots
from rosterlink.llm.queries import QUERIES, byte_vocabulary
from rosterlink.sources.tables import shared_folder
from tests.conftest import SMALL
from tests.llm.conftest import PROSE
from tests.llm.test_duplicates import least_members, plain_line_dedup

ROOT = str(Path(__file__).resolve().parents[2])


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe"
    ]


def test_pipeline_is_its_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    graded = toxicity.grade_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    toxic = {r["doc_id"] for r in graded.filter("toxic").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    left = plain_line_dedup(rows, 5, 4)
    lost = {i for i, t in rows if left[i] == "" and t != ""}
    texts = {i: t for i, t in left.items() if i not in lost}
    similar = [
        (i, j) for i, j in combinations(sorted(texts), 2)
        if order_minhash.words_of(texts[i]) and order_minhash.similar(texts[i], texts[j])
    ]
    least = least_members(texts, similar)
    texts = {i: t for i, t in texts.items() if least[i] == i}
    tests = [decontamination.plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {
        i: t for i, t in texts.items()
        if not any(
            decontamination.align(p, decontamination.plain(t))[0] <= decontamination.edit_budget(len(p)) for p in tests
        )
    }
    codec = bpe.Codec(bpe.read_vocabulary(byte_vocabulary()))
    wanted = {i: len(next(codec.encoded([t]))) for i, t in clean.items()}
    folder = shared_folder(spark)
    before = {p for p, _, _ in os.walk(folder)}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == wanted
    # Of what the run has written, the last result alone is left.
    left = [p for p, _, files in os.walk(folder) if files and p not in before]
    assert len(left) == 1 and left[0].endswith("4-bpe")
    assert 0 < len(got) < len(rows)


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_and_odd_rows(spark, documents, odd_texts, number):
    docs = documents(odd_texts)
    _, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, SMALL)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    kept = {r["doc_id"]: r["text"] for r in got.collect()}
    assert kept[0] is None and kept[1] == "" and kept[7] == PROSE[0] and None in kept
    assert stage(spark, docs.limit(0), SMALL).count() == 0


CLASHES = ["_toxicity", "lines", "lines_deleted", "_digest", "_lines", "_copy", "copy", "_leak", "rest", "doc", "gone", "d", "s", "first"]


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_with_any_name(spark, documents, number):
    docs = documents([(1, PROSE[0]), (2, PROSE[1]), (3, PROSE[1])]).selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])
    got = corpus_pipeline.STAGES[number][1](spark, docs, SMALL)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) >= 2 and all(r[c] == c for r in rows for c in CLASHES)


def test_samples_never_vanish_on_large_tables():
    for rows in (1, 1_999, 10**9, 10**10, 10**13):
        slots = sample_slots(500, rows)
        assert slots == SHARES if rows <= 500 else slots / SHARES * rows == pytest.approx(500, rel=0.01)


def test_workers_need_not_import_the_package(tmp_path):
    """Queries run from a folder without the package, on workers that cannot see it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
queries = entry.queries()
sys.path.remove({ROOT!r})
for name in {sorted(n for n in QUERIES if re.match("op(3|6|7|8|12)_", n))!r}:
    assert queries[name](s, {SMALL!r}).collect()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
