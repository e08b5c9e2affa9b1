"""Documents through the stages of a training-text pipeline.

Toxic documents go, then later copies of repeated lines (and documents that lose every
line), then all but one of each group of near copies, then documents that hold a benchmark
item; what is left is encoded. Each stage reads what the one before has written. All stages
but the last return the columns of their input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import rosterlink
from rosterlink.llm import bpe, decontamination, line_dedup, order_minhash, toxicity
from rosterlink.llm.common import table
from rosterlink.llm.queries import byte_vocabulary
from rosterlink.sources.tables import owned_intermediates, remove, shared_folder

# Functions travel to the workers by value, wherever the driver runs from.
cloudpickle.register_pickle_by_value(rosterlink)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_copied_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to."""
    return bpe.bpe_documents(docs, byte_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_copied_lines),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", encoded),
]
#: The stages learn, hash and encode, which SQL cannot say; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read by the next one.

    What a stage writes on the way is removed when it is done, and its result when the next one
    is; the last result stays for the caller.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with owned_intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
