"""The operators of this package as queries over whole tables, and SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlink.llm import (
    bpe,
    decontamination,
    embedding_dedup,
    fill_middle,
    language_id,
    line_dedup,
    lm_scoring,
    order_minhash,
    secret_scan,
    spelling_variants,
    substring_dedup,
    toxicity,
    url_filter,
)
from rosterlink.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_bpe(s: SparkSession, d: str) -> DataFrame:
    return bpe.bpe_documents(table(s, d, "documents"), byte_vocabulary())


@query
def op10_toxicity(s: SparkSession, d: str) -> DataFrame:
    return toxicity.grade_documents(table(s, d, "documents"), table(s, d, "labels"))


@query
def op5_line_dedup(s: SparkSession, d: str) -> DataFrame:
    return line_dedup.line_report(table(s, d, "documents"))


ORACLE["op5_line_dedup"] = line_dedup.sql()


@query
def op6_order_minhash(s: SparkSession, d: str) -> DataFrame:
    return order_minhash.duplicate_classes(table(s, d, "documents"))


@query
def op8_decontamination(s: SparkSession, d: str) -> DataFrame:
    return decontamination.find_leaks(table(s, d, "documents"), table(s, d, "benchmark"))


@query
def op7_secret_scan(s: SparkSession, d: str) -> DataFrame:
    return secret_scan.find_secrets(table(s, d, "documents"))


@query
def op3_language_id(s: SparkSession, d: str) -> DataFrame:
    return language_id.predict_documents(table(s, d, "documents"))


@query
def op2_embedding_dedup(s: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(s, d, "embeddings"))


ORACLE["op2_embedding_dedup"] = embedding_dedup.SQL


@query
def op9_url_filter(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages", "page_id", "url")
    entries = url_filter.event_entries(table(s, d, "events"), pages)
    return url_filter.judge(url_filter.page_captures(pages), entries)


ORACLE["op9_url_filter"] = url_filter.SQL


@query
def op4_lm_scoring(s: SparkSession, d: str) -> DataFrame:
    good = table(s, d, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.score_documents(table(s, d, "documents"), good)


@query
def op13_fill_middle(s: SparkSession, d: str) -> DataFrame:
    return fill_middle.middle_report(table(s, d, "documents"))


ORACLE["op13_fill_middle"] = fill_middle.SQL


@query
def op12_substring_dedup(s: SparkSession, d: str) -> DataFrame:
    return substring_dedup.repeat_report(table(s, d, "documents"))


ORACLE["op12_substring_dedup"] = substring_dedup.sql()


@query
def op11_spelling_variants(s: SparkSession, d: str) -> DataFrame:
    return spelling_variants.variant_groups(table(s, d, "documents"))
