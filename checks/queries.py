"""Every operator as a query over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixed import LEVEL_VALUES, PRIOR, VERDICT_SQL, fixed_params
from checks.fixtures import grants
from rosterlink.functions import text
from rosterlink.functions import vocabulary as V
from rosterlink.functions.levels import LinkageModel
from rosterlink.functions.rules import person_name_pattern
from rosterlink.functions.similarity import jaro_winkler
from rosterlink.operators import (
    blocking,
    canonical,
    cells,
    classifying,
    clustering,
    comparing,
    enriching,
    normalizing,
    profiling,
    scoring,
    training,
    value_pairs,
    verifying,
)
from rosterlink.plans import grants_flow, linkage
from rosterlink.sources import results, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NM = "recipient_legal_name_en"
MODEL = LinkageModel()

_stages: dict[tuple[str, str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A hand-off table, written on first use and read by every later query. Those in ``VIEWS`` are
    not written: a query works out the columns it reads, and no others."""
    if name in VIEWS:
        return VIEWS[name](spark, folder)
    at = (spark.sparkContext.applicationId, folder, name)
    if at not in _stages:
        _stages[at] = tables.materialize(STAGES[name](spark, folder), name)
    return _stages[at]


def _linkable(s: SparkSession, d: str) -> DataFrame:
    """Labelled by rules, ready to be linked; the grant id is the record id."""
    named = stage(s, d, "classified").drop("recipient_type")
    named = named.withColumnsRenamed({"recipient_type_new": "recipient_type", "gid": "unique_id"})
    return linkage.linkage_records(named)


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    contexts = enriching.residual_contexts(stage(s, d, "classified"))
    return contexts.select(NM, F.expr(VERDICT_SQL.format(nm=NM)).alias("llm_result_json"))


def _true_clusters(s: SparkSession, d: str) -> DataFrame:
    """The true entities as clusters, the least grant id as the cluster id."""
    named = stage(s, d, "normalized").withColumnRenamed("gid", "unique_id")
    ids = named.groupBy("truth").agg(F.min("unique_id").alias("cluster_id"))
    return named.join(ids, "truth")


def _weighed(s: SparkSession, d: str) -> DataFrame:
    return comparing.attach_term_frequencies(stage(s, d, "profiles"), MODEL)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return cells.candidate_vectors(stage(s, d, "weighed"), MODEL, comparing.tf_carried(MODEL))


def _fixed_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the pairs that can be likely under the fixed test parameters."""
    weighed, carry = stage(s, d, "weighed"), comparing.tf_carried(MODEL)
    return cells.candidate_vectors(weighed, MODEL, carry, fixed_params(s))


def _fixed_links(s: SparkSession, d: str) -> DataFrame:
    """Vectors of pairs that hang together all that the likely pairs do, under the same parameters."""
    weighed, carry = stage(s, d, "weighed"), comparing.tf_carried(MODEL)
    return cells.candidate_vectors(weighed, MODEL, carry, fixed_params(s), V.CLUSTER_THRESHOLD, linking=True)


def _patterns(s: SparkSession, d: str) -> DataFrame:
    """Level patterns of all candidate pairs, counted where they are compared."""
    return training.gamma_patterns(cells.block_patterns(stage(s, d, "profiles"), MODEL))


VIEWS: dict[str, Query] = {
    "normalized": lambda s, d: normalizing.normalize_grants(stage(s, d, "grants")),
    "true_clusters": _true_clusters,
}

STAGES: dict[str, Query] = {
    "grants": grants,
    "classified": lambda s, d: classifying.classify_with_provenance(stage(s, d, "normalized")),
    "records": lambda s, d: blocking.shard_filter(_linkable(s, d), MODEL),
    "profiles": lambda s, d: blocking.collapse_profiles(stage(s, d, "records"), MODEL),
    "weighed": _weighed,
    "vectors": _vectors,
}


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/rosterlink-checks/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _longs(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines have one integer type."""
    small = [n for n, t in df.dtypes if t in ("int", "tinyint", "smallint")]
    return df.withColumns({c: F.col(c).cast("bigint") for c in small})


# Sources and sinks


@query
def read_grants_csv(s: SparkSession, d: str) -> DataFrame:
    source = stage(s, d, "grants").withColumn(
        "agreement_start_date", F.col("agreement_start_date").cast("date")
    )
    path = _scratch(s, "csv")
    source.write.options(
        header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    read = tables.read_grants_csv(s, path, source.columns)
    return read.withColumns(
        {
            "gid": F.col("gid").cast("bigint"),
            "truth": F.col("truth").cast("bigint"),
            "agreement_value": F.col("agreement_value").cast("double"),
        }
    )


@query
def write_read_stage(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s, "stage")
    tables.write_stage(stage(s, d, "normalized"), path)
    return tables.read_stage(s, path, ["gid", "ref_number", NM, "recipient_postal_code"])


@query
def write_read_profile_report(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s, "report")
    results.write_profile_report(profiling.profile_report(stage(s, d, "grants")), path)
    return results.read_profile_report(s, path)


@query
def snapshot_verdicts(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s, "snapshots")
    results.snapshot_verdicts(
        _verdicts(s, d), path, "20240101T000000", "some-model", "some-endpoint"
    )
    return results.read_snapshot(s, path)


@query
def save_load_model(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s, "model")
    results.save_model(stage(s, d, "params"), path)
    return _shown_params(results.load_model(s, path))


# Profiling


@query
def table_shape(s: SparkSession, d: str) -> DataFrame:
    return profiling.table_shape(stage(s, d, "grants"))


@query
def completeness(s: SparkSession, d: str) -> DataFrame:
    return profiling.completeness(stage(s, d, "grants"))


@query
def null_summary(s: SparkSession, d: str) -> DataFrame:
    cleaned = normalizing.blank_to_null(stage(s, d, "normalized"))
    return profiling.null_summary(cleaned, V.LINKAGE_TEXT_COLUMNS)


@query
def value_distribution(s: SparkSession, d: str) -> DataFrame:
    return profiling.value_distribution(stage(s, d, "grants"), "recipient_type")


@query
def id_format_census(s: SparkSession, d: str) -> DataFrame:
    return profiling.id_format_census(stage(s, d, "grants"))


@query
def separator_census(s: SparkSession, d: str) -> DataFrame:
    return profiling.separator_census(stage(s, d, "grants"))


@query
def top_k_values(s: SparkSession, d: str) -> DataFrame:
    return profiling.top_k_values(stage(s, d, "grants"), "owner_org", 20)


@query
def distinct_name_census(s: SparkSession, d: str) -> DataFrame:
    return profiling.distinct_name_census(stage(s, d, "grants"))


@query
def key_uniqueness(s: SparkSession, d: str) -> DataFrame:
    return profiling.key_uniqueness(stage(s, d, "grants"))


@query
def key_uniqueness_with_null(s: SparkSession, d: str) -> DataFrame:
    return profiling.key_uniqueness_with_null(stage(s, d, "grants"), "recipient_business_number")


@query
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return profiling.duplicate_keys(stage(s, d, "grants"))


@query
def audit_filter(s: SparkSession, d: str) -> DataFrame:
    return profiling.audit_filter(
        stage(s, d, "grants"),
        {"owner_org": "org-7", "recipient_type": "N"},
        ["ref_number", "recipient_legal_name", "recipient_type", "owner_org", "owner_org_title"],
    )


@query
def search_any(s: SparkSession, d: str) -> DataFrame:
    return profiling.search_any(stage(s, d, "grants"), "UNIVERSITY").select(
        "gid", "recipient_legal_name"
    )


@query
def type_spread(s: SparkSession, d: str) -> DataFrame:
    return profiling.type_spread(stage(s, d, "grants"), "university")


@query
def sample_per_group(s: SparkSession, d: str) -> DataFrame:
    return profiling.sample_per_group(stage(s, d, "grants"), "recipient_type", ["gid"]).select(
        "recipient_type", "gid"
    )


@query
def head_sample(s: SparkSession, d: str) -> DataFrame:
    return profiling.head_sample(stage(s, d, "grants"), ["gid"]).select(
        "gid", "ref_number", "recipient_legal_name"
    )


@query
def profile_report(s: SparkSession, d: str) -> DataFrame:
    return profiling.profile_report(stage(s, d, "grants"))


@query
def profile_documents(s: SparkSession, d: str) -> DataFrame:
    """The same profile functions on another table."""
    documents = s.read.parquet(f"{d}/documents.parquet")
    return profiling.completeness(documents, ["text", "lang", "source"])


# Normalising


@query
def split_bilingual(s: SparkSession, d: str) -> DataFrame:
    english, french = text.split_bilingual(F.col("recipient_legal_name"))
    return stage(s, d, "grants").select("gid", english.alias("en"), french.alias("fr"))


@query
def clean_name(s: SparkSession, d: str) -> DataFrame:
    return stage(s, d, "grants").select(
        "gid", text.clean_name(F.col("recipient_legal_name")).alias("cleaned")
    )


@query
def normalize_names(s: SparkSession, d: str) -> DataFrame:
    df = normalizing.normalize_names(stage(s, d, "grants"))
    added = [c for c in df.columns if c.endswith(("_raw", "_en", "_fr")) and "name" in c]
    return df.select("gid", *[c for c in added if c != "prog_name_en"])


@query
def normalize_business_number(s: SparkSession, d: str) -> DataFrame:
    df = normalizing.normalize_business_numbers(stage(s, d, "grants"))
    return df.select("gid", "bn_raw", "recipient_business_number")


@query
def bn_summary(s: SparkSession, d: str) -> DataFrame:
    return normalizing.bn_summary(stage(s, d, "normalized"))


@query
def normalize_postal_code(s: SparkSession, d: str) -> DataFrame:
    df = normalizing.normalize_postal_codes(stage(s, d, "grants"))
    return df.select("gid", "postal_code_raw", "recipient_postal_code")


@query
def postal_summary(s: SparkSession, d: str) -> DataFrame:
    return normalizing.postal_summary(stage(s, d, "normalized"))


@query
def normalize_ref(s: SparkSession, d: str) -> DataFrame:
    df = normalizing.normalize_refs(stage(s, d, "grants"))
    return df.select("gid", "ref_number_raw", "ref_number")


@query
def ref_whitespace_count(s: SparkSession, d: str) -> DataFrame:
    return normalizing.ref_whitespace_count(stage(s, d, "normalized"))


@query
def blank_to_null(s: SparkSession, d: str) -> DataFrame:
    columns = ["recipient_operating_name", "recipient_business_number", "recipient_type"]
    return normalizing.blank_to_null(stage(s, d, "grants"), columns).select("gid", *columns)


@query
def strip_common_prefixes(s: SparkSession, d: str) -> DataFrame:
    df = normalizing.add_stripped_name(stage(s, d, "normalized"))
    return df.select("gid", "recipient_legal_name_stripped_en")


@query
def prefix_strip_count(s: SparkSession, d: str) -> DataFrame:
    return normalizing.prefix_strip_count(
        normalizing.add_stripped_name(stage(s, d, "normalized"))
    )


@query
def normalize_grants(s: SparkSession, d: str) -> DataFrame:
    return normalizing.normalize_grants(stage(s, d, "grants")).drop(
        "agreement_start_date", "agreement_value"
    )


# Rule labels


@query
def person_name(s: SparkSession, d: str) -> DataFrame:
    return stage(s, d, "normalized").select(
        "gid", person_name_pattern(F.col(NM)).alias("is_person")
    )


@query
def apply_rules(s: SparkSession, d: str) -> DataFrame:
    return classifying.apply_rules(stage(s, d, "normalized")).select("gid", "rule_label")


@query
def classify_with_provenance(s: SparkSession, d: str) -> DataFrame:
    return classifying.classify_with_provenance(stage(s, d, "normalized")).select(
        "gid", "recipient_type_new", "recipient_type_source", "recipient_type_confidence"
    )


@query
def label_fill(s: SparkSession, d: str) -> DataFrame:
    return classifying.label_fill(stage(s, d, "normalized"))


@query
def classification_coverage(s: SparkSession, d: str) -> DataFrame:
    return classifying.classification_coverage(stage(s, d, "classified"))


@query
def label_breakdown(s: SparkSession, d: str) -> DataFrame:
    return classifying.label_breakdown(
        stage(s, d, "classified"), ["recipient_type_source", "recipient_type_new"]
    )


@query
def rule_breakdown(s: SparkSession, d: str) -> DataFrame:
    return classifying.rule_breakdown(stage(s, d, "classified"))


# Verdicts


@query
def residual_contexts(s: SparkSession, d: str) -> DataFrame:
    return enriching.residual_contexts(stage(s, d, "classified"))


@query
def context_values(s: SparkSession, d: str) -> DataFrame:
    return enriching.context_values(stage(s, d, "classified"))


def _prompts(s: SparkSession, d: str) -> DataFrame:
    classified = stage(s, d, "classified")
    return enriching.render_prompt(
        enriching.residual_contexts(classified), enriching.context_values(classified)
    )


@query
def render_prompt(s: SparkSession, d: str) -> DataFrame:
    return _prompts(s, d)


@query
def make_batches(s: SparkSession, d: str) -> DataFrame:
    batches = enriching.make_batches(_prompts(s, d), size=3, hex_digits=1)
    return batches.select(
        "bucket", "batch_no", F.array_join("names", "; ").alias("names"), "prompt"
    )


def rehearsed_scorer(prompt: str) -> enriching.Reply:
    """Stands in for a model: the answer, or the kind of failure, follows from the prompt."""
    if len(prompt) % 5 == 0:
        return enriching.Reply(500, "server error")
    if len(prompt) % 5 == 1:
        return enriching.Reply(200, "no idea")
    return enriching.Reply(200, '```json\n[{"type": "N", "confidence": 0.8}]\n```')


def _no_pause(_: float) -> None:
    return None


@query
def score_batches(s: SparkSession, d: str) -> DataFrame:
    batches = enriching.make_batches(_prompts(s, d), size=1, hex_digits=1)
    scored = enriching.score_batches(batches, rehearsed_scorer, 8, pause=_no_pause)
    return scored.select(
        F.get("names", F.lit(0)).alias("name"), "status", "result_json",
        F.col("attempts").cast("bigint").alias("attempts"),
    )


@query
def verdict_cache(s: SparkSession, d: str) -> DataFrame:
    """The cache holds the names that begin in the first half of the alphabet; those of them
    without an answer are asked again."""
    verdicts = _verdicts(s, d)
    cache = verdicts.filter(F.col(NM) < "m").withColumn("scored", F.lit("before"))
    fresh = F.expr(VERDICT_SQL.format(nm=NM)).alias("llm_result_json")
    return enriching.verdict_cache(
        cache,
        enriching.residual_contexts(stage(s, d, "classified")),
        lambda unseen: unseen.select(NM, fresh, F.lit("now").alias("scored")),
    )


@query
def parse_verdicts(s: SparkSession, d: str) -> DataFrame:
    return enriching.parse_verdicts(_verdicts(s, d))


@query
def scoring_summary(s: SparkSession, d: str) -> DataFrame:
    return enriching.scoring_summary(_verdicts(s, d))


@query
def failure_sample(s: SparkSession, d: str) -> DataFrame:
    return enriching.failure_sample(_verdicts(s, d)).select(NM)


@query
def verdict_distribution(s: SparkSession, d: str) -> DataFrame:
    return enriching.verdict_distribution(parse_verdicts(s, d))


@query
def low_confidence_queue(s: SparkSession, d: str) -> DataFrame:
    return enriching.low_confidence_queue(parse_verdicts(s, d))


@query
def merge_verdicts(s: SparkSession, d: str) -> DataFrame:
    merged = enriching.merge_verdicts(
        stage(s, d, "classified"), parse_verdicts(s, d), row_id="gid"
    )
    return merged.select(
        "gid", "recipient_type", "recipient_type_source", "recipient_type_confidence"
    )


# Linkage


@query
def with_unique_id(s: SparkSession, d: str) -> DataFrame:
    ids = blocking.with_unique_id(stage(s, d, "grants"))
    return ids.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("unique_id").alias("least"),
        F.max("unique_id").alias("greatest"),
        F.count_distinct("unique_id").alias("n_distinct"),
    )


@query
def shard_filter(s: SparkSession, d: str) -> DataFrame:
    return blocking.shard_filter(_linkable(s, d)).select(
        "unique_id", "recipient_type", "recipient_legal_name_stripped_en"
    )


@query
def collapse_profiles(s: SparkSession, d: str) -> DataFrame:
    return blocking.collapse_profiles(stage(s, d, "records")).select("id", "n", "recipient_type")


@query
def block_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = blocking.block_pairs(stage(s, d, "profiles"))
    return _longs(pairs.select("id_l", "id_r", "match_rule", "n_pairs"))


@query
def candidate_totals(s: SparkSession, d: str) -> DataFrame:
    """Record pairs per rule; the SQL counts them record by record."""
    pairs = blocking.candidate_pairs(stage(s, d, "profiles"))
    return _longs(pairs.groupBy("match_rule").agg(F.sum("n_pairs").alias("n_pairs")))


@query
def block_size_report(s: SparkSession, d: str) -> DataFrame:
    return _longs(blocking.block_size_report(stage(s, d, "profiles")))


@query
def jaro_winkler_pairs(s: SparkSession, d: str) -> DataFrame:
    names = value_pairs.value_pairs(stage(s, d, "profiles"), NM)
    scored = names.select("a", "b", jaro_winkler("a", "b").alias("similarity"))
    return _rounded(scored.filter(F.col("similarity").isNotNull()), ["similarity"])


def _levels_of(s: SparkSession, d: str, column: str) -> DataFrame:
    levels = cells.candidate_levels(stage(s, d, "profiles"), column, MODEL)
    return _longs(levels.withColumnRenamed(f"g_{column}", "level"))


@query
def compare_exact(s: SparkSession, d: str) -> DataFrame:
    return _levels_of(s, d, "recipient_city")


@query
def compare_name(s: SparkSession, d: str) -> DataFrame:
    return _levels_of(s, d, "recipient_operating_name_en")


@query
def compare_custom(s: SparkSession, d: str) -> DataFrame:
    return _levels_of(s, d, NM)


@query
def comparison_vectors(s: SparkSession, d: str) -> DataFrame:
    return _longs(cells.candidate_vectors(stage(s, d, "profiles"), MODEL))


@query
def term_frequencies(s: SparkSession, d: str) -> DataFrame:
    parts = [
        comparing.term_frequencies(stage(s, d, "profiles"), c).select(
            "recipient_type", F.lit(c).alias("column"), F.col(c).alias("value"),
            F.round(f"tf_{c}", 9).alias("tf"),
        )
        for c in MODEL.tf_columns
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Training, scoring and clustering


@query
def estimate_prior(s: SparkSession, d: str) -> DataFrame:
    return _rounded(training.estimate_prior(stage(s, d, "profiles")), ["prior"], 9)


@query
def estimate_u(s: SparkSession, d: str) -> DataFrame:
    return _longs(_rounded(training.estimate_u(stage(s, d, "profiles")), ["u"], 9))


@query
def estimate_u_sampled(s: SparkSession, d: str) -> DataFrame:
    return _longs(_rounded(training.estimate_u_sampled(stage(s, d, "records")), ["u"], 9))


@query
def gamma_patterns(s: SparkSession, d: str) -> DataFrame:
    return _longs(_patterns(s, d))


def _fixed_start() -> tuple[dict[str, dict[str, list[float]]], dict[str, float]]:
    """The fixed test parameters: u and the prior by type."""
    u = {c.column: LEVEL_VALUES[len(c.codes)][1] for c in MODEL.comparisons}
    return {shard: u for shard in MODEL.shards}, {shard: PRIOR for shard in MODEL.shards}


@query
def em_round(s: SparkSession, d: str) -> DataFrame:
    """One round from the fixed test parameters."""
    patterns = training.session_patterns(_patterns(s, d))
    m = {c.column: LEVEL_VALUES[len(c.codes)][0] for c in MODEL.comparisons}
    states = {
        (number, shard): training.SessionState(PRIOR, m)
        for number in range(len(MODEL.sessions))
        for shard in MODEL.shards
    }
    table = training.session_frame(s, states, _fixed_start()[0], MODEL)
    result = training.em_round(patterns, table, MODEL)
    result = result.drop("prior", "m", "u", "trained", "rounds", "settled")
    return _longs(_rounded(result, [c for c in result.columns if c not in ("session", "shard")], 4))


def _fixed_training(s: SparkSession, d: str) -> training.EmStates:
    return training.em_train(_patterns(s, d), *_fixed_start())


@query
def em_train(s: SparkSession, d: str) -> DataFrame:
    """Rounds from the fixed test u and prior until each session settles."""
    rows = [
        (session, shard, state.rounds, state.prior, c.column, level, state.m[c.column][level], c.column in state.trained)
        for (session, shard), state in _fixed_training(s, d).items()
        for c in MODEL.comparisons
        for level in c.codes
    ]
    kind = "session long, shard string, rounds long, prior double, comparison string, level long, m double, trained boolean"
    return _rounded(s.createDataFrame(rows, kind), ["prior", "m"])


@query
def combine_sessions(s: SparkSession, d: str) -> DataFrame:
    """m of both sessions together."""
    found = training.combine_sessions(_fixed_training(s, d))
    rows = [
        (shard, column, level, m)
        for shard, columns in found.items()
        for column, shares in columns.items()
        for level, m in enumerate(shares)
    ]
    return _rounded(s.createDataFrame(rows, "shard string, comparison string, level long, m double"), ["m"])


def _params(s: SparkSession, d: str) -> DataFrame:
    return training.train(
        stage(s, d, "records"),
        stage(s, d, "profiles"),
        _patterns(s, d),
    )


STAGES["params"] = _params


def _shown_params(params: DataFrame) -> DataFrame:
    return _longs(_rounded(_rounded(params, ["m"]), ["u", "prior"], 9))


@query
def trained_parameters(s: SparkSession, d: str) -> DataFrame:
    """Prior, u and m by EM over both sessions, combined."""
    return _shown_params(_params(s, d))


@query
def score_pairs(s: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_pairs(_fixed_vectors(s, d), fixed_params(s))
    return scored.select(
        "id_l", "id_r", "n_pairs", F.round("match_weight", 6).alias("match_weight"),
        F.round("match_probability", 5).alias("match_probability"),
    )


def _fixed_clusters(s: SparkSession, d: str) -> DataFrame:
    scored = tables.materialize(
        scoring.score_pairs(_fixed_links(s, d), fixed_params(s)), "scored"
    )
    return linkage.cluster_records(stage(s, d, "records"), stage(s, d, "profiles"), scored)


STAGES["fixed_clusters"] = _fixed_clusters


@query
def cluster_pairs(s: SparkSession, d: str) -> DataFrame:
    """Clusters of profiles from the scored pairs."""
    scored = scoring.score_pairs(_fixed_links(s, d), fixed_params(s))
    return clustering.cluster_pairs(scored, stage(s, d, "profiles").select("id"))


@query
def cluster_records(s: SparkSession, d: str) -> DataFrame:
    """Clusters of records; the SQL scores and clusters record by record."""
    return _fixed_clusters(s, d).select("unique_id", "cluster_id")


@query
def link_with_fixed_parameters(s: SparkSession, d: str) -> DataFrame:
    """The whole linkage with given parameters, unlikely pairs dropped before comparing."""
    labelled = stage(s, d, "classified").drop("recipient_type").withColumnsRenamed(
        {"recipient_type_new": "recipient_type", "gid": "unique_id"}
    )
    linked = linkage.link_and_cluster(labelled, params=fixed_params(s)).clusters
    return linked.select("unique_id", "cluster_id")


@query
def reachable_pairs(s: SparkSession, d: str) -> DataFrame:
    """Scores of the pairs that the best case does not rule out: the same as of all pairs."""
    carry = comparing.tf_carried(MODEL)
    pairs = blocking.copy_pairs(stage(s, d, "weighed"), MODEL, carry)
    inside = comparing.comparison_vectors(scoring.reachable_pairs(pairs, fixed_params(s)), MODEL, carry)
    between = cells.reachable_vectors(stage(s, d, "weighed"), fixed_params(s), MODEL, carry)
    scored = scoring.score_pairs(between.unionByName(inside), fixed_params(s))
    return scored.select(
        "id_l", "id_r", "n_pairs", F.round("match_weight", 6).alias("match_weight"),
        F.round("match_probability", 5).alias("match_probability"),
    )


@query
def assign_cluster_ids(s: SparkSession, d: str) -> DataFrame:
    dense = clustering.assign_cluster_ids(stage(s, d, "fixed_clusters"), dense=True)
    return dense.select("unique_id", "cluster_id")


@query
def shard_report(s: SparkSession, d: str) -> DataFrame:
    return clustering.shard_report(_linkable(s, d), stage(s, d, "fixed_clusters"))


@query
def linkage_totals(s: SparkSession, d: str) -> DataFrame:
    return clustering.linkage_totals(_linkable(s, d), stage(s, d, "fixed_clusters"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    labelled = stage(s, d, "classified").drop("recipient_type").withColumnsRenamed(
        {"recipient_type_new": "recipient_type", "gid": "unique_id"}
    )
    return linkage.link_and_cluster(labelled).clusters


STAGES["linked"] = _linked


@query
def link_and_cluster(s: SparkSession, d: str) -> DataFrame:
    """The whole linkage with trained parameters."""
    return stage(s, d, "linked").select("unique_id", "cluster_id", "recipient_type", NM)


# Verification


@query
def attach_attributes(s: SparkSession, d: str) -> DataFrame:
    clusters = stage(s, d, "true_clusters").select("unique_id", "cluster_id", "recipient_type")
    records = stage(s, d, "normalized").withColumnRenamed("gid", "unique_id")
    return verifying.attach_attributes(
        clusters, records, ["recipient_type", "recipient_city", "owner_org", "not_there"]
    )


@query
def cluster_overview(s: SparkSession, d: str) -> DataFrame:
    return verifying.cluster_overview(stage(s, d, "true_clusters"))


@query
def cluster_size_histogram(s: SparkSession, d: str) -> DataFrame:
    return verifying.cluster_size_histogram(stage(s, d, "true_clusters"))


@query
def cluster_size_buckets(s: SparkSession, d: str) -> DataFrame:
    return _longs(verifying.cluster_size_buckets(stage(s, d, "true_clusters")))


@query
def largest_clusters(s: SparkSession, d: str) -> DataFrame:
    return verifying.largest_clusters(stage(s, d, "true_clusters"))


@query
def largest_cluster_detail(s: SparkSession, d: str) -> DataFrame:
    return verifying.largest_cluster_detail(
        stage(s, d, "true_clusters"), 20, ["cluster_id", "unique_id", NM, "recipient_type"]
    )


@query
def cross_type_clusters(s: SparkSession, d: str) -> DataFrame:
    return verifying.cross_type_clusters(stage(s, d, "true_clusters"))


@query
def cross_type_summary(s: SparkSession, d: str) -> DataFrame:
    return verifying.cross_type_summary(stage(s, d, "true_clusters"))


@query
def cross_type_detail(s: SparkSession, d: str) -> DataFrame:
    return verifying.cross_type_detail(
        stage(s, d, "true_clusters"), 10, columns=["cluster_id", "unique_id", "recipient_type"]
    )


@query
def cross_type_after_linking(s: SparkSession, d: str) -> DataFrame:
    """Linking works within a type, so none of its clusters mixes types."""
    return verifying.cross_type_summary(stage(s, d, "fixed_clusters"))


@query
def reduction_by_type(s: SparkSession, d: str) -> DataFrame:
    return verifying.reduction_by(stage(s, d, "true_clusters"), "recipient_type")


@query
def reduction_by_owner(s: SparkSession, d: str) -> DataFrame:
    return verifying.reduction_by(stage(s, d, "true_clusters"), "owner_org", 30)


@query
def entity_search(s: SparkSession, d: str) -> DataFrame:
    return verifying.entity_search(stage(s, d, "true_clusters"), "town of b").select(
        "cluster_id", "unique_id", NM
    )


@query
def search_counts(s: SparkSession, d: str) -> DataFrame:
    return verifying.search_counts(stage(s, d, "true_clusters"), "town of b")


@query
def sample_clusters(s: SparkSession, d: str) -> DataFrame:
    return verifying.sample_clusters(
        stage(s, d, "true_clusters"), columns=["cluster_id", "unique_id", NM]
    )


# Canonical names


@query
def most_frequent(s: SparkSession, d: str) -> DataFrame:
    df = stage(s, d, "true_clusters")
    legal = canonical.most_frequent(df, ["cluster_id"], "recipient_legal_name", count_null=True)
    research = canonical.most_frequent(df, ["cluster_id"], "research_organization_name")
    return legal.join(research, "cluster_id", "left")


@query
def canonical_entities(s: SparkSession, d: str) -> DataFrame:
    return _rounded(canonical.canonical_entities(stage(s, d, "true_clusters")), ["total_funding"], 2)


@query
def canonical_grants(s: SparkSession, d: str) -> DataFrame:
    """From raw grants to one name per linked entity."""
    return _rounded(canonical.canonical_entities(stage(s, d, "linked")), ["total_funding"], 2)


@query
def entities_from_csv(s: SparkSession, d: str) -> DataFrame:
    """The whole flow: a CSV export, read once, through written steps to one name per entity."""
    path = _scratch(s, "flow")
    source = stage(s, d, "grants").withColumn("agreement_start_date", F.col("agreement_start_date").cast("date"))
    source.write.options(
        header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(f"{path}/csv")
    made = grants_flow.grants_from_csv(s, f"{path}/csv", source.columns, f"{path}/tables", "1", key="gid")
    return _rounded(made["canonical_names"], ["total_funding"], 2)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Raw grants through normalising, labelling, linking and naming."""
    names, _ = grants_flow.canonical_grants(stage(s, d, "grants"), "gid")
    return _rounded(names, ["total_funding"], 2)
