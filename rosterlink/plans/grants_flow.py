"""The whole way from a raw grants table to one name per entity.

Each step hands a written table to the next, as separate jobs would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.operators.blocking import with_unique_id
from rosterlink.operators.canonical import canonical_entities
from rosterlink.operators.classifying import classify_with_provenance
from rosterlink.operators.clustering import linkage_totals, shard_report
from rosterlink.operators.enriching import (
    Reply,
    bucket_digits,
    context_values,
    make_batches,
    merge_verdicts,
    parse_verdicts,
    render_prompt,
    residual_contexts,
    score_batches,
    score_in_waves,
    verdict_cache,
    verdict_rows,
)
from rosterlink.operators.normalizing import normalize_grants
from rosterlink.plans.linkage import Linkage, link_and_cluster
from rosterlink.sources.results import read_snapshot, save_model, snapshot_verdicts
from rosterlink.sources.tables import Steps, materialize, owned_intermediates, read_grants_csv


def normalized_table(raw: DataFrame) -> DataFrame:
    return materialize(normalize_grants(raw), "normalized")


def labelled_table(
    normalized: DataFrame,
    row_id: str,
    score_fn: Callable[[str], Reply] | None = None,
    batch_size: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Labels by rules, then by the scorer where one is given."""
    classified = materialize(classify_with_provenance(normalized), "classified")
    if score_fn is None:
        label = "recipient_type"
        return classified.drop(label).withColumnRenamed(f"{label}_new", label)
    contexts = materialize(residual_contexts(classified), "contexts")
    verdicts = materialize(
        _verdicts(classified, contexts, score_fn, batch_size, partitions), "verdicts"
    )
    parsed = parse_verdicts(verdicts, position="position")
    return materialize(merge_verdicts(classified, parsed, row_id), "labelled")


def _verdicts(
    classified: DataFrame,
    contexts: DataFrame,
    score_fn: Callable[[str], Reply],
    batch_size: int,
    partitions: int | None,
) -> DataFrame:
    """One row per name of ``contexts``, as the scorer answers."""
    prompts = render_prompt(contexts, context_values(classified))
    batches = make_batches(prompts, batch_size, hex_digits=bucket_digits(contexts.count()))
    return verdict_rows(score_batches(batches, score_fn, partitions))


def canonical_grants(
    raw: DataFrame, row_id: str, score_fn: Callable[[str], Reply] | None = None
) -> tuple[DataFrame, Linkage]:
    """Canonical names and totals, and the linkage behind them."""
    labelled = labelled_table(normalized_table(raw), row_id, score_fn)
    linkage = link_and_cluster(labelled.withColumnRenamed(row_id, "unique_id"))
    return canonical_entities(linkage.clusters), linkage


def grants_from_csv(
    spark: SparkSession,
    csv: str,
    columns: list[str],
    folder: str,
    run_ts: str,
    score_fn: Callable[[str], Reply] | None = None,
    scorer: str = "",
    endpoint: str = "",
    cached: bool = False,
    batch_size: int = 1,
    partitions: int | None = None,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """From a CSV export to named tables under ``folder``, one per step.

    The CSV is read once, and each step reads what the one before has written. A run that broke
    off goes on after its last finished step when it is started again with the same
    ``run_ts``; answers of the scorer are kept wave by wave. Other intermediates are removed at
    the end. ``key`` names a column with a unique number for each record, to be its id.

    ``raw_grants``, ``normalized_grants``, ``rule_labels``, ``classified_grants``,
    ``entity_clusters`` (by type), ``shard_report``, ``linkage_totals``, ``canonical_names``; also
    ``verdicts`` (a snapshot per run and the latest) and ``model`` (the trained parameters).
    With ``cached``, verdicts of the latest snapshot are used again and only names without an
    answer are asked.
    """

    steps = Steps(spark, folder, run_ts)
    label, new = "recipient_type", "recipient_type_new"
    with owned_intermediates(spark):

        def read() -> DataFrame:
            raw = with_unique_id(read_grants_csv(spark, csv, columns), key)
            return raw.withColumn("agreement_value", F.col("agreement_value").try_cast("double"))

        raw = steps.table("raw_grants", read)
        normalized = steps.table("normalized_grants", lambda: normalize_grants(raw))
        rules = steps.table("rule_labels", lambda: classify_with_provenance(normalized))

        def score(unseen: DataFrame) -> DataFrame:
            prompts = render_prompt(unseen, context_values(rules))
            batches = make_batches(prompts, batch_size, hex_digits=bucket_digits(unseen.count()))
            answers = f"{folder}/scoring/run_ts={run_ts}"
            return verdict_rows(
                score_in_waves(batches, score_fn, answers, run_ts, partitions=partitions)
            )

        def ask() -> None:
            contexts = materialize(residual_contexts(rules), "contexts")
            if cached:
                known = read_snapshot(spark, f"{folder}/verdicts")
                known = known.drop("success", "backup_created_at", "model", "openai_base_url", "run_ts")
                verdicts = verdict_cache(known, contexts, lambda x: score(materialize(x, "unseen")))
            else:
                verdicts = materialize(score(contexts), "verdicts")
            snapshot_verdicts(verdicts, f"{folder}/verdicts", run_ts, scorer, endpoint)

        def labelled() -> DataFrame:
            if score_fn is None:
                return rules.drop(label).withColumnRenamed(new, label)
            steps.do("verdicts", ask)
            verdicts = read_snapshot(spark, f"{folder}/verdicts", run_ts)
            return merge_verdicts(rules, parse_verdicts(verdicts, position="position"), "unique_id")

        classified = steps.table("classified_grants", labelled)

        def linked() -> DataFrame:
            linkage = link_and_cluster(classified)
            save_model(linkage.params, f"{folder}/model")
            return linkage.clusters

        clusters = steps.table("entity_clusters", linked, [label])
        return {
            "classified_grants": classified,
            "entity_clusters": clusters,
            "shard_report": steps.table("shard_report", lambda: shard_report(classified, clusters)),
            "linkage_totals": steps.table("linkage_totals", lambda: linkage_totals(classified, clusters)),
            "canonical_names": steps.table("canonical_names", lambda: canonical_entities(clusters)),
        }
