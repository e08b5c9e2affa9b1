"""The match weight is worked out once for each pair."""

import math

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.fixed import PRIOR, LEVEL_VALUES, fixed_params
from rosterlink.operators import comparing, scoring

MODEL = queries.MODEL
TF = 0.25


def vectors(spark, rows):
    """Level vectors of type N with one rarity for all values."""
    kinds = "recipient_type string, id_l long, " + ", ".join(f"{g} int" for g in MODEL.gammas)
    made = spark.createDataFrame([("N", n, *levels) for n, levels in enumerate(rows)], kinds)
    return made.withColumns({c: F.lit(TF) for c in comparing.tf_carried(MODEL)})


def plain_weight(levels):
    weight = math.log2(PRIOR / (1 - PRIOR))
    for c, level in zip(MODEL.comparisons, levels):
        if level is None or level < 0:
            continue
        m, u = LEVEL_VALUES[len(c.codes)]
        weight += math.log2(m[level] / u[level])
        if level == 0 and c.term_frequency:
            weight += math.log2(u[0] / TF)
    return weight


def test_weights_against_plain_sums(spark):
    rows = [[min(n, len(c.codes) - 1) for c in MODEL.comparisons] for n in range(6)]
    rows += [[-1] * 7, [0, -1, 4, -1, 1, 0, -1], [None, 0, None, 1, 0, None, 3]]
    scored = scoring.score_pairs(vectors(spark, rows), fixed_params(spark), MODEL, 0.0)
    found = {r["id_l"]: r for r in scored.collect()}
    assert len(found) == len(rows)
    for n, levels in enumerate(rows):
        assert found[n]["match_weight"] == pytest.approx(plain_weight(levels), abs=1e-9)
        assert found[n]["match_probability"] == pytest.approx(1 / (1 + 2 ** -plain_weight(levels)), abs=1e-12)


def test_weight_is_worked_out_once(spark):
    """Written out again in filter and columns it outgrows what the JVM compiles."""
    scored = scoring.score_pairs(vectors(spark, [[0] * 7]), fixed_params(spark), MODEL)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2((u_") == len(MODEL.tf_columns)


@pytest.mark.parametrize("lacking", ["shard = 'N'", "comparison = 'recipient_city' and level = 0"])
def test_lacking_parameters_fail_when_scored(spark, lacking):
    part = fixed_params(spark).filter(f"not ({lacking})")
    with pytest.raises(Exception, match="no parameters for a pair of shard N"):
        scoring.score_pairs(vectors(spark, [[0] * 7]), part, MODEL).collect()
