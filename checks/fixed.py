"""Inputs that the queries and their SQL share: test parameters and test verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlink.functions.levels import LinkageModel
from rosterlink.operators.training import PARAMS_SCHEMA

# Invented test parameters, best level first.
CUSTOM = ([0.60, 0.12, 0.10, 0.06, 0.05, 0.07], [0.0005, 0.0005, 0.001, 0.004, 0.054, 0.94])
NAME = ([0.70, 0.10, 0.08, 0.06, 0.06], [0.001, 0.001, 0.004, 0.054, 0.94])
EXACT = ([0.9, 0.1], [0.01, 0.99])
PRIOR = 0.001

LEVEL_VALUES = {6: CUSTOM, 5: NAME, 2: EXACT}

# The answer of a scorer that never saw the name, in all the shapes that answers come in.
VERDICT_SQL = """
CASE length({nm}) % 7
 WHEN 0 THEN concat('{{"type": "', substr('FNPAGSOI', 1 + length({nm}) % 8, 1), '", "confidence": 0.', cast(50 + length({nm}) % 50 AS string), '}}')
 WHEN 1 THEN concat('```json', chr(10), '[{{"type": "N", "confidence": 0.', cast(50 + length({nm}) % 50 AS string), '}}]', chr(10), '```')
 WHEN 2 THEN '[{{"type": "F", "confidence": 0.61}}, {{"type": "O", "confidence": 0.25}}]'
 WHEN 3 THEN '[{{"type": "P", "confidence": "0.55"}}]'
 WHEN 4 THEN 'no idea'
 WHEN 5 THEN NULL
 ELSE concat('```', chr(10), '{{"type": "', substr('FNPAGSOI', 1 + length({nm}) % 8, 1), '", "confidence": 0.75}}', chr(10), '```') END
"""


def fixed_params(spark: SparkSession, model: LinkageModel = LinkageModel()) -> DataFrame:
    rows = []
    for shard in model.shards:
        for c in model.comparisons:
            m, u = LEVEL_VALUES[len(c.codes)]
            rows += [(shard, c.column, k, m[k], u[k], PRIOR) for k in c.codes]
    return spark.createDataFrame(rows, PARAMS_SCHEMA)
