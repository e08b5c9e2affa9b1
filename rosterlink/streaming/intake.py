"""Normalising and rule labels on a stream.

Both steps look at one row at a time, so the same functions serve a streaming DataFrame;
nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rosterlink.operators.classifying import classify_with_provenance
from rosterlink.operators.normalizing import normalize_grants


def labelled_stream(raw: DataFrame) -> DataFrame:
    return classify_with_provenance(normalize_grants(raw))


def append_labelled(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table and stops; run it again for more."""
    return (
        labelled_stream(raw)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
