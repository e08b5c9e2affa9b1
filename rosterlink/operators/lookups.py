"""Left join to a table that holds each key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df LEFT JOIN lookup``: the columns of ``df``, then the further ones of ``lookup``.

    A plain join on purpose: both sides are dealt out for this join alone, so adaptive
    execution sees a key with very many rows and splits it, or broadcasts a lookup that
    turns out small.
    """
    values = [c for c in lookup.columns if c not in on]
    return df.join(lookup, list(on), "left").select(*df.columns, *values)
