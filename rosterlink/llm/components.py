"""Connected components of links between documents or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rosterlink.operators.clustering import connected_components
from rosterlink.sources.tables import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links (a, b)``, written out; the component is its
    least node. A node of very many links is no burden, and no lineage is left."""
    return materialize(connected_components(links), "components")
