"""Connected components of an undirected graph, with the corpus operators' scratch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from (a, b): root is the smallest node that a node can reach. Nodes without edges aren't there."""
    return graph.components(edges, stored)
