"""Connected components of a graph too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) -> node, root: the smallest node that each node reaches. Nodes without edges aren't there.

    Minima are aggregated before they are shuffled and joined back, many rows to one; the minima of much linked
    nodes are broadcast (see meet), so no task holds all neighbours of a node. Each round is written to the shared
    folder, which cuts lineage; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), name)
        large = meet(both.filter("b > a"), least, "a", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        small = meet(large, least, "a", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), name)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """What is equal for equal sets of edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)
