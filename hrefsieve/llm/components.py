"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, small
from hrefsieve.session import cut_counted


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _neighbours(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The smallest neighbour of each node, and is the graph made of stars about their smallest nodes?

    It is if no node with a smaller neighbour has another one. Written, so that joins on a
    hub are broadcast or can be split; the same write tells about stars.
    """
    least = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
    least, seen = cut_counted(least, "least", crossed=F.count_if((F.col("m") < F.col("u")) & (F.col("links") > 1)))
    return least.select("u", "m"), not seen["crossed"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component = smallest node reachable.

    Each round links a node's larger neighbours, then its smaller ones, to its smallest
    neighbour. Edges shrink to one per node in a number of rounds that grows with the
    logarithm of a component's width. A round takes three shuffles. Nothing but two
    numbers a round reaches the driver.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    least, stars = _neighbours(e)
    while not stars:
        large = _both_ways(e).join(small(least), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut(large, "large")  # a row for each edge
        least = small(cut(large.groupBy("u").agg(F.min("v").alias("m")), "least"))
        pointed = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(pointed.where("u > v").distinct(), "small")
        least, stars = _neighbours(e)
    return least.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
