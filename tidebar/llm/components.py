"""Connected components of a table of links, by alternating large-star and small-star rounds.

Least neighbours are aggregates, combined before the shuffle; where they go back to the links of a hub, it is a plain join,
whose hot keys Spark's adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """m, the least of u and its neighbours; groupBy pre-aggregates, so a hub's rows don't meet in one task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_least_neighbour(both), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = down.join(_least_neighbour(down), "u")
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one edge, to a v that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    seen = ends.groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
    return seen.where((F.col("from") > 1) | ((F.col("from") == 1) & (F.col("to") == 1))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """u and v, the least node of u's component, for every node of links (u, v: not null, same type) but the least.

    Rounds follow until every node points at a root, and no root at anything. Each is written to the shared folder,
    so lineage doesn't grow. Repeated links and links of a node with itself are allowed; an empty table gives none.
    """
    edges = keep(_small_star(links.where("u != v").select("u", "v")))
    while not _settled(edges):
        large = keep(_large_star(edges))
        small = keep(_small_star(large))
        forget(edges, large)
        edges = small
    return edges
