"""Connected components as joins and aggregations over an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): after each pair of steps every node's edges lead to smaller nodes, and the table
shrinks towards one star per component. The number of rounds grows with the logarithm of the largest
component, not with its diameter, and no step gathers a component in one place: minima are
aggregated (partially before the shuffle) and joined back, those of hubs without a shuffle by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool, told_join

def _least(edges: DataFrame) -> DataFrame:
    """(a, m, n): the least neighbour of each node and the number of its edges; partial minima come before the shuffle."""
    return spool(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = told_join(both, _least(both), "a", "n").where("b > a")
    return told.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from larger to smaller; a node's smaller neighbours are linked to the smallest."""
    least = _least(edges)
    hung = told_join(edges, least, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Size and content of an edge table in two numbers that do not depend on row order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: the smallest node it reaches, itself included.

    ``a`` and ``b`` have one ordered type. Null ends and self-links link nothing; a node that has
    only self-links does not appear. An empty table gives an empty result. Rounds go on until nothing changes.
    """
    kept = edges.where("a is not null and b is not null and a <> b")
    now = spool(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, before = _mark(now), None
    while mark[0] and mark != before:
        stars = spool(_large_star(now), "links")
        then = spool(_small_star(stars), "links")
        before, mark = mark, _mark(then)
        drop_spool(now)
        drop_spool(stars)
        now = then
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
