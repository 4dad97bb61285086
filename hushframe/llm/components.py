"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each node's neighbours (large: the larger ones; small: the smaller ones and itself) to the least of them."""
    if both_ways:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    d = near.join(least, F.col("a") == F.col("n"))
    if both_ways:
        out = d.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = d.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable, for each node from which edges (a, b) reach a lesser one.

    Both steps keep connectivity and shrink towards stars; they end when nothing changes. A node with very many edges is
    aggregated before it shuffles and joined in splits. Rows with a null or a loop are no edges.
    """
    e = cut(edges.select("a", "b").where("a <> b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    mark = None
    for _ in range(most_rounds):
        e = cut(_star(_star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
    raise RuntimeError(f"no components after {most_rounds} rounds")
