"""Connected components of an edge table, by alternating large-star and small-star steps. All edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.core import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each vertex's larger neighbours to the smallest vertex of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each vertex and its smaller neighbours to the smallest of these; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars around the smallest vertices: each vertex has either one edge down, or edges from above alone."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(u, component): the smallest vertex that each vertex with an edge can reach, for vertices other than that one.

    edges has columns u and v in any order. Both steps keep the components, and they are repeated until the edges are
    stars around the smallest vertices. The number of rounds grows with the logarithm of the vertices; running out of them raises an error.
    """
    edges = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for i in range(1, rounds):
        if _settled(edges):
            return edges.select("u", F.col("v").alias("component"))
        edges = scratch.keep(_small_star(_large_star(edges)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
