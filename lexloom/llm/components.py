"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and map-side combined minima; nothing is gathered per node, and the lineage of each round
is cut through reliable storage. Rounds end when the edges are stars, which one aggregation tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import durable, release


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges u > v has one edge down, or only edges up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.filter("down + up > 1 and down > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbourhood; edges may repeat."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u").filter("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from u down to v < u; u and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` with longs in, ``(node, root)`` out; root is the smallest node; roots list themselves too."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges)
    while not _are_stars(edges):
        edges = durable(_small_star(_large_star(edges)))
    release(edges.sparkSession)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
