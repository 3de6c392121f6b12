"""Connected components by alternating large-star and small-star rounds; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import Workspace


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its neighbours below are tied to the smallest of these; e has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    below = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each node is tied to one node below that is itself tied to none below; e has u > v and each edge once."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(id, comp) of each node that is not the smallest of its component, from links (a, b); self-links and nulls count for nothing.

    Stars combine by minimum before they are shuffled, so a node with a third of all links does not meet in one task; the
    rounds grow with the logarithm of the longest chain.
    """
    edges = ws.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k = 0
    while not _are_stars(edges):
        k += 1
        edges = ws.keep(_small_star(_large_star(edges)), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
