"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is one ``min`` per node (combined map-side, so a hub costs no more than its rows) and
one join; each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Every node has one edge at most, to a node that has none."""
    heads = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    chained = heads.select("v").join(heads.select(F.col("u").alias("v")), "v", "left_semi")
    return heads.where("v <> last").select("v").union(chained).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, any direction, repeats and loops allowed) -> (node, label).

    ``label`` is the smallest node of the component. Nodes without an edge to another node are
    absent; no edges give no rows. Stops when every component is a star around its label.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        if _all_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select("v", "v").distinct())
