"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), written; the component is its smallest node.

    Large-star and small-star rounds alternate until the edges are stars, that is
    until no node is both an end and a centre; each round is written, so lineage
    stays short, and nothing but that answer reaches the driver. The rows of a
    node with very many neighbours are joined with one row, which adaptive
    execution splits.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stars = now.isEmpty()
    while not stars:
        now = materialize(_small_star(_large_star(now)), "edges")
        stars = now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(found.union(found.select(F.col("component").alias("node"), "component").distinct()), "components")
