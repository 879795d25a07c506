"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is stored, so a lost executor repeats one round at most.  The minimum of a node's neighbours is combined in
the map tasks; the join back on a hub is a plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ordered.groupBy("u").agg(F.min("v").alias("m"))
    hung = ordered.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); the component is its smallest node."""
    stars = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(stars)
    while state[0]:
        stars = materialise(_small_star(_large_star(stars)), "stars")
        state, before = _state(stars), state
        if state == before:
            break
    ends = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
