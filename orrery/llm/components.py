"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def _least(edges: DataFrame) -> DataFrame:
    """u, v with the least neighbour (or u itself) of u. Minima are taken in each task first, and a node of very many edges can be split in the join."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs. Gives (node, component) for every node with an edge; the component is its least node."""
    tidy = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = spill(tidy, "components")
    seen = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == seen:
            break
        seen = print_
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large = spill(large, "components")
        star = _least(large)  # u > v throughout: the small neighbours
        small = star.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(star.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        now = spill(small, "components")
    # Every edge now leads from a node to the least of its component.
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
