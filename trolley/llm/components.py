"""Connected components by joins, for edge lists of any size.

Alternates the large-star and small-star steps: every node hands its larger
(then its smaller-or-equal) neighbours to the smallest node it knows, until
each component is a star around its smallest member. Each step is one grouped
minimum and one join, so no neighbourhood is ever gathered in a row; the number
of rounds grows with the logarithm of the longest path. Edges that are such stars
already need no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def _star(edges: DataFrame, large: bool, stages: Stages) -> DataFrame:
    """edges: (u, v), u > v. One large-star or small-star step."""
    near = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    low = near.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("m", "n").alias("m"))
    # Written first: of a join of two plain shuffles Spark can split the hot keys (centres of large stars).
    low = stages.put(low)
    moved = near.join(low, "n").where(F.col("w") != F.col("m"))
    if large:
        moved = moved.where(F.col("w") > F.col("n")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(
            low.where(F.col("n") != F.col("m")).select(F.col("n").alias("u"), F.col("m").alias("v"))
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, which has none itself."""
    sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    nodes = sides.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component): smallest node reachable from every node that has an edge.

    edges: two columns (a, b) of bigint, in any order, repeats and loops allowed.
    """
    now = stages.put(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    while not _all_stars(now):
        now = stages.put(_star(stages.put(_star(now, True, stages)), False, stages))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
