"""Connected components by joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import rows_of
from .common import Stages


def connected_components(edges: DataFrame, stages: Stages, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    In a large-star round each node's larger neighbours link to the smallest of its neighbours and
    itself; in a small-star round its smaller ones do. Minima are aggregated map-side, and edges
    meet their node's minimum in a join that adaptive execution may split, so a node of very many
    edges is no single task's. Every round is written to the shared folder. It ends when the edges are
    stars, which one aggregate tells: no node has two smaller ones, or a smaller and a larger one.
    """
    at = stages.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        ends = at.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(at.select("v", F.lit(0), F.lit(1)))
        between = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if between.isEmpty():
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
        both = at.union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stages.save(large, "large_star", 2 * rows_of(at))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stages.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small_star", 2 * rows_of(large))
        stages.drop(at)
        stages.drop(large)
        at = following
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
