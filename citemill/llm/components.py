"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and a grouped minimum with map-side partial results; a hub's edges are
dealt over several tasks. The edges are written to the shared folder after each round, and
only a count and a checksum reach the driver. Loops and repeated edges do no harm; null ends
are left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of each node are linked to the smallest node of the star instead."""
    seen = _both(edges) if large else edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
    joined = keyed_join(seen, least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the smallest node of its component) for every node with an edge to another node; edges has columns a and b."""
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        mark = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before or mark[0] == 0:
            break
        before, state = mark, written(_stars(_stars(state, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b"), F.col("b"))).distinct()
