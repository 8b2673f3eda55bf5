"""Connected components of a large edge list, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import large


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node of its neighbourhood."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(large(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of them. Edges point down: u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(large(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def connected_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns u, v of one type); component is the least node reachable.

    `save(df, name)` writes a table to storage that all executors share and reads it back; each round is written, so
    that lineage stays short and a lost executor costs one round at most. Loops and repeated edges do no harm; nulls are dropped.
    The edge list never grows: a round returns at most as many edges as it got.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, last = save(e, "edges"), None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(e.select("v", "v").distinct())
        last = mark
        e = save(_small_star(_large_star(e)), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
