"""Connected components of a graph by alternating large-star and small-star steps.

Every step is two aggregations and a join on a node; nothing gathers a component in one task, and a
hub's edges meet only in a partial minimum. Each round is written to the checkpoint folder, so a
lost executor costs no more than the round it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = _with_least(both)
    return star.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _with_least(down)
    linked = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = star.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for each node with an edge; the component is its least node.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type. Loops are ignored, repeated
    edges count once. ``rounds`` only guards against a fault: a graph that has not settled by then
    raises an error.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        now = settle(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    # Now every node points at the least node of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
