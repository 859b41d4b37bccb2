"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: A node's edges meet its least neighbour in so many parts.
PARTS = 8


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their ``a``. The edges of a hub are dealt over ``PARTS`` tasks, which adaptive execution can split on."""
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<int>")))
    return edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")).join(parts, ["a", "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _with_least(near.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges come as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node that can be reached.

    Loops and repeated edges do no harm; an edge with a null end is left out; no edges give no rows. Each round is
    written to the shared folder, so lineage stays short and a lost executor costs one round at most. Neighbours are
    never gathered in one place: a hub's edges are dealt over ``PARTS`` tasks, and those are split where they are large.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = written(current, "edges"), None
    for _ in range(max_rounds):
        current = written(_small_star(_large_star(current)).distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
