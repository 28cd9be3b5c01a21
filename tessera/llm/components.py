"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Table

#: More rounds than any graph of fewer than 2**60 nodes needs.
MAX_ROUNDS = 120


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are hung on its smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (long columns u, v).

    Alternating large and small stars: every round is two keyed minima and two
    equi-joins, so a hub with a third of all edges is pre-aggregated by the
    minima and split by the skew join. Rounds are written to the shared folder.

    Returns (node, component) for every node with an edge to another one;
    component is the smallest node of its component. Null ends and loops are
    ignored; repeated edges count once; no edges give no rows.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = Table(start.distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        after = Table(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = after
    else:
        raise RuntimeError("the components did not settle")
    leaves = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
