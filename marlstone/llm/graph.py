"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of every node of an undirected edge list.

    ``component`` is the smallest node reachable. Nodes may be of any orderable
    type. Self-loops make a node its own component, null ends are ignored,
    repeated edges count once, and an empty edge list gives an empty result.
    Each round is written to the shared folder; nothing is collected but two
    aggregates a round. The smallest neighbour is found with partial
    aggregation; the join back meets a hub's edges with one row, so adaptive
    execution may cut a hub into parts.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now = written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    loops = now.where("u = v").select("u")
    now, seen = now.where("u != v"), None
    while True:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sides.join(_smallest(sides), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.join(_smallest(large), "u")
        after = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = written(after, "stars")
        mark = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        now = after
        if seen == mark:
            break
        seen = mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return members.unionByName(roots).unionByName(alone.join(members.unionByName(roots), "node", "left_anti"))
