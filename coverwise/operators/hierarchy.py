"""Hierarchies as parent-child tables (C3): ancestor closure and roll-ups.

A hierarchy (chapter -> category -> code in the reference's design; any
parent-child table here) is an edge list (node, parent). Its closure pairs
every node with itself (depth 0) and with each ancestor. It is built level by
level: the frontier (node, ancestor, depth) is equi-joined to the edges on
``ancestor = node`` to step one level up, and each level is written to the
shared checkpoint folder, so lineage stays one join deep and the emptiness
test that ends the loop reads a written table. A hot parent (one node with a
third of all children) is a skewed join key that AQE's skew join splits.

Facts roll up to every ancestor with one join on the node and a partial
aggregation per ancestor; callers pre-aggregate facts per leaf first, so the
join carries one row per leaf, not one per fact row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, node: str = "node", parent: str = "parent",
            max_depth: int = 32) -> DataFrame:
    """(node, ancestor, depth) for every node and each of its ancestors, itself included.

    Raises ValueError when some path is longer than ``max_depth`` (a cycle or
    a deeper hierarchy than declared), instead of returning a partial closure.
    """
    from ..session import materialize
    e = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    up = e.where(F.col("parent").isNotNull()).select(F.col("node").alias("ancestor"),
                                                     F.col("parent").alias("next"))
    levels = [e.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))]
    frontier = materialize(up.select(F.col("ancestor").alias("node"), F.col("next").alias("ancestor"),
                                     F.lit(1).alias("depth")), "hier_level")
    depth = 1
    while not frontier.isEmpty():
        if depth > max_depth:
            raise ValueError(f"hierarchy deeper than max_depth={max_depth} (or cyclic)")
        levels.append(frontier)
        frontier = materialize(frontier.join(up, "ancestor").select(
            "node", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")), "hier_level")
        depth += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def rollup(facts: DataFrame, clos: DataFrame, aggs: list[Column], node: str = "node") -> DataFrame:
    """Aggregate ``facts`` (keyed by ``node``) to every ancestor: (ancestor, aggs...)."""
    j = clos.join(facts.withColumnRenamed(node, "node"), "node", "left")
    return j.groupBy("ancestor").agg(*aggs)
