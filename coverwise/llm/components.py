"""Connected components by alternating stars, every round a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _toward_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and u's neighbours. Minima are summed before the
    shuffle; the join back is one whose skewed partitions are split at run time."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its smallest node.

    Large stars hang a node's larger neighbours on the smallest; small stars hang all smaller
    neighbours and the node itself there. Rounds needed grow with the logarithm of the largest
    component's diameter.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = save(e, "star-edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        near = _toward_min(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        new = save(small.where("u > v").distinct(), "star-edges")
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        forget(e)
        e = new
        if mark == seen:
            break
        seen = mark
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
