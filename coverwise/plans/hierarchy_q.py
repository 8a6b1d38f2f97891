"""Hierarchy roll-up (C3) over the hierarchy the driver tables hold:
region -> nation -> customer, with order facts pre-aggregated per customer."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as hi
from ..sources import tables
from .catalog import query

EDGES_SQL = """
SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS node, CAST(NULL AS VARCHAR) AS parent,
       'region' AS level, r_name AS name FROM region
UNION ALL
SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'nation', n_name FROM nation
UNION ALL
SELECT 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR), 'customer', c_name
FROM customer"""


def edges(spark, sf_dir):
    r = tables.read_table(spark, sf_dir, "region")
    n = tables.read_table(spark, sf_dir, "nation")
    c = tables.read_table(spark, sf_dir, "customer")
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (r.select(key("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"),
                     F.lit("region").alias("level"), F.col("r_name").alias("name"))
            .unionByName(n.select(key("N", "n_nationkey").alias("node"), key("R", "n_regionkey").alias("parent"),
                                  F.lit("nation").alias("level"), F.col("n_name").alias("name")))
            .unionByName(c.select(key("C", "c_custkey").alias("node"), key("N", "c_nationkey").alias("parent"),
                                  F.lit("customer").alias("level"), F.col("c_name").alias("name"))))


@query("hierarchy_rollup", f"""
WITH RECURSIVE edges AS ({EDGES_SQL}),
clos(node, ancestor, depth) AS (
  SELECT node, node, 0 FROM edges
  UNION ALL
  SELECT c.node, e.parent, c.depth + 1 FROM clos c JOIN edges e ON e.node = c.ancestor
  WHERE e.parent IS NOT NULL),
facts AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS node, count(*) AS n_orders,
                 sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
leaves AS (SELECT c.node, c.ancestor FROM clos c JOIN edges e USING (node) WHERE e.level = 'customer')
SELECT l.ancestor AS node, e.level, e.name, count(*) AS n_customers,
       CAST(coalesce(sum(f.n_orders), 0) AS BIGINT) AS n_orders,
       round(coalesce(sum(f.total), 0.0), 2) AS total_price
FROM leaves l LEFT JOIN facts f USING (node) JOIN edges e ON e.node = l.ancestor
GROUP BY l.ancestor, e.level, e.name""", ops=("C3",))
def q_hierarchy_rollup(spark, sf_dir):
    e = edges(spark, sf_dir)
    clos = hi.closure(e, max_depth=8)
    leaves = clos.join(e.where(F.col("level") == "customer").select("node"), "node", "left_semi")
    # facts pre-aggregated per customer before the closure join
    facts = (tables.read_table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
             .select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node"),
                     "n_orders", "total"))
    rolled = hi.rollup(facts, leaves, [F.count(F.lit(1)).alias("n_customers"),
                                       F.coalesce(F.sum("n_orders"), F.lit(0)).cast("long").alias("n_orders"),
                                       F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total_price")])
    return rolled.join(e.select(F.col("node").alias("ancestor"), "level", "name"), "ancestor").select(
        F.col("ancestor").alias("node"), "level", "name", "n_customers", "n_orders", "total_price")
