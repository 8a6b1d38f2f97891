"""Hierarchy closure and roll-up (C3) against a hand-computed tree."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coverwise.operators import hierarchy as hi


def _edges(spark, rows):
    return spark.createDataFrame(rows, "node string, parent string")


def test_closure_pairs_every_node_with_its_ancestors(spark):
    e = _edges(spark, [("ch", None), ("cat1", "ch"), ("cat2", "ch"), ("a", "cat1"), ("b", "cat1"),
                       ("c", "cat2")])
    got = {(r["node"], r["ancestor"], r["depth"]) for r in hi.closure(e).collect()}
    want = {(n, n, 0) for n in ("ch", "cat1", "cat2", "a", "b", "c")} | {
        ("cat1", "ch", 1), ("cat2", "ch", 1), ("a", "cat1", 1), ("b", "cat1", 1), ("c", "cat2", 1),
        ("a", "ch", 2), ("b", "ch", 2), ("c", "ch", 2)}
    assert got == want


def test_rollup_sums_leaf_facts_to_every_ancestor(spark):
    e = _edges(spark, [("ch", None), ("cat1", "ch"), ("cat2", "ch"), ("a", "cat1"), ("b", "cat1"),
                       ("c", "cat2")])
    facts = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "node string, x double")
    got = {r["ancestor"]: r["s"] for r in
           hi.rollup(facts, hi.closure(e), [F.sum("x").alias("s")]).collect()}
    assert got == {"ch": 7.0, "cat1": 3.0, "cat2": 4.0, "a": 1.0, "b": 2.0, "c": 4.0}


def test_cycle_is_reported_not_truncated(spark):
    e = _edges(spark, [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError, match="max_depth"):
        hi.closure(e, max_depth=4)
