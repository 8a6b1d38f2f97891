"""Rank sketches: stated error, ties, merging, and PSI beside the exact form."""
from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverwise.operators import rank_sketch as rs

DAY = date(2024, 1, 1)     # a Monday


def _frame(spark, days):
    rows = [(DAY + timedelta(days=d), float(v)) for d, vs in days.items() for v in vs]
    return spark.createDataFrame(rows, "day date, v double")


def _points(spark, days, points):
    out = {}
    for r in rs.day_sketches(_frame(spark, days), "v", ["day"], points).collect():
        out.setdefault((r["day"] - DAY).days, []).append((r["v"], r["w"]))
    return out


@pytest.mark.parametrize("points", [8, 32])
def test_rank_error_stays_below_the_bound_with_ties_and_merged_days(spark, points):
    rng = np.random.default_rng(5)
    days = {0: rng.normal(0, 1, 700), 1: np.round(rng.normal(0, 2, 500)), 2: np.r_[np.zeros(400), rng.uniform(-1, 1, 50)],
            3: [1.0, 2.0, 2.0]}
    got = _points(spark, days, points)
    assert all(len(p) <= points and sum(w for _, w in p) == len(days[d]) for d, p in got.items())
    assert sorted(got[3]) == [(1.0, 1), (2.0, 2)]
    for chosen in [(0,), (1,), (2,), (0, 1, 2), (0, 2, 3)]:
        vals = np.concatenate([np.asarray(days[d], float) for d in chosen])
        pts = [p for d in chosen for p in got[d]]
        for x in np.unique(vals):
            miss = (vals <= x).sum() - sum(w for v, w in pts if v <= x)
            assert 0 <= miss < len(vals) / points


def test_edges_lie_within_the_rank_error(spark):
    rng = np.random.default_rng(9)
    days = {d: rng.normal(d, 3, 400) for d in range(5)}
    p = rs.day_sketches(_frame(spark, days), "v", ["day"], 40).withColumn("window", F.lit(1))
    e = rs.window_edges(p, "window").first()
    vals = np.sort(np.concatenate(list(days.values())))
    assert e["n_reference"] == len(vals) and len(e["edges"]) == 11
    for i, edge in enumerate(e["edges"]):
        rank = np.searchsorted(vals, edge, side="left")
        assert abs(rank - (len(vals) - 1) * i // 10) <= len(vals) / 40


def test_sliding_psi_beside_the_exact_value(spark):
    rng = np.random.default_rng(3)
    days = {d: rng.normal(0.25 if d < 28 else 0.31, 0.05, 300) for d in range(35)}
    p = rs.day_sketches(_frame(spark, days), "v", ["day"], 100).withColumn("week", F.date_trunc("week", "day"))
    got = {(r["window"] - DAY).days: r for r in rs.psi_sliding(p, "week", 2).collect()}
    assert sorted(got) == [0, 7, 14, 21, 28]
    assert (got[0]["psi"], got[0]["severity"], got[0]["n_reference"]) == (0.0, "stable", 0)
    assert got[7]["n_reference"] == 2100 and got[14]["n_reference"] == 4200
    for w in (7, 14, 21, 28):
        ref = np.concatenate([days[d] for d in range(max(0, w - 14), w)])
        cur = np.concatenate([days[d] for d in range(w, w + 7)])
        inner = np.quantile(ref, np.linspace(0, 1, 11))[1:-1]
        r, c = (np.bincount(np.searchsorted(inner, x, side="right"), minlength=10) / x.size for x in (ref, cur))
        exact = float(np.sum((c - r) * np.log(c / r)))
        assert abs(got[w]["psi"] - exact) < 0.01 + 0.1 * exact
    assert got[28]["severity"] == "significant"


def test_empty_null_and_constant_values(spark):
    assert rs.psi_sliding(rs.day_sketches(_frame(spark, {}), "v", ["day"]).withColumn("week", F.col("day")), "week", 1).count() == 0
    rows = [(DAY, None), (DAY, 4.0), (DAY + timedelta(days=7), 4.0), (DAY + timedelta(days=7), 5.0)]
    p = rs.day_sketches(spark.createDataFrame(rows, "day date, v double"), "v", ["day"])
    got = [(r["psi"], r["n_reference"], r["n_current"]) for r in rs.psi_sliding(p, "day", 1).orderBy("window").collect()]
    assert got == [(0.0, 0, 1), (0.0, 1, 2)]
