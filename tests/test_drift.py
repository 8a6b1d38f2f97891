"""PSI: bands, invariants, and agreement with an independent single-machine formula."""
from __future__ import annotations

import math

import numpy as np
import pytest

from coverwise.operators import drift


def _brute_psi(ref, cur, bins=10):
    """Independent implementation of the specified PSI (numpy only)."""
    ref, cur = np.asarray(ref, float), np.asarray(cur, float)
    if ref.size == 0 or cur.size == 0:
        return 0.0
    b = max(2, min(bins, ref.size // 5))
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, b + 1)))
    if edges.size < 2:
        return 0.0
    inner = edges[1:-1]
    rb = np.searchsorted(inner, ref, side="right")
    cb = np.searchsorted(inner, cur, side="right")
    m = edges.size - 1
    r = np.maximum(np.bincount(rb, minlength=m) / ref.size, 1e-4)
    c = np.maximum(np.bincount(cb, minlength=m) / cur.size, 1e-4)
    return float(np.sum((c - r) * np.log(c / r)))


def _frames(spark, ref, cur):
    return (spark.createDataFrame([(float(x),) for x in ref], "v double"),
            spark.createDataFrame([(float(x),) for x in cur], "v double"))


def test_stable_for_same_distribution(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.normal(0.25, 0.05, 1000), rng.normal(0.25, 0.05, 1000)
    r = drift.psi(*_frames(spark, ref, cur), "v").first()
    assert r["severity"] == "stable"
    assert abs(r["psi"] - round(_brute_psi(ref, cur), 4)) < 1e-4


def test_significant_shift(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.normal(0.25, 0.05, 1000), rng.normal(0.60, 0.05, 1000)
    r = drift.psi(*_frames(spark, ref, cur), "v").first()
    assert r["severity"] == "significant" and r["psi"] > 0.25
    assert abs(r["psi"] - round(_brute_psi(ref, cur), 4)) < 1e-4


@pytest.mark.parametrize("shift", [0.0, 0.01, 0.03, 0.06, 0.12, 0.25])
def test_weekly_shifts_match_brute_force(spark, shift):
    rng = np.random.default_rng(7)
    ref = rng.normal(0.25, 0.05, 300)
    cur = rng.normal(0.25 + shift, 0.05, 300)
    r = drift.psi(*_frames(spark, ref, cur), "v").first()
    assert abs(r["psi"] - round(_brute_psi(ref, cur), 4)) < 1e-4


def test_identical_is_zero_and_small_samples(spark):
    x = [0.1, 0.2, 0.2, 0.3, 0.5, 0.9, 1.0]
    assert drift.psi(*_frames(spark, x, x), "v").first()["psi"] == 0.0
    # fewer than 10 reference points -> 2 bins; duplicates collapse edges
    ref, cur = [1.0, 1.0, 1.0, 2.0], [1.0, 3.0, 3.0]
    r = drift.psi(*_frames(spark, ref, cur), "v").first()
    assert abs(r["psi"] - round(_brute_psi(ref, cur), 4)) < 1e-4
    # constant reference: one distinct edge -> 0, stable
    r = drift.psi(*_frames(spark, [5.0] * 20, [1.0, 9.0]), "v").first()
    assert (r["psi"], r["severity"]) == (0.0, "stable")


def test_grouped_by_key_and_period(spark):
    rng = np.random.default_rng(1)
    rows_ref = [("a", float(x)) for x in rng.normal(0, 1, 200)] + [("b", float(x)) for x in rng.normal(5, 1, 200)]
    rows_cur = [("a", 1, float(x)) for x in rng.normal(0, 1, 100)] + \
               [("a", 2, float(x)) for x in rng.normal(2, 1, 100)] + \
               [("b", 1, float(x)) for x in rng.normal(5, 1, 100)]
    ref = spark.createDataFrame(rows_ref, "k string, v double")
    cur = spark.createDataFrame(rows_cur, "k string, p int, v double")
    got = {(r["k"], r["p"]): r["psi"] for r in drift.psi(ref, cur, "v", by=["k"], period=["p"]).collect()}
    assert set(got) == {(k, p) for k, p, _ in rows_cur}
    for (k, p), val in got.items():
        want = _brute_psi([v for kk, v in rows_ref if kk == k], [v for kk, pp, v in rows_cur if kk == k and pp == p])
        assert abs(val - round(want, 4)) < 1e-4
    assert got[("a", 2)] > 0.25 > got[("a", 1)]


def test_severity_bands(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.2499,), (0.25,)], "p double")
    got = [r[0] for r in df.select(drift.severity(F.col("p"))).collect()]
    assert got == ["stable", "moderate", "moderate", "significant"]
    assert math.isclose(drift.SHARE_FLOOR, 1e-4)


def test_groups_without_reference_stay(spark):
    ref = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("gone", 1.0), ("void", None)],
                                "k string, v double")
    cur = spark.createDataFrame([("a", float(i)) for i in range(20)] +
                                [("new", 1.0), (None, 2.0), (None, 3.0), ("void", 4.0), ("empty", None)],
                                "k string, v double")
    got = {r["k"]: (r["psi"], r["severity"], r["n_reference"], r["n_current"])
           for r in drift.psi(ref, cur, "v", by=["k"]).collect()}
    assert got == {"a": (0.0, "stable", 20, 20), "new": (0.0, "stable", 0, 1), None: (0.0, "stable", 0, 2),
                   "void": (0.0, "stable", 0, 1), "empty": (0.0, "stable", 0, 0)}


def test_null_key_is_compared_with_its_own_reference(spark):
    ref = spark.createDataFrame([(None, float(i)) for i in range(40)], "k string, v double")
    cur = spark.createDataFrame([(None, float(i) + 30) for i in range(40)], "k string, v double")
    r = drift.psi(ref, cur, "v", by=["k"]).collect()
    assert len(r) == 1 and r[0]["n_reference"] == 40
    assert abs(r[0]["psi"] - round(_brute_psi(range(40), [i + 30 for i in range(40)]), 4)) < 1e-4


def test_quantiles_with_one_value_holding_a_third_of_the_rows(spark):
    from coverwise.operators.drift import exact_quantiles
    rng = np.random.default_rng(3)
    x = [0.0] * 1000 + [float(v) for v in rng.normal(0, 1, 2000)]
    df = spark.createDataFrame([("g", v) for v in x] + [("h", 1.0), ("h", 2.0)], "k string, v double").repartition(6)
    fr = [0.0, 0.1, 0.25, 0.5, 0.73, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "v", ["k"], fr).collect()}
    assert np.allclose(got["g"], np.quantile(x, fr), atol=1e-12)
    assert np.allclose(got["h"], np.quantile([1.0, 2.0], fr), atol=1e-12)
