"""Operator 13 against all pairs: recall for the ids divisible by 20, precision, hot groups, odd vectors."""
from __future__ import annotations

import numpy as np

from coverwise.llm import pivots
from coverwise.llm.catalog import op13_pivot_permutation

from .conftest import SF01, rows


def near(v, cosine, rng):
    """A vector at this cosine to ``v``."""
    z = rng.normal(size=len(v))
    u = v / np.linalg.norm(v)
    z -= (z @ u) * u
    return (cosine * u + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z)) * rng.uniform(0.1, 9)


def brute(data):
    """id -> set of linked positions, position -> component, over (id, vector) rows with usable vectors."""
    x = np.array([v for _, v in data], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= pivots.COSINE
    np.fill_diagonal(close, False)
    ids = np.array([i for i, _ in data])
    least = ids.copy()
    while True:
        new = np.array([min(least[k], least[close[k]].min(initial=least[k])) for k in range(len(ids))])
        if (new == least).all():
            return close, least
        least = new


def frame(spark, data, kind="double"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, "n") for i, v in data],
                                 f"vec_id long, embedding array<{kind}>, node string").repartition(5)


def vectors(n, dim, rng):
    centres = rng.normal(size=(10, dim))
    return rng.normal(size=(n, dim)) + 0.8 * centres[rng.integers(0, 10, n)]


def test_recall_and_precision(spark):
    rng = np.random.default_rng(1)
    base = vectors(2400, 64, rng)
    data = list(enumerate(base))
    for k in range(0, 1600):  # partners close to the threshold, of every twentieth id and others
        data.append((len(data), near(base[k], rng.uniform(0.9001, 0.92) if k % 3 else rng.uniform(0.86, 0.8999), rng)))
    close, least = brute(data)
    got = {r["vec_id"]: r for r in pivots.near_vectors(frame(spark, data)).collect()}
    assert len(got) == len(data)
    asked = [i for i, _ in data if i % 20 == 0]
    assert sum(close[i].sum() for i in asked) > 40
    assert sum(got[i]["n_links"] for i in asked) >= 0.9 * sum(close[i].sum() for i in asked)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * close.sum()
    for i, _ in data:
        assert got[i]["n_links"] <= close[i].sum()  # nothing under the threshold
        assert got[i]["component_id"] >= least[i] and got[i]["kept"] == (got[i]["component_id"] == i)


def test_groups_of_copies_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = vectors(200, 32, rng)
    data = list(enumerate(base))
    data += [(200 + k, base[7]) for k in range(100)]  # equal
    data += [(300 + k, near(base[9], 0.99, rng)) for k in range(150)]  # near copies
    data += [(500 + k, base[11] * (k + 2)) for k in range(3)] + [(-4, base[11])]
    close, least = brute(data)
    want = sorted((i, int(close[k].sum()), int(least[k]), i == least[k]) for k, (i, _) in enumerate(data))
    for chunk in (2048, 13):
        monkeypatch.setattr(pivots, "CHUNK", chunk)
        assert sorted(map(tuple, pivots.near_vectors(frame(spark, data)).collect())) == want


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1e-300, 0.0]), (9, [1e300, -0.0]),
            (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [-1.0, 0.0]), (1, [1.0, 0.0])]
    got = sorted(map(tuple, pivots.near_vectors(frame(spark, data)).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10, 11, 12)]
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (8, 4, 1, False), (9, 4, 1, False), (None, 0, None, False), *alone], key=repr)
    holes = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, None])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pivots.near_vectors(holes).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pivots.near_vectors(frame(spark, data).limit(0)).count() == 0
    assert sorted(map(tuple, pivots.near_vectors(frame(spark, [(5, [3.0])], "float")).collect())) == [(5, 0, 5, True)]


def test_pivots_stay_apart():
    rng = np.random.default_rng(3)
    crowd = pivots.unit(np.array([near(np.ones(16), 0.99, rng) for _ in range(200)] + list(rng.normal(size=(50, 16)))))
    chosen = pivots.choose_pivots(crowd, 64)
    product = chosen @ chosen.T - 2 * np.eye(len(chosen))
    assert 30 < len(chosen) <= 64 and product.max() < pivots.SPREAD


def test_query(spark, con):
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    assert rows(op13_pivot_permutation(spark, SF01)) == sorted(con.execute(pivots.ORACLE).fetchall(), key=repr)
