"""Inverted cells: recall of the probes, the exact way, parts of crowded cells, odd vectors."""
from __future__ import annotations

import numpy as np
import pytest

from coverwise.operators import retrieval as rt
from coverwise.operators import vector_cells as vc


def frame(spark, x, key="id"):
    rows = [(int(i), int(i), [float(a) for a in v] if v is not None else None) for i, v in x]
    return spark.createDataFrame(rows, f"{key} long, pos long, vec array<double>").repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = rng.normal(size=(1500, 24)) + 0.7 * centres[rng.integers(0, 12, 1500)]
    x[400:800] = x[3] + 0.01 * rng.normal(size=(400, 24))  # a crowded cell
    return list(enumerate(x))


def rows(df):
    return sorted(map(tuple, df.select("q_id", "rank", "id", "pos", "score").collect()))


def test_exact_and_recall(spark, data, monkeypatch):
    docs = frame(spark, data)
    asked = frame(spark, [d for d in data if d[0] % 20 == 0], "q_id")
    want = rows(rt.vector_topk(asked, docs, 5))
    for part in (8192, 100):  # one part a cell, and a grid of parts
        monkeypatch.setattr(vc, "PART_ROWS", part)
        monkeypatch.setattr(vc, "PART_QUERIES", max(7, part // 10))
        cells = vc.build_cells(docs)
        assert rows(vc.cells_topk(asked, cells, 5, exact=True)) == want
    found, exact = vc.cells_topk(asked, cells, 5), vc.cells_topk(asked, cells, 5, exact=True)
    told = vc.recall(found, exact).first()
    assert told["n_queries"] == 75 and told["wanted"] == 375 and told["recall"] >= 0.9
    score = {(r[0], r[2]): r[4] for r in want}
    assert all(score.get((r[0], r[2]), r[4]) == r[4] for r in rows(found))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    docs = frame(spark, [(1, [1, 0]), (2, [1, 0]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [1, 0, 0]), (8, [0, 2])])
    asked = frame(spark, [(1, [5, 0]), (2, None), (3, [0, 0]), (4, [1, 2, 3])], "q_id")
    assert rows(vc.cells_topk(asked, vc.build_cells(docs), 5, exact=True)) == [(1, 1, 1, 1, 1.0), (1, 2, 2, 2, 1.0), (1, 3, 8, 8, 0.0)]
    assert vc.build_cells(docs.limit(0)) is None
    assert vc.cells_topk(asked.limit(0), vc.build_cells(docs), 5).count() == 0
