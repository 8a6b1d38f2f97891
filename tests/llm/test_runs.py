"""Operator 12 against every period at every place, and its query against SQL."""
from __future__ import annotations

import random
import zlib
from fractions import Fraction

from coverwise.llm import runs
from coverwise.llm.catalog import op12_periodic_runs

from .conftest import SF01, rows


def brute(words, min_words=6, min_periods=4):
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_periods * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def check(text, row):
    words = (text or "").split()
    want = brute(words)
    assert [tuple(r) for r in row["runs"]] == want and row["n_words"] == len(words)
    drop = {i for s, n, q in want for i in range(s + q, s + n)}
    assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in drop)
    best = max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    assert (tuple(row["best"]) if row["best"] else None) == best


def test_random_texts(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < rng.randint(0, 90):
            words += [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        texts.append(" ".join(words))
    # periods around a power of two, runs that overlap, a run that ends in a longer one
    for p in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64):
        unit = [f"w{i}" for i in range(p)]
        texts += [" ".join(unit * 4 + unit[:r]) for r in (0, 1, p // 2)] + [" ".join(unit * 4)[:-1] + "!"]
    texts += ["a a a a b " * 9, "a b a b a b a b a b c a b a b a b a b", "x " * 5 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.word_runs(docs.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        check(t, got[i])


def test_edge_rows(spark):
    long = "start " + "one two three " * 120_000 + "end"  # a text longer than a block
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "r r r r r r"), (5, "r r r r r r"), (None, "z z z z z z z"), (6, "q " * 5000), (7, long),
            (8, "A a A a A a A a"), (9, "\u00a0 " * 6)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], "doc_id long, text string, runs string, best int")
    got = runs.word_runs(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"]) for r in got), key=repr) == sorted(((i, len(split(t))) for i, t in data), key=repr)
    by = {r["doc_id"]: r for r in got}
    assert [tuple(r) for r in by[7]["runs"]] == [(1, 360_000, 3)] and by[7]["collapsed"] == "start one two three end"
    assert by[None]["collapsed"] == "z" and by[1]["runs"] == [] and by[1]["best"] is None and by[1]["collapsed"] == ""
    assert [tuple(r) for r in by[8]["runs"]] == [(0, 8, 2)] and [tuple(r) for r in by[9]["runs"]] == [(0, 6, 1)]
    assert runs.word_runs(docs.limit(0)).count() == 0


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_repeated_tails(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice("abcdef") for _ in range(i % 40))) for i in range(300)] + [(None, "a b"), (301, None)]
    got = {r["doc_id"]: r["text"] for r in runs.with_repeated_tails(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, t in data:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words, g = (t or "").split(), h // 10
        if h % 10 == 0 and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
        assert got[i] == t


def test_query(spark, con):
    assert rows(op12_periodic_runs(spark, SF01).select(*con.execute(runs.ORACLE).fetchdf().columns)) == sorted(con.execute(runs.ORACLE).fetchall(), key=repr)
