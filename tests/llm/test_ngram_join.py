from __future__ import annotations

import random

import pyarrow as pa
import pytest

from coverwise.llm import ngram_join
from coverwise.llm.texthash import shingle_sets

from .conftest import SF01


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur] if cur else out


def brute(docs, width=4, percent=85):
    sets = {}
    for i, t in docs:
        w = words_of(t)
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    comp = {i: i for i in sets}
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (a, x) in enumerate(flat):
        for b, y in flat[:k]:
            if 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                comp[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), find(i)) for i, ss in sets.items() for s in ss)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocab, k=30))
    docs = []
    for k in range(60):
        docs.append((len(docs), " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 30, 120]))) + (" " + passage if k % 3 == 0 else "")))
    for k in range(120):  # near copies, of copies too
        w = rng.choice(docs)[1].split(" ")
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((len(docs), " ".join(w)))
    return docs


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize("unit_tokens", [ngram_join.UNIT_TOKENS, 400])
def test_matches_brute_force(spark, unit_tokens):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ngram_join.jaccard_components(df, unit_tokens=unit_tokens)) == brute(docs)


@pytest.mark.parametrize("unit_tokens", [3000])
def test_chunked_units_match_sql(spark, con, unit_tokens):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    expect = con.execute(ngram_join.ORACLE).fetchall()
    assert got(ngram_join.jaccard_components(df, unit_tokens=unit_tokens)) == sorted(expect)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"x{k}" for k in range(100)]
    docs = []
    for k in range(200):
        w = list(base)
        w[rng.randrange(100)] = f"y{k}"
        docs.append((k, " ".join(w)))
    docs += [(1000 + k, " ".join(f"z{k}_{j}" for j in range(50))) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(ngram_join.jaccard_components(df, unit_tokens=2000)) == brute(docs)


def test_edge_rows(spark):
    t = "a b c d e f g h"
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, t), (7, t.upper()), (8, t), (8, t), (9, "ä b c"),
            (10, " ".join(f"v{k}" for k in range(30000)))]
    df = spark.createDataFrame([(i, x, 0, "q") for i, x in docs], "doc_id long, text string, n_shingles int, component_id string")
    assert got(ngram_join.jaccard_components(df)) == brute(docs)
    null = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(null).collect()), key=str) == [(1, 5, 1), (None, 5, None)]
    assert got(ngram_join.jaccard_components(df.limit(0))) == []


def test_one_document_with_two_texts_ties_them(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = [(5, a), (5, b), (3, a), (9, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ngram_join.jaccard_components(df)) == [(3, 17, 3), (5, 17, 3), (5, 17, 3), (9, 17, 3)]


def test_shingles_ignore_text_boundaries():
    s = shingle_sets(pa.array(["a b c d", "e f", "a b c d e", None, "E  F"]), 4)
    assert [len(x) for x in s] == [1, 1, 2, 0, 1]
    assert s[0][0] in s[2] and s[1].tolist() == s[4].tolist()


def test_negative_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 100)  # every document in a block of its own
    text = " ".join(f"w{k}" for k in range(60))
    docs = [(-7, text), (-3, text + " end"), (5, "begin " + text), (-1, "something else here altogether and nothing more"), (-2, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5, "doc_id")
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect())) == brute(docs)
