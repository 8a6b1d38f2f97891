"""Retriever behaviour: exact k rows, ordering, relevance, padding, vectors, fusion."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from coverwise.functions.text import ENGLISH_STOP_WORDS, retrieval_tokens, with_bigrams
from coverwise.operators import retrieval as rt


def _qs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q_id long, question string")


def test_stop_words_equal_spark_ml_list(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens_and_bigrams_of_surviving_tokens(spark):
    df = spark.createDataFrame([("The MRI, of the knee: a CT_scan x",)], "t string")
    toks = df.select(retrieval_tokens(F.col("t")).alias("a")).first()["a"]
    assert toks == ["mri", "knee", "ct_scan"]
    terms = df.select(with_bigrams(retrieval_tokens(F.col("t"))).alias("a")).first()["a"]
    assert terms == ["mri", "knee", "ct_scan", "mri knee", "knee ct_scan"]


def test_returns_exactly_k_sorted(spark, kb):
    idx = rt.build_tfidf_index(kb)
    top = rt.tfidf_topk(_qs(spark, "open enrollment dates"), idx, 3).orderBy("rank").collect()
    assert len(top) == 3
    scores = [r["score"] for r in top]
    assert scores == sorted(scores, reverse=True)
    assert top[0]["id"] == "kb-enroll"


def test_relevance(spark, kb):
    idx = rt.build_tfidf_index(kb)
    top = rt.tfidf_topk(_qs(spark, "prior authorization MRI"), idx, 1).collect()
    assert [r["id"] for r in top] == ["kb-auth"]


def test_padding_with_zero_scores_in_corpus_order(spark, kb):
    idx = rt.build_tfidf_index(kb)
    top = rt.tfidf_topk(_qs(spark, "parking fee nightly"), idx, 3, pad=True).orderBy("rank").collect()
    assert [r["id"] for r in top] == ["kb-enroll", "kb-auth", "kb-copay"]
    assert all(r["score"] == 0.0 for r in top)
    unpadded = rt.tfidf_topk(_qs(spark, "parking fee nightly"), idx, 3, pad=False).collect()
    assert unpadded == []


def test_k_larger_than_corpus(spark, kb):
    idx = rt.build_tfidf_index(kb)
    top = rt.tfidf_topk(_qs(spark, "copay"), idx, 10).collect()
    assert len(top) == 5


def _brute_tfidf(docs, query, stop):
    """Independent single-machine TF-IDF cosine (sublinear tf, smooth idf, l2)."""
    import re
    def terms(t):
        toks = [x for x in re.findall(r"[^\W]{2,}", t.lower()) if x not in stop]
        return toks + [a + " " + b for a, b in zip(toks, toks[1:])]
    dts = [terms(t) for t in docs]
    n = len(docs)
    df = {}
    for ts in dts:
        for w in set(ts):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def vec(ts):
        cnt = {}
        for w in ts:
            if w in idf:
                cnt[w] = cnt.get(w, 0) + 1
        v = {w: (1 + math.log(c)) * idf[w] for w, c in cnt.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}
    qv = vec(terms(query))
    return [sum(qv.get(w, 0) * x for w, x in vec(ts).items()) for ts in dts]


def test_scores_match_brute_force(spark, kb):
    idx = rt.build_tfidf_index(kb)
    q = "What is the copay for a specialist or emergency room visit?"
    top = rt.tfidf_topk(_qs(spark, q), idx, 5).collect()
    from coverwise.functions.text import effective_stop_words
    from tests.conftest import KB
    expect = _brute_tfidf([f"{t}. {x}" for _, _, t, x in KB], q, set(effective_stop_words()))
    got = {r["pos"]: r["score"] for r in top}
    for pos, s in enumerate(expect):
        assert abs(got[pos] - s) < 1e-6


def test_filtered_topk_restricts_candidates(spark, kb):
    idx = rt.build_tfidf_index(kb)
    allowed = kb.where(F.col("id").isin("kb-tele", "kb-rx")).select("id")
    top = rt.tfidf_topk(_qs(spark, "emergency room copay"), idx, 3, allowed_docs=allowed).collect()
    assert {r["id"] for r in top} <= {"kb-tele", "kb-rx"}
    assert len(top) == 2


def test_rank_derived_score(spark, kb):
    idx = rt.build_tfidf_index(kb)
    top = rt.rank_derived_score(rt.tfidf_topk(_qs(spark, "telehealth"), idx, 4))
    got = [r["rank_score"] for r in top.orderBy("rank").collect()]
    assert got == [1.0, 0.75, 0.5, 0.25]


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(60, 8))
    qs = rng.normal(size=(7, 8))
    dv = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(docs)],
                               "id long, pos long, vec array<double>")
    qv = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)],
                               "q_id long, vec array<double>")
    got = rt.vector_topk(qv, dv, 4).collect()
    sims = (qs / np.linalg.norm(qs, axis=1, keepdims=True)) @ (docs / np.linalg.norm(docs, axis=1, keepdims=True)).T
    for q in range(len(qs)):
        want = list(np.argsort(-sims[q])[:4])
        mine = [r["id"] for r in sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])]
        assert mine == want


def test_vector_topk_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(30, 4))
    qs = rng.normal(size=(9, 4))
    dv = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(docs)],
                               "id long, pos long, vec array<double>")
    qv = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)],
                               "q_id long, vec array<double>")
    one = sorted(tuple(r) for r in rt.vector_topk(qv, dv, 3).collect())
    monkeypatch.setattr(rt, "MAX_BROADCAST_QUERY_VALUES", 8)   # forces 5 passes
    many = sorted(tuple(r) for r in rt.vector_topk(qv, dv, 3).collect())
    assert one == many


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q_id long, rank int, pos long")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "q_id long, rank int, pos long")
    got = rt.reciprocal_rank_fusion([a, b], 3).orderBy("rank").collect()
    assert [r["pos"] for r in got] == [11, 10, 12]
    assert abs(got[0]["fused"] - round(1 / 62 + 1 / 61, 6)) < 1e-9


def test_federated_topk_interleaves_and_fuses(spark):
    rows = "q_id long, rank int, id string, pos long"
    kb = spark.createDataFrame([(1, 1, "doc-5", 5), (1, 2, "doc-2", 2), (1, 3, "doc-9", 9)], rows)
    web = spark.createDataFrame([(1, 1, "page-3", 3), (1, 2, "page-1", 1)], rows)
    kb2 = spark.createDataFrame([(1, 1, "doc-9", 9)], rows)          # a second retriever over kb
    got = [(r["rank"], r["corpus"], r["id"]) for r in
           rt.federated_topk([("kb", kb), ("web", web)], 4).orderBy("rank").collect()]
    # equal reciprocal ranks across corpora: the earlier corpus first
    assert got == [(1, "kb", "doc-5"), (2, "web", "page-3"), (3, "kb", "doc-2"), (4, "web", "page-1")]
    fused = rt.federated_topk([("kb", kb), ("web", web), ("kb", kb2)], 1).first()
    assert (fused["corpus"], fused["id"]) == ("kb", "doc-9")            # 1/63 + 1/61 wins
    assert abs(fused["fused"] - round(1 / 63 + 1 / 61, 6)) < 1e-12


def test_page_corpus_strips_markup(spark):
    from coverwise.sources import adapters as ad
    html = ('<html><head><title>Plan A</title><style>p{x:1}</style>'
            '<script>var t="</p>";</script></head><body><p>Copay <b>ten</b></p></body></html>')
    r = ad.page_corpus(spark.createDataFrame([(7, "u", html)], "page_id long, url string, html string")).first()
    assert (r["id"], r["pos"], r["title"]) == ("page-7", 7, "Plan A")
    assert r["text"].split() == ["Plan", "A", "Copay", "ten"]


def test_tenant_topk_never_crosses_tenants(spark, kb):
    idx = rt.build_tfidf_index(kb)
    docs = idx.docs.select("pos", "id").collect()
    # two tenants by alternating position; one document without a tenant
    dt = spark.createDataFrame([(r["pos"], None if i == 0 else ("a" if i % 2 else "b"))
                                for i, r in enumerate(sorted(docs, key=lambda r: r["pos"]))],
                               "pos long, tenant string")
    qs = spark.createDataFrame([(0, "prior authorization MRI imaging", "a"),
                                (1, "prior authorization MRI imaging", "b"),
                                (2, "parking fee nightly", "a"),
                                (3, "copay", None)], "q_id long, question string, tenant string")
    got = rt.tenant_topk(qs, idx, dt, 3).collect()
    tenant_of = {r["pos"]: r["tenant"] for r in dt.collect()}
    assert all(tenant_of[r["pos"]] == r["tenant"] for r in got)
    n_a = sum(1 for t in tenant_of.values() if t == "a")
    n_b = sum(1 for t in tenant_of.values() if t == "b")
    per_q = {q: sum(1 for r in got if r["q_id"] == q) for q in (0, 1, 2, 3)}
    assert per_q == {0: min(3, n_a), 1: min(3, n_b), 2: min(3, n_a), 3: 0}   # padded within the tenant
    # the same question over one tenant equals the global ranking restricted to that tenant
    allowed = idx.docs.join(dt.where("tenant = 'a'"), "pos", "left_semi")
    want = rt.tfidf_topk(qs.where("q_id = 0"), idx, 3, allowed_docs=allowed).collect()
    assert [(r["id"], r["score"]) for r in sorted(want, key=lambda r: r["rank"])] == \
        [(r["id"], r["score"]) for r in sorted([r for r in got if r["q_id"] == 0], key=lambda r: r["rank"])]
    rej = {(r["kind"], r["key"]) for r in rt.tenant_rejects(qs, dt.join(idx.docs, "pos"), doc_col="id").collect()}
    assert ("question", "3") in rej and len([k for k in rej if k[0] == "document"]) == 1


def test_vector_topk_leaves_out_null_and_ragged_vectors(spark):
    docs = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, [1.0]), (4, 4, [0.0, 1.0])], "id long, pos long, vec array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "q_id long, vec array<double>")
    got = [(r["q_id"], r["id"]) for r in rt.vector_topk(qs, docs, 3).orderBy("q_id", "rank").collect()]
    assert got == [(1, 1), (1, 4)]
