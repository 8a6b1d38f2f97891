"""The rounds of the question loop, with a retriever, a rewriter and an answerer of the caller's."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coverwise.config import QaConfig
from coverwise.operators import qa, qa_loop
from coverwise.operators import retrieval as rt

STRICT = QaConfig(relevance_threshold=0.99, min_keyword_overlap=0.99, max_rewrites=2)


@pytest.fixture(scope="module")
def idx(kb):
    return rt.build_tfidf_index(kb)


def _qs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id long, question string")


def _text(kb):
    return kb.select("id", "title", "text")


def test_rounds_equal_two_passes_for_the_fixed_rules(spark, kb, idx):
    qs = _qs(spark, "parking fee nightly", "What is the emergency room copay?", "telehealth", None)
    cols = [c for c in qa.answer_questions(qs, idx, _text(kb), STRICT).columns if c != "final_docs"]
    two = qa.answer_questions(qs, idx, _text(kb), STRICT).select(cols)
    loop = qa.answer_questions(qs, idx, _text(kb), STRICT, retriever=qa_loop.keyword_retriever(idx)).select(cols)
    assert sorted(map(str, loop.collect())) == sorted(map(str, two.collect()))


def test_own_retriever_runs_once_a_round_over_open_questions(spark, kb):
    asked = []

    def retriever(questions, k):
        rows = questions.collect()
        asked.append(sorted((r["q_id"], r["question"]) for r in rows))
        found = [(r["q_id"], 1, "kb-copay", 1.0 if "good" in r["question"] else 0.1) for r in rows if "none" not in r["question"]]
        return spark.createDataFrame(found, "q_id long, rank int, id string, score double")

    def rewriter(question, query, round_no):
        return F.concat(query, F.lit("+"), round_no.cast("string"), F.when((F.col("q_id") == 1) & (round_no == 1), F.lit(" good")).otherwise(""))

    qs = _qs(spark, "a good one", "b", "c", "none")
    got = {r["q_id"]: r for r in qa.answer_questions(qs, None, _text(kb), STRICT, retriever=retriever, rewriter=rewriter).collect()}
    assert asked == [[(0, "a good one"), (1, "b"), (2, "c"), (3, "none")], [(1, "b+1 good"), (2, "c+1"), (3, "none+1")], [(2, "c+1+2"), (3, "none+1+2")]]
    assert {q: (r["rewrite_count"], r["n_retrieves"], r["retrieval_ok"]) for q, r in got.items()} == \
        {0: (0, 1, True), 1: (1, 2, True), 2: (2, 3, False), 3: (2, 3, False)}
    assert got[2]["final_query"] == "c+1+2" and got[2]["top_id"] == "kb-copay" and got[3]["top_id"] is None
    assert got[3]["answer"] == qa.FALLBACK_ANSWER and got[3]["answer_ok"] is False


def test_the_loop_ends_when_nothing_is_open(spark, kb, idx):
    rounds = []

    def retriever(questions, k):
        rounds.append(questions.count())
        return rt.tfidf_topk(questions, idx, k)

    easy = QaConfig(relevance_threshold=0.0, max_rewrites=5)
    got = qa.answer_questions(_qs(spark, "copay", "telehealth"), idx, _text(kb), easy, retriever=retriever)
    assert [r["n_retrieves"] for r in got.collect()] == [1, 1] and rounds == [2]


def test_own_answerer_is_asked_again_until_it_is_graded_ok(spark, kb, idx):
    def answerer(question, docs, attempt):
        grounded = F.element_at(docs, 1)["text"]
        return F.when((F.col("q_id") == 0) & F.lit(attempt >= 1), grounded).otherwise(F.lit(f"no {attempt}"))

    cfg = QaConfig(max_regenerations=2)
    got = {r["q_id"]: r for r in qa.answer_questions(_qs(spark, "When is open enrollment?", "specialist copay"), idx, _text(kb), cfg, answerer=answerer).collect()}
    assert (got[0]["n_generations"], got[0]["regen_count"], got[0]["answer_ok"]) == (2, 1, True) and "November 1" in got[0]["answer"]
    assert (got[1]["n_generations"], got[1]["regen_count"], got[1]["answer"]) == (3, 3, "no 2")


def test_texts_meet_ranked_rows_that_are_written(spark, kb, idx, monkeypatch):
    """The join with the texts is planned over a written table of few rows, not over the ranking."""
    plans = {}

    def spy(df, name="t", f=qa_loop.materialize):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return f(df, name)

    monkeypatch.setattr(qa_loop, "materialize", spy)
    qs = _qs(spark, "parking fee nightly", "telehealth")
    qa.answer_questions(qs, idx, _text(kb), STRICT, retriever=qa_loop.keyword_retriever(idx)).collect()
    assert "row_number" in plans["top-0"]
    assert not any("row_number" in p for name, p in plans.items() if name.startswith("round-"))
