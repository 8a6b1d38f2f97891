"""Steps that several readers share are written once, and what is large stays where it was dealt."""
from __future__ import annotations

from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from coverwise.operators import blockmax, evaluation as ev, qa
from coverwise.operators import retrieval as rt
from coverwise.operators import synonyms as sy
from coverwise.operators.segments import SegmentIndex


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"d{i}", i, f"title{i % 3}", f"policy member copay word{i % 7} word{i % 5} copay", "en") for i in range(40)]
    return spark.createDataFrame(rows, "id string, pos long, title string, text string, category string")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_terms_are_counted_inside_their_text(spark):
    df = spark.createDataFrame([(1, "copay copay rider"), (1, "rider"), (2, ""), (3, None), (None, "copay"), (None, "copay")], "k long, t string")
    got = rt.term_frequencies(df, ["k"], F.col("t"))
    assert "hashpartitioning(k" in plan(got) and "hashpartitioning(k#0L, term" not in plan(got)
    assert sorted(((r["k"], r["term"], r["tf"]) for r in got.collect()), key=str) == sorted([
        (1, "copay", 2), (1, "rider", 2), (1, "copay copay", 1), (1, "copay rider", 1), (None, "copay", 2)], key=str)
    assert got.schema["tf"].dataType.simpleString() == "bigint"


def test_norms_are_written_by_the_first_reader_that_scores(spark, corpus):
    index = rt.build_tfidf_index(corpus)
    index.vocab.count()
    assert index._norms is None
    df = {r["term"]: r["df"] for r in index.vocab.collect()}
    want: dict = {}
    for r in index.tf.collect():
        w = (1 + log(r["tf"])) * (log((1 + 40) / (df[r["term"]] + 1)) + 1)
        want[r["pos"]] = want.get(r["pos"], 0.0) + w * w
    got = {r["pos"]: r["norm"] for r in index.norms.collect()}
    assert got == pytest.approx({p: sqrt(x) for p, x in want.items()})
    assert index.norms is index.norms


def test_found_documents_are_not_paired_with_terms_they_lack(spark, corpus, monkeypatch):
    index = rt.build_tfidf_index(corpus)
    blocks = blockmax.build_blocks(index)
    written = []
    monkeypatch.setattr(blockmax, "materialize", lambda df, name="t", f=blockmax.materialize: written.append(name) or f(df, name))
    qs = spark.createDataFrame([(1, "copay word3"), (2, "policy title1")], "q_id long, question string")
    got = blockmax.blockmax_topk(qs, blocks, 3).collect()
    assert sorted(got) == sorted(rt.tfidf_topk(qs, index, 3).collect())
    assert "asked" not in written


def test_contexts_stay_with_their_neighbours(spark):
    docs = spark.createDataFrame([(f"doctor {w} visit clinic {w} today", ) for w in ["copay", "copay", "fee"]], "t string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = sy.learn_pairs(docs, F.col("t"), min_shared=1)
        assert "hashpartitioning(left" not in plan(pairs)
        assert ("fee", "copay") in {(r["word"], r["code"]) for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_answers_do_not_rank_again_for_every_reader(spark, corpus):
    index = rt.build_tfidf_index(corpus)
    qs = spark.createDataFrame([(1, "copay word3"), (2, "zebra")], "q_id long, question string")
    got = qa.answer_questions(qs, index, corpus.select("id", "title", "text"))
    assert "coverwise_tf_" not in plan(got)
    assert got.count() == 2


def test_slices_are_decided_from_written_metrics(spark):
    rows = spark.range(40).select(F.concat(F.lit("t"), F.col("id") % 2).alias("tenant"), F.lit(True).alias("hit"),
                                  F.lit(True).alias("correct"), F.lit(0.5).alias("top_score"), F.lit(2).alias("cost"))
    got = ev.slice_gate(rows, "tenant", max_p95_cost=3.0)
    assert "Range" not in plan(got)
    assert [r["promote"] for r in got.collect()] == [True, True]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path), buckets=2)
    dealt = index._deal(spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("bucket")))
    assert dealt.select("bucket", "_part").distinct().count() > 2


def test_coded_terms_rank_like_terms(spark, corpus, monkeypatch):
    """Codes in place of terms: counted alike for null, repeated and empty texts and across counting chunks."""
    df = spark.createDataFrame([(1, "copay copay rider"), (1, "rider"), (2, ""), (3, None), (None, "copay"), (None, "copay"), (4, "of the"),
                                (5, "rider copay Straße_9 copay rider copay")], "k long, t string")
    want = rt.term_frequencies(df, ["k"], F.col("t"))
    runs = sorted(((r["k"], r["tf"]) for r in want.collect()), key=str)
    counter = rt._code_counter
    for limit in (1, 4, 1 << 20):
        monkeypatch.setattr(rt, "_code_counter", lambda n=limit: counter(n))
        got = rt.code_frequencies(df, "k", F.col("t")).collect()
        assert sorted(((r["k"], r["tf"]) for r in got), key=str) == runs
        assert sorted(got, key=str) == sorted(rt.term_frequencies(df, ["k"], F.col("t"), coded=True).collect(), key=str)
    # a code is that of the token, a bigram's code that of its tokens' codes
    codes = {r["term"] for r in got if r["k"] == 1}
    c, r = F.xxhash64(F.lit("copay")), F.xxhash64(F.lit("rider"))
    assert codes == set(spark.range(1).select(c, r, F.xxhash64(c, c), F.xxhash64(c, r)).first())
    index, coded = rt.build_tfidf_index(corpus), rt.build_tfidf_index(corpus, coded=True)
    assert coded.tf.schema["term"].dataType.simpleString() == "bigint" and coded.tf.count() == index.tf.count()
    qs = spark.createDataFrame([(1, "copay word3 policy"), (2, "policy title1 unknown"), (3, None), (4, "member copay word1")], "q_id long, question string")
    assert sorted(rt.tfidf_topk(qs, coded, 3).collect()) == sorted(rt.tfidf_topk(qs, index, 3).collect())
    assert rt.tfidf_topk(qs, coded.checkpoint(), 3, pad=False).where("q_id = 3").isEmpty()


def test_rounds_read_codes(spark):
    """What ranks in rounds writes, deals and joins codes; no term text is in the tables of its index."""
    from coverwise.plans.retrieval_q import Ctx
    index = Ctx(spark, "/root/testdata/sf0.001").index_reused
    assert index.coded
    assert {t.schema["term"].dataType.simpleString() for t in (index.tf, index.vocab)} == {"bigint"}
    assert "SortMergeJoin" not in plan(rt.document_norms(index.tf, index.vocab, F.lit(10.0)))
