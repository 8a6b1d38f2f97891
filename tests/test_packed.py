"""Norms from packed postings against the join with a vocabulary."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coverwise.operators import packed
from coverwise.operators import retrieval as rt


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i % 90 if i % 13 else None, f"policy member copay word{i % 7} word{i % 5} " + "copay rider " * (i % 4) + f"only{i}") for i in range(120)]
    return spark.createDataFrame(rows + [(400, ""), (401, None), (402, "long " * 70000)], "pos long, text string")


def _norms(df):
    return {r["pos"]: r["norm"] for r in df.collect()}


def test_packed_norms_equal_the_join(spark, texts, monkeypatch):
    """Also with repeated and missing positions, documents cut by a chunk, many ranges and sums sent early."""
    from coverwise.session import materialize
    tf = materialize(rt.code_frequencies(texts, "pos", F.col("text")), "tf")
    n = 100.0
    vocab = tf.groupBy("term").agg(F.count("tf").alias("df")).withColumn("idf", F.log((F.lit(1.0) + n) / (F.col("df") + 1)) + 1)
    want = _norms(rt.document_norms(tf, vocab, F.lit(n)))
    assert None in want and 402 in want
    assert _norms(packed.document_norms(tf, n)) == pytest.approx(want)
    pack, total = packed._packer, packed._summer
    for limit, pending, size in ((7, 3, 2), (64, 1 << 22, 1)):
        monkeypatch.setattr(packed, "_packer", lambda bits, k=limit: pack(bits, k))
        monkeypatch.setattr(packed, "_summer", lambda m, k=pending: total(m, k))
        monkeypatch.setattr(packed, "RANGE", size)
        assert _norms(packed.document_norms(tf, n)) == pytest.approx(want)


def test_packed_norms_of_no_posting(spark):
    assert packed.document_norms(spark.createDataFrame([], "pos long, term long, tf long"), 0.0).count() == 0


def test_a_coded_index_writes_no_vocabulary(spark, texts, tmp_path):
    """Neither the vocabulary nor postings as rows are shuffled for the norms; the asked terms' frequencies are those of the whole index."""
    corpus = texts.where("pos is not null").groupBy("pos").agg(F.first("text").alias("text")).select(
        F.concat(F.lit("d"), "pos").alias("id"), "pos", F.lit("title").alias("title"), "text", F.lit("en").alias("category"))
    coded, index = rt.build_tfidf_index(corpus, coded=True), rt.build_tfidf_index(corpus)
    assert "coverwise_tf_" in coded.vocab._jdf.queryExecution().optimizedPlan().toString()   # a plan, not a table
    assert _norms(coded.norms) == pytest.approx(_norms(index.norms))
    asked = spark.createDataFrame([("copay",), ("zebra",)], "t string").select(F.xxhash64("t").alias("term"))
    got = coded.vocab_of(asked).collect()
    assert [(r["df"], round(r["idf"], 9)) for r in got] == [(r["df"], round(r["idf"], 9)) for r in index.vocab.where("term = 'copay'").collect()]


def test_numbered_tokens_count_like_terms(spark, monkeypatch):
    """For repeated, missing and empty keys and texts, and across counting chunks; a term's code is found from its text."""
    from coverwise.functions.text import term_code
    df = spark.createDataFrame([(1, 0, "copay copay rider"), (1, 0, "rider"), (1, 1, "rider x9"), (2, 0, ""), (3, 0, None), (None, 0, "copay"), (None, 0, "copay"),
                                (4, 0, "of the"), (5, 0, "rider copay Straße_9 copay rider copay")], "k long, b int, t string")
    want = sorted(rt.term_frequencies(df, ["k", "b"], F.col("t")).collect(), key=str)
    counter = rt._term_counter
    for limit in (1, 4, 1 << 20):
        monkeypatch.setattr(rt, "_term_counter", lambda n=limit, **kw: counter(n, **kw))
        assert sorted(rt.dealt_frequencies(df.repartition(3, "k"), ["k", "b"], F.col("t")).collect(), key=str) == want
    one = df.where("b = 0 and k = 5")
    codes = {r["term"] for r in rt.code_frequencies(one, "k", F.col("t")).collect()}
    assert {r[0] for r in rt.dealt_frequencies(one, ["k"], F.col("t")).select(term_code(F.col("term"))).collect()} == codes


def test_open_segments_write_no_vocabulary(spark, tmp_path, monkeypatch):
    """Neither a merged vocabulary nor strings of all postings are needed to rank; a batch without tombstones reads no older postings."""
    from coverwise.operators import segments
    from test_segments import SCHEMA, change
    index = segments.SegmentIndex(spark, str(tmp_path / "i"), buckets=4)
    read = []
    monkeypatch.setattr(segments.SegmentIndex, "_table", lambda self, name, parts, f=segments.SegmentIndex._table: read.append((name, tuple(parts))) or f(self, name, parts))
    index.apply(0, spark.createDataFrame([change("a", 1, 1, "open enrollment"), change("b", 1, 2, "prior copay")], SCHEMA))
    index.apply(1, spark.createDataFrame([change("c", 1, 3, "visit copay")], SCHEMA))
    assert not any(name == "tf" and "batch=0000000000" in parts and len(parts) == 1 for name, parts in read[-4:])
    written = []
    monkeypatch.setattr(segments, "materialize", lambda df, name="t", f=segments.materialize: written.append(name) or f(df, name))
    opened = index.open(fitted=True)
    top = rt.tfidf_topk(spark.createDataFrame([(1, "copay")], "q_id long, question string"), opened, 3, pad=False)
    assert {r["pos"] for r in top.collect()} == {2, 3}
    assert "vocab" not in written and "asked-vocab" in written
    assert opened.vocab_of(spark.createDataFrame([("copay",)], "term string")).first()["df"] == 2


def test_blocks_of_a_coded_index(spark, texts):
    """Words of the corpus name the blocks of codes: the same blocks and ranks as with terms. Contexts are dealt as codes."""
    from coverwise.operators import synonyms as sy
    corpus = texts.where("pos is not null").groupBy("pos").agg(F.first("text").alias("text")).select(
        F.concat(F.lit("d"), "pos").alias("id"), "pos", F.lit("title").alias("title"), "text", F.lit("en").alias("category"))
    pairs = spark.createDataFrame([("rider", "copay")], "word string, code string")
    words = sy.corpus_words(corpus, rt.doc_text(F.col("title"), F.col("text")))
    plain = sy.build_blocks(rt.build_tfidf_index(corpus), pairs)
    coded = sy.build_blocks(rt.build_tfidf_index(corpus, coded=True), pairs, words=words)
    assert sorted(coded.blocks.collect()) == sorted(plain.blocks.collect()) and sorted(coded.sizes.collect()) == sorted(plain.sizes.collect())
    qs = spark.createDataFrame([(1, "rider word3"), (2, "only7 policy"), (3, None)], "q_id long, question string")
    assert sorted(sy.block_topk(qs, coded, 3).collect()) == sorted(sy.block_topk(qs, plain, 3).collect())
    assert set(sy.contexts(corpus, F.col("text"), buckets=4).columns) == {"context", "word", "n"}


def test_champions_of_asked_terms_only(spark, texts):
    from coverwise.operators import blockmax
    corpus = texts.where("pos is not null").groupBy("pos").agg(F.first("text").alias("text")).select(
        F.concat(F.lit("d"), "pos").alias("id"), "pos", F.lit("title").alias("title"), "text", F.lit("en").alias("category"))
    blocks = blockmax.build_blocks(rt.build_tfidf_index(corpus, coded=True))
    found = blocks.champions(spark.range(1).select(F.xxhash64(F.lit("copay")).alias("term")))
    assert found.select("term").distinct().count() == 1 and found.count() == blockmax.CHAMPIONS


def test_ranked_ids_are_brought_to_the_texts(spark, texts):
    from coverwise.operators import evaluation as ev
    docs = texts.where("pos is not null").select(F.concat(F.lit("d"), "pos").alias("id"), "text").distinct()
    ranked = docs.limit(3).select("id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rt.texts_of(docs.select("id", "text"), ranked)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        passages = spark.createDataFrame([(1, "policy member copay"), (2, "a zebra crossing")], "q_id long, question string")
        pairs = ev.containment_pairs(passages, docs)
        assert "SortMergeJoin [did" not in pairs._jdf.queryExecution().executedPlan().toString()
        want = docs.where(F.contains("text", F.lit("policy member copay"))).collect()
        assert {tuple(r) for r in pairs.collect()} == {(1, r["id"]) for r in want}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
