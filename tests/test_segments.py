"""Segment log: after any batches, replays and compactions the index equals a batch fit of the current documents."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from coverwise.operators import retrieval as rt
from coverwise.operators.segments import SegmentIndex

SCHEMA = ("key string, ord struct<ingested_at:timestamp_ntz,ingest_batch_id:string,policy_id:string>, id string, pos long, "
          "title string, category string, text string, updated_at timestamp_ntz, live boolean")


def change(key, at, pos, text, live=True):
    when = dt.datetime(2024, 1, 1) + dt.timedelta(hours=at)
    return (key, (when, "b", f"doc-{pos}"), f"doc-{pos}", pos, f"title {key}", "en", text, when, live)


BATCHES = [
    [change("a", 1, 1, "open enrollment runs each autumn"), change("b", 1, 2, "prior authorization for imaging"), change("c", 1, 3, "copay for a visit")],
    [change("b", 2, 12, "prior authorization rules changed imaging"), change("d", 2, 4, "telehealth visit copay"), change("a", 0, 99, "stale text that stays out")],
    [change("c", 3, 3, None, live=False), change("e", 3, 5, "pharmacy tiers"), change("e", 4, 15, "pharmacy tiers and generic drugs"), change("f", 3, 6, "")],
    [change("c", 2, 33, "older than its deletion"), change("d", 2, 4, "telehealth visit copay", live=False)],
    [change("d", 2, 4, "telehealth visit copay"), change("a", 9, 21, "enrollment closes in winter")],
]
#: Current documents after all batches.
CURRENT = [(12, "b", "prior authorization rules changed imaging"), (15, "e", "pharmacy tiers and generic drugs"), (6, "f", ""),
           (4, "d", "telehealth visit copay"), (21, "a", "enrollment closes in winter")]


def rounded(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def same_as_batch_fit(spark, index):
    corpus = spark.createDataFrame([(f"doc-{p}", p, f"title {k}", t, "en") for p, k, t in CURRENT], "id string, pos long, title string, text string, category string")
    want, got = rt.build_tfidf_index(corpus), index.open(fitted=True)
    assert rounded(got.docs, "id", "pos", "title", "category") == rounded(want.docs, "id", "pos", "title", "category")
    assert rounded(got.tf, "pos", "term", "tf") == rounded(want.tf, "pos", "term", "tf")
    assert rounded(got.vocab, "term", "df", "idf") == rounded(want.vocab, "term", "df", "idf")
    assert rounded(got.norms, "pos", "norm") == rounded(want.norms, "pos", "norm")
    qs = spark.createDataFrame([(1, "imaging authorization"), (2, "visit copay"), (3, "nothing at all")], "q_id long, question string")
    cols = ("q_id", "rank", "id", "score")
    assert rounded(rt.tfidf_topk(qs, got, 3), *cols) == rounded(rt.tfidf_topk(qs, want, 3), *cols)


def test_updates_deletes_replays_and_compaction(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.segments() == []
    batches = [spark.createDataFrame(b, SCHEMA) for b in BATCHES]
    for k in (0, 1, 1, 2):  # the second batch comes twice
        index.apply(k, batches[k])
    index.compact(1)
    assert index.segments() == ["upto=0000000001", "batch=0000000002"]
    index.apply(1, batches[1])  # a batch that the compaction holds
    index.apply(3, batches[3])
    index.apply(4, batches[4])
    index.apply(4, batches[4])
    index.apply(5, batches[4].limit(0))
    live = rounded(index.open().tf, "pos", "term", "tf")
    index.compact(5)
    assert index.segments() == ["upto=0000000005"] and "batch=0000000000" in index.vacuum()
    assert rounded(index.open().tf, "pos", "term", "tf") == live
    same_as_batch_fit(spark, index)
    assert rounded(index._table("df", index.segments()).where("d < 1"), "term") == []


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "i"), buckets=16)
    index.apply(0, spark.createDataFrame([change(f"k{i}", 1, i, f"word{i} shared") for i in range(64)], SCHEMA))
    index.apply(1, spark.createDataFrame([change("k7", 2, 107, "word7 shared renewed")], SCHEMA))
    segment = ["batch=0000000001"]
    assert [r["pos"] for r in index._table("gone", segment).collect()] == [7]
    assert {r["term"]: r["d"] for r in index._table("df", segment).collect()} == {"renewed": 1, "shared renewed": 1}
    assert index._table("state", segment).count() == 1 and index._table("meta", segment).first()["n"] == 0
    old = index._table("tf", ["batch=0000000000"]).where(F.col("bucket").isin([3]))
    assert "PartitionFilters: [" in old._jdf.queryExecution().toString() and "bucket" in old._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:80]


def test_an_empty_index_ranks_nothing(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "i"))
    qs = spark.createDataFrame([(1, "imaging")], "q_id long, question string")
    assert rt.tfidf_topk(qs, index.open(), 3).count() == 0
