"""JSON document and eval-set sources, bronze flattening and sinks."""
from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from coverwise.sources import sinks
from coverwise.sources.json_docs import bronze_from_json_documents, read_documents, read_eval_set


def test_read_documents_and_eval_set_files(spark):
    d = tempfile.mkdtemp(prefix="cw-src-")
    with open(f"{d}/kb.json", "w") as f:
        json.dump({"documents": [{"id": "a", "title": "T", "category": "policy", "text": "x y"},
                                 {"id": "b", "title": "U", "category": "plan", "text": "z"}]}, f, indent=2)
    with open(f"{d}/ev.json", "w") as f:
        json.dump({"examples": [{"id": "e1", "question": "q?", "relevant_ids": ["a"],
                                 "must_include": ["x", "y"]}]}, f, indent=2)
    docs = read_documents(spark, f"{d}/kb.json")
    assert sorted(r["id"] for r in docs.collect()) == ["a", "b"]
    ex = read_eval_set(spark, f"{d}/ev.json").first()
    assert ex["relevant_ids"] == ["a"] and ex["must_include"] == ["x", "y"]


def test_bronze_from_json_flattens_and_hashes(spark):
    staged = spark.createDataFrame(
        [(json.dumps({"documents": [{"id": "a", "title": "T", "category": "c", "text": "body"},
                                    {"id": "b", "title": "U", "category": "c", "text": "more"}]}),)],
        "json string")
    rows = {r["source_id"]: r for r in bronze_from_json_documents(staged, "json", "sys", "b1").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["file_hash"] == "841a2d689ad86bd1611447453c22c6fc"   # md5("body")


def test_run_log_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="cw-runs-")
    res = spark.createDataFrame([(0, 3, 0.1, 1, 1, 0.04, "v1", 0.5, 0.25, 0.375, 12, 0.3)],
                                "config_id int, top_k int, relevance_threshold double, max_rewrites int, "
                                "max_regenerations int, min_keyword_overlap double, prompt_version string, "
                                "recall_at_k double, answer_accuracy double, composite double, n long, "
                                "avg_top_score double")
    sinks.append_runs(res, d)
    sinks.append_runs(res, d)                 # append-only
    runs = sinks.read_runs(spark, d)
    assert runs.count() == 2
    r = runs.first()
    assert r["run_name"] == "trial-0" and r["params"]["top_k"] == "3" and r["metrics"]["composite"] == 0.375


def test_versioned_refresh_and_landing(spark):
    d = tempfile.mkdtemp(prefix="cw-ver-")
    df = spark.createDataFrame([(1, "b1"), (2, "b2")], "x int, ingest_batch_id string")
    p1 = sinks.write_version(df, d, "1")
    p2 = sinks.write_version(df.where("x = 1"), d, "2")
    assert spark.read.parquet(p1).count() == 2 and spark.read.parquet(p2).count() == 1
    sinks.append_landing(df, f"{d}/landing")
    sinks.append_landing(df, f"{d}/landing")
    assert spark.read.parquet(f"{d}/landing").where(F.col("ingest_batch_id") == "b1").count() == 2
