"""Bucketed gold: the same rows as the plain merge, untouched buckets keep their files."""
from __future__ import annotations

from pyspark.sql import functions as F

from coverwise.operators import medallion as med
from coverwise.operators.gold_buckets import GoldBuckets


def _gold(spark, rows):
    """rows: (id, text, active, second)"""
    return spark.createDataFrame(rows, "id string, text string, is_active boolean, s int").select(
        "id", F.lit("t").alias("title"), F.lit(None).cast("string").alias("category"), "text",
        F.lit("2024-01-01").cast("date").alias("effective_date"), "is_active", F.md5("id").alias("lineage_sk"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("updated_at"))


def _rows(df):
    return sorted(tuple(r) for r in df.select(*med.GOLD_COLUMNS).collect())


def _files(spark, table, bucket):
    return sorted(spark.read.parquet(table.manifest()[bucket]).inputFiles())


def test_full_load_equals_merge_and_keeps_other_files(spark, tmp_path):
    first = _gold(spark, [(f"d{i}", f"text {i}", True, i) for i in range(40)] + [(None, "no id", True, 1)])
    second = _gold(spark, [(f"d{i}", f"text {i}", True, i) for i in range(2, 40)]      # d0, d1 gone
                   + [("new", None, True, 1)])
    second = second.withColumn("text", F.when(F.col("id") == "d5", "").otherwise(F.col("text")))
    t = GoldBuckets(spark, str(tmp_path / "gold"), buckets=16)
    t.merge("1", first)
    before = {b: _files(spark, t, b) for b in t.manifest()}
    old = t.read()
    touched = t.merge("2", second)
    clean = first.where("id IS NOT NULL")
    assert _rows(t.read()) == _rows(med.merge_gold(clean, second))
    changes = {r["id"]: r["change"] for r in t.changes("2").collect()}
    assert changes == {"d0": "deactivate", "d1": "deactivate", "d5": "update", "new": "insert"}
    assert 0 < len(touched) <= 4
    for b in before:
        assert (_files(spark, t, b) == before[b]) == (b not in touched)
    assert _rows(old) == _rows(clean) == _rows(t.read("1"))      # a reader of the old version keeps it
    assert t.merge("2", first) == []                            # a load is applied once
    assert _rows(t.read()) == _rows(med.merge_gold(clean, second))
    assert t.vacuum(keep=1) == sum(b in touched for b in before)
    assert _rows(t.read()) == _rows(med.merge_gold(clean, second))


def test_partial_and_empty_loads(spark, tmp_path):
    t = GoldBuckets(spark, str(tmp_path / "gold"), buckets=8)
    none = _gold(spark, [("x", "", True, 0)]).where("false")
    assert t.merge("0", none) == [] and t.read().count() == 0
    t.merge("1", _gold(spark, [(f"d{i}", f"text {i}", i != 3, i) for i in range(20)]))
    t.merge("2", _gold(spark, [("d7", "other", False, 7), ("z", "z", True, 0)]), full=False)
    got = {r["id"]: (r["text"], r["is_active"]) for r in t.read().collect()}
    want = {f"d{i}": (f"text {i}", i != 3) for i in range(20)} | {"d7": ("other", False), "z": ("z", True)}
    assert got == want
    assert t.merge("3", none, full=False) == []
    assert {r["id"]: (r["text"], r["is_active"]) for r in t.read().collect()} == want


def test_a_load_that_failed_before_its_manifest_is_written_anew(spark, tmp_path):
    t = GoldBuckets(spark, str(tmp_path / "gold"), buckets=4)
    t.merge("1", _gold(spark, [("a", "1", True, 0)]))
    _gold(spark, [("b", "half", True, 0)]).write.parquet(f"{t.base}/rows/load=2/bucket=0")      # never published
    assert _rows(t.read()) == _rows(_gold(spark, [("a", "1", True, 0)]))
    t.merge("2", _gold(spark, [("a", "2", True, 0)]))
    assert [r["text"] for r in t.read().collect()] == ["2"]
