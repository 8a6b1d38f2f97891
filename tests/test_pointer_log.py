"""Silver pointers: the state holds no text, replays and compaction change nothing."""
from __future__ import annotations

from pyspark.sql import functions as F

from coverwise.operators import medallion as med
from coverwise.sources import adapters as ad
from coverwise.sources import tables
from coverwise.streaming import jobs
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_pointers_over_several_files_replay_and_compaction(spark, tmp_path):
    docs = tables.documents(spark, SF001)
    folder = str(tmp_path / "in")
    for part in (2, 0, 1, 2):       # newer rows first; the last file comes twice
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    log = jobs.PointerLog(spark, str(tmp_path / "silver"))

    def run(name):
        s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        point = str(tmp_path / name)
        jobs.run_available_now(jobs.silver_pointers(ad.raw_policy_feed(s)), point, mode="update", foreach_batch=log.writer(point))
        return point

    point = run("a")
    bronze = ad.raw_policy_feed(spark.read.schema(docs.schema).parquet(folder))
    want = med.silver_benefit_policy(ad.raw_policy_feed(docs))
    got = jobs.silver_at(bronze, log.current())
    assert _rows(got.select(*want.columns)) == _rows(want)
    assert len(log.folders()) >= 3
    log.compact()
    assert len(log.folders()) == 1
    run("b")                        # all again under a new checkpoint
    log.compact()
    assert _rows(jobs.silver_at(bronze, log.current()).select(*want.columns)) == _rows(want)

    state = spark.read.format("statestore").load(point)
    fields = state.schema["value"].dataType.simpleString()
    assert "body" not in fields and "title" not in fields
    assert state.select(F.max(F.length(F.to_json("value")))).first()[0] < 200


def test_pointers_of_nothing(spark, tmp_path):
    log = jobs.PointerLog(spark, str(tmp_path / "silver"))
    log.compact()
    assert log.current().count() == 0
    assert jobs.silver_at(ad.bronze_policy(spark, SF001), log.current()).count() == 0
