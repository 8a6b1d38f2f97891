"""Stream results equal batch results; physical plans have the intended shape."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from coverwise.plans.catalog import load_all
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_landing_equals_batch(spark):
    qs = load_all()
    assert _rows(qs["stream_events_landing"].fn(spark, SF001)) == _rows(qs["bronze_member_events"].fn(spark, SF001))


def test_stream_silver_equals_batch(spark):
    qs = load_all()
    a = qs["stream_silver_latest"].fn(spark, SF001)
    b = qs["silver_benefit_policy"].fn(spark, SF001)
    assert _rows(a.select(*b.columns)) == _rows(b)


def test_stream_psi_equals_batch(spark):
    qs = load_all()
    a = qs["stream_psi_weekly"].fn(spark, SF001)
    b = qs["psi_weekly"].fn(spark, SF001)
    assert _rows(a.select(*b.columns)) == _rows(b)


def test_index_refresh_equals_batch_index(spark):
    qs = load_all()
    assert _rows(qs["index_refresh"].fn(spark, SF001)) == _rows(qs["tfidf_vocab"].fn(spark, SF001))


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_python_in_ranking_and_qa(spark):
    qs = load_all()
    for name in ("tfidf_topk_padded", "qa_end_to_end", "config_sweep", "psi_weekly",
                 "federated_topk", "tenant_topk", "slice_gate", "eval_relevance_pairs"):
        p = _plan(qs[name].fn(spark, SF001))
        for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert bad not in p, (name, bad)
        # nested-loop joins are allowed only for nothing: pads and N are scalar subqueries
        assert "BroadcastNestedLoopJoin" not in p, name


def test_topk_uses_partial_window_group_limit(spark):
    p = _plan(load_all()["tfidf_topk_padded"].fn(spark, SF001))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_ranking_never_shuffles_term_frequencies(spark):
    # the index is fitted before ranking; small question sides are broadcast to
    # the tf scan, so no exchange partitions anything by term alone
    qs = load_all()
    for name in ("tfidf_topk_padded", "filtered_topk", "tenant_topk", "federated_topk"):
        p = _plan(qs[name].fn(spark, SF001))
        assert "BroadcastHashJoin" in p, name
        assert "hashpartitioning(term" not in p, name


def _above(plan: str, mark: str) -> list[list[str]]:
    """For each line with ``mark``: the operators above it, nearest first."""
    lines = [(len(re.match(r"[\s:+\-]*", x)[0]), x.strip(" :+-")) for x in plan.splitlines()]
    out = []
    for i, (depth, text) in enumerate(lines):
        if mark in text:
            chain = []
            for d, t in reversed(lines[:i]):
                if d < depth:
                    depth = d
                    chain.append(t)
            out.append(chain)
    return out


def test_ranking_sums_inside_the_index_buckets(spark):
    """With joins planned as for large tables: what is read from tf or norms is dealt to other tasks
    only after the partial top-k cut."""
    qs = load_all()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("tfidf_topk", "tfidf_topk_padded", "filtered_topk", "tenant_topk"):
            plan = _plan(qs[name].fn(spark, SF001)).split("Initial Plan")[0]
            for table in ("coverwise_tf_", "coverwise_norms_"):
                chains = _above(plan, table)
                assert chains, (name, table)
                for chain in chains:
                    first = next(k for k, t in enumerate(chain) if "Exchange" in t)
                    assert "WindowGroupLimit" in chain[first - 1] and "Partial" in chain[first - 1], (name, chain[:first + 1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_silver_dedupe_limits_before_shuffle(spark):
    p = _plan(load_all()["silver_benefit_policy"].fn(spark, SF001))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(spark):
    df = load_all()["semantic_orders"].fn(spark, SF001)
    p = _plan(df)
    # only the needed order columns are read
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double," \
           "o_orderpriority:string>" in p
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in p


def test_entry_and_contract():
    import __spark_entry__ as entry
    from coverwise.session import build_session
    spark = build_session("local[*]", 8)
    df = entry.entry(spark)
    assert df.count() > 0
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    from coverwise.plans.catalog import load_all
    assert set(load_all()) <= set(sqls)             # every query of the catalogue has a DuckDB oracle
    assert "kb_category_counts" in sqls


def test_landing_keeps_late_events(spark, tmp_path):
    """Files out of time order, a replayed batch, a new checkpoint over the old table: every event lands exactly once."""
    from coverwise.streaming import jobs
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for k in (2, 0, 1, 0):
        events.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(src))
    seen = []

    def land(checkpoint):
        stream = jobs.events_landing(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
        write = jobs.land_events(out, checkpoint)

        def recorded(df, batch_id):
            if not seen:
                seen.append(df.sparkSession.createDataFrame(df.collect(), df.schema))
            write(df, batch_id)
        jobs.run_available_now(stream, checkpoint, foreach_batch=recorded)

    def whole():
        landed = spark.read.parquet(out)
        assert landed.count() == landed.select("event_id").distinct().count() == events.count()
        return sorted(r["load"] for r in landed.select("load").collect())

    land(ckpt)
    loads = whole()
    jobs.land_events(out, ckpt)(seen[0], 0)      # a replay of the first batch
    assert whole() == loads
    land(str(tmp_path / "other"))                # all files again under batch numbers that the old table also has
    assert whole() == loads
    days = [r[0] for r in spark.read.parquet(out).select("day").distinct().orderBy("day").limit(1).collect()]
    plan = jobs.landed_ids(spark, out, "string", days, "x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan or "day#" in plan.split("PartitionFilters: [")[1][:40]
