"""Medallion tables, DQ, semantic layer and governance."""
from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from coverwise.operators import governance as gov
from coverwise.operators import medallion as med
from coverwise.operators import semantic as sem
from coverwise.sources import adapters as ad
from coverwise.sources import tables
from tests.conftest import SF01


def test_silver_golden_at_sf001(spark):
    s = med.silver_benefit_policy(ad.bronze_policy(spark, SF01))
    r = s.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.regexp_extract("policy_id", r"(\d+)$", 1).cast("long")).alias("ids")).first()
    assert (r["n"], r["ids"]) == (912, 465490)


def test_latest_wins_with_tiebreaks(spark):
    rows = [("s1", "sys", "b1", "2024-01-01 00:00:00", "T", " X ", "body one", "h1"),
            ("s2", "sys", "b2", "2024-01-02 00:00:00", "T", "x", "body two", "h1"),
            ("s3", "sys", "b1", "2024-01-02 00:00:00", "T", "x", "body three", "h1"),
            ("s4", "sys", "b1", "2024-01-03 00:00:00", "T", "x", "   ", "h2"),
            ("s5", "sys", "b1", "2024-01-03 00:00:00", "T", "x", "five", None)]
    b = spark.createDataFrame(rows, "source_id string, source_system string, ingest_batch_id string, "
                                    "ingested_at string, raw_title string, raw_category string, "
                                    "raw_body string, file_hash string") \
        .withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))
    got = {r["policy_id"]: r for r in med.silver_benefit_policy(b).collect()}
    assert set(got) == {"s2", "s5"}        # s3 ties with s2 on time, b2 > b1 wins; s4 blank
    assert got["s5"]["category"] == "x"
    rej = {r["reason"]: r["n_rows"] for r in med.silver_rejects(b).collect()}
    assert rej == {"blank_body": 1}


def test_gold_defaults_and_lineage(spark):
    b = ad.bronze_policy(spark, SF01)
    s = med.silver_benefit_policy(b)
    g = med.gold_member_kb(s, ad.active_flags(tables.labels(spark, SF01)))
    assert g.count() == 912
    assert med.lineage_trace(g, s, b).count() == 912
    assert med.lineage_orphans(g, s).count() == 0
    reasons = {r["reason"] for r in med.lineage_dropped(b, s).collect()}
    assert reasons == {"superseded", "empty_body"}


def test_not_null_quarantine(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", "d")], "id int, x string, y string")
    ok, bad = med.dq_not_null(df, ["x", "y"])
    assert [r["id"] for r in ok.collect()] == [3]
    assert {r["id"]: r["dq_reasons"] for r in bad.collect()} == {1: "y_is_null", 2: "x_is_null,y_is_null"}


def test_masking_and_row_policy(spark):
    df = spark.createDataFrame([("e1", "h1", True), ("e2", None, None), ("e3", "h3", False)],
                               "id string, member_id_hash string, is_active boolean")
    agent = gov.apply_masks(df, {"member_id_hash": gov.MEMBER_HASH_MASK}, gov.AGENT_ROLE)
    assert {r["member_id_hash"] for r in agent.collect()} == {"***"}     # NULL is masked too
    analyst = gov.apply_masks(df, {"member_id_hash": gov.MEMBER_HASH_MASK}, gov.ANALYST_ROLE)
    assert {r["member_id_hash"] for r in analyst.collect()} == {"h1", None, "h3"}
    assert [r["id"] for r in gov.apply_row_policy(df, gov.ACTIVE_KB_ONLY, gov.AGENT_ROLE).collect()] == ["e1"]
    assert gov.apply_row_policy(df, gov.ACTIVE_KB_ONLY, gov.ADMIN_ROLE).count() == 3


def test_semantic_model_and_view(spark):
    plans = sem.plan_cost_sharing(spark, date(2024, 1, 1))
    m = sem.member_cost_sharing_model(plans)
    assert m.resolve("Visit Type") == "service_type"
    rows = sem.semantic_query(m, ["care setting"], aggregates={"max_copay": "max(copay_usd)"}).collect()
    assert {r["service_type"]: float(r["max_copay"]) for r in rows}["emergency_room"] == 250.0
    with pytest.raises(KeyError):
        m.resolve("deductible amount")
    with pytest.raises(ValueError):
        sem.semantic_query(m, ["copay_usd"])
    assert sem.member_copay_view(plans, date(2024, 1, 1)).count() == 7
    assert sem.member_copay_view(plans, date(2023, 12, 31)).count() == 0


def test_pk_declared_on_plan_table(spark):
    plans = sem.plan_cost_sharing(spark, date(2024, 1, 1))
    assert med.dq_duplicate_keys(plans, ["plan_code", "service_type"]).count() == 0


def test_ambiguous_synonym(spark):
    plans = sem.plan_cost_sharing(spark, date(2024, 1, 1))
    m = sem.member_cost_sharing_model(plans)
    m.synonyms["cost"] = "copay_usd"
    m.synonyms["COST"] = "coinsurance_pct"
    with pytest.raises(ValueError):
        m.resolve("cost")


def test_member_fact_lookup_with_a_hot_member(spark):
    from datetime import datetime
    from coverwise.operators import medallion as med
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(f"e{i}", "hot", "view" if i % 2 else "click", t(i)) for i in range(9)] + \
           [("x1", "cold", "signup", t(30))]
    ev = spark.createDataFrame(rows, "event_id string, member_id_hash string, event_type string, "
                                     "ingested_at timestamp_ntz")
    facts = {r["member_id_hash"]: r for r in med.member_facts(ev).collect()}
    assert (facts["hot"]["n_events"], facts["hot"]["n_event_types"]) == (9, 2)
    assert (facts["hot"]["first_seen"], facts["hot"]["last_seen"]) == (t(0), t(8))
    req = spark.createDataFrame([("r1", "hot"), ("r2", "nobody")], "req string, member_id_hash string")
    got = {r["req"]: r["n_events"] for r in med.lookup_member_facts(req, med.member_facts(ev)).collect()}
    assert got == {"r1": 9, "r2": None}


def test_version_in_effect_is_a_keyed_range_join(spark):
    from datetime import datetime
    from coverwise.operators import medallion as med
    d = lambda day: datetime(2024, 1, day)
    hist = spark.createDataFrame([("p1", d(1), d(5), "v1"), ("p1", d(5), None, "v2"), ("p2", d(3), None, "w1")],
                                 "id string, valid_from timestamp_ntz, valid_to timestamp_ntz, ver string")
    req = spark.createDataFrame([("p1", d(1)), ("p1", d(4)), ("p1", d(5)), ("p1", d(9)), ("p2", d(2)),
                                 ("p3", d(4))], "id string, at timestamp_ntz")
    out = med.version_in_effect(req, hist, "id", "at")
    got = sorted((r["id"], r["at"].day, r["ver"]) for r in out.collect())
    assert got == [("p1", 1, "v1"), ("p1", 4, "v1"), ("p1", 5, "v2"), ("p1", 9, "v2"),
                   ("p2", 2, None), ("p3", 4, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_latest_wins_with_a_hot_key_holding_a_third_of_rows(spark):
    # 300 landings, 100 of them copies of one file (same hash): one survivor each
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        hot = i % 3 == 0
        rows.append((f"doc-{i}", "s", f"batch_{i % 7}", t0 + timedelta(seconds=i), "t", " en ",
                     "body", "HOT" if hot else f"h{i}"))
    b = spark.createDataFrame(rows, "source_id string, source_system string, ingest_batch_id string, "
                                    "ingested_at timestamp_ntz, raw_title string, raw_category string, "
                                    "raw_body string, file_hash string").repartition(8)
    s = med.silver_benefit_policy(b).collect()
    assert len(s) == 201                                     # 200 cold keys + 1 hot key
    hot = [r for r in s if r["policy_id"] in {f"doc-{i}" for i in range(0, 300, 3)}]
    assert [r["policy_id"] for r in hot] == ["doc-297"]      # the newest landing of the hot file wins


def test_history_closes_updated_and_deactivated_versions(spark):
    from datetime import datetime
    from pyspark.sql import functions as F
    from coverwise.operators import medallion as med
    d = lambda day: datetime(2024, 1, day)
    ddl = ("id string, title string, category string, text string, effective_date date, is_active boolean, "
           "lineage_sk string, updated_at timestamp_ntz")

    def snap(*rows):
        return spark.createDataFrame([(i, "t", "c", text, d(u).date(), active, sk, d(u))
                                      for i, text, active, sk, u in rows], ddl)

    first = snap(("same", "x", True, "s", 1), ("flag", "x", True, "f", 1), ("text", "x", True, "a", 1),
                 ("gone", "x", True, "g", 1))
    second = snap(("same", "x", True, "s", 1), ("flag", "x", False, "f", 1), ("text", "y", True, "b", 5),
                  ("new", "x", True, "n", 6))
    load = F.lit("2024-01-09").cast("timestamp_ntz")
    hist = med.scd2_merge(med.scd2_open(first), second, load)
    day = lambda t: t.day if t else None
    got = sorted((r["id"], day(r["valid_from"]), day(r["valid_to"]) or 0, r["is_active"]) for r in hist.collect())
    assert got == [("flag", 1, 9, True), ("flag", 9, 0, False), ("gone", 1, 9, True), ("new", 6, 0, True),
                   ("same", 1, 0, True), ("text", 1, 5, True), ("text", 5, 0, True)]
    # a load that changes nothing changes no version; a policy that comes back opens a new one
    again = med.scd2_merge(hist, second, F.lit("2024-01-10").cast("timestamp_ntz"))
    assert sorted(map(str, again.collect())) == sorted(map(str, hist.collect()))
    back = med.scd2_merge(hist, second.union(snap(("gone", "x", True, "g", 12))),
                          F.lit("2024-01-13").cast("timestamp_ntz"))
    gone = sorted((day(r["valid_from"]), day(r["valid_to"]) or 0) for r in back.where("id = 'gone'").collect())
    assert gone == [(1, 9), (12, 0)]
    changes = {r["id"]: r["change"] for r in med.merge_gold(first, second).collect()}
    assert changes == {"same": "unchanged", "flag": "update", "text": "update", "gone": "deactivate",
                       "new": "insert"}
