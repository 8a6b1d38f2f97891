"""Evaluation metrics, the promotion gate, the sweep, containment labels and the registry."""
from __future__ import annotations

from pyspark.sql import functions as F

from coverwise.config import QaConfig, configs_frame, grid_configs, sample_configs, SEARCH_SPACE
from coverwise.operators import evaluation as ev
from coverwise.operators import qa
from coverwise.operators import registry as reg
from coverwise.operators import retrieval as rt
from coverwise.sources import tables
from tests.conftest import SF001


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "config_id int, recall_at_k double, answer_accuracy double, "
                                       "composite double")


def test_gate_rejects_below_floor(spark):
    c = _metrics(spark, [(0, 0.5, 0.4, 0.45)])
    r = ev.promotion_gate(c, None, key=[]).first()
    assert r["promote"] is False and r["reason"].startswith("recall")


def test_gate_requires_beating_incumbent(spark):
    c = _metrics(spark, [(0, 0.9, 0.8, 0.85), (1, 0.9, 0.8, 0.86)])
    inc = spark.createDataFrame([(0.85,)], "composite double")
    got = {r["config_id"]: r["promote"] for r in ev.promotion_gate(c, inc, key=[]).collect()}
    assert got == {0: False, 1: True}                      # a tie must not promote


def test_gate_without_incumbent_and_accuracy_floor(spark):
    c = _metrics(spark, [(0, 0.75, 0.5, 0.625), (1, 0.8, 0.49, 0.645)])
    got = {r["config_id"]: (r["promote"], r["reason"]) for r in ev.promotion_gate(c, None, key=[]).collect()}
    assert got[0] == (True, "no_incumbent")      # equality passes
    assert got[1][0] is False and got[1][1].startswith("accuracy")


def test_gate_per_key(spark):
    c = spark.createDataFrame([("a", 0.9, 0.9, 0.9), ("b", 0.9, 0.9, 0.9)],
                              "k string, recall_at_k double, answer_accuracy double, composite double")
    inc = spark.createDataFrame([("a", 0.95)], "k string, composite double")
    got = {r["k"]: r["promote"] for r in ev.promotion_gate(c, inc, key=["k"]).collect()}
    assert got == {"a": False, "b": True}


def test_metrics_rounding_and_empty(spark):
    df = spark.createDataFrame([(1, True, True, 0.5), (1, False, True, 0.25), (1, True, False, 0.125)],
                               "g int, hit boolean, correct boolean, top_score double")
    r = ev.metrics(df, ["g"]).first()
    assert (r["recall_at_k"], r["answer_accuracy"], r["composite"], r["n"]) == (0.6667, 0.6667, 0.6667, 3)
    assert r["avg_top_score"] == 0.2917


def test_containment_pairs_match_brute_force(spark):
    docs = tables.documents(spark, SF001).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text")
    qs = tables.benchmark(spark, SF001).select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    got = {(r["q_id"], r["id"]) for r in ev.containment_pairs(qs, docs).collect()}
    d = [(r["id"], r["text"]) for r in docs.collect()]
    q = [(r["q_id"], r["question"]) for r in qs.collect()]
    want = {(qi, di) for qi, qt in q for di, dt in d if qt in dt}
    assert got == want and len(want) > 0


def test_containment_short_passages(spark):
    docs = spark.createDataFrame([("d1", "alpha beta. gamma"), ("d2", "xbetay"), ("d3", "none")],
                                 "id string, text string")
    qs = spark.createDataFrame([(1, "beta"), (2, "a beta. g"), (3, "zzz")], "q_id long, question string")
    got = {(r["q_id"], r["id"]) for r in ev.containment_pairs(qs, docs).collect()}
    assert got == {(1, "d1"), (1, "d2"), (2, "d1")}


def test_containment_short_passages_brute_force(spark):
    # overlapping, repeated and empty patterns; a null document text matches nothing
    texts = ["abab", "ba", "a b", "xyz", None, "b.a b"]
    passages = ["ab", "b", "ab", "", "a b", "b.a", "q"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    qs = spark.createDataFrame(list(enumerate(passages)), "q_id long, question string")
    got = {(r["q_id"], r["id"]) for r in ev.containment_pairs(qs, docs).collect()}
    want = {(qi, f"d{di}") for qi, q in enumerate(passages) for di, t in enumerate(texts)
            if t is not None and q in t}
    assert got == want


def test_sweep_matches_per_config_runs(spark, kb):
    idx = rt.build_tfidf_index(kb)
    qs = spark.createDataFrame([(0, "When is open enrollment?"), (1, "Do I need prior authorization for an MRI?"),
                                (2, "copay for a specialist visit"), (3, "parking fee nightly")],
                               "q_id long, question string")
    pairs = spark.createDataFrame([(0, "kb-enroll"), (1, "kb-auth"), (2, "kb-copay")], "q_id long, id string")
    must = qs.select("q_id", ev.first_word(F.col("question")).alias("must_include"))
    cfgs = [QaConfig(top_k=1, relevance_threshold=0.3, min_keyword_overlap=0.9, max_rewrites=1),
            QaConfig(top_k=3), QaConfig(top_k=2, max_rewrites=0, relevance_threshold=0.5)]
    sw = {r["config_id"]: r for r in ev.sweep(qs, idx, kb, pairs, must, configs_frame(spark, cfgs)).collect()}
    for i, cfg in enumerate(cfgs):
        a = qa.answer_questions(qs, idx, kb.select("id", "title", "text"), cfg)
        one = ev.evaluate_answers(a, pairs, must).first()
        for m in ("recall_at_k", "answer_accuracy", "composite", "n", "avg_top_score"):
            assert sw[i][m] == one[m], (i, m)


def test_best_trial_earliest_wins(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "config_id int, composite double")
    assert ev.best_trial(df).first()["config_id"] == 1


def test_config_grid_and_sampler():
    g = grid_configs()
    assert len(g) == 54 and g[0] == QaConfig(top_k=1, relevance_threshold=0.05, max_rewrites=0,
                                             min_keyword_overlap=0.0)
    s = sample_configs(20, seed=42)
    assert s == sample_configs(20, seed=42) and len(set(s)) == 20
    for c in s:
        assert SEARCH_SPACE["top_k"][1] <= c.top_k <= SEARCH_SPACE["top_k"][2]
        assert 0.02 <= c.relevance_threshold <= 0.30 and c.prompt_version in ("v1", "v2")
    assert QaConfig.from_dict({"top_k": 5, "unknown": 1}) == QaConfig(top_k=5)


def test_registry_register_promote_archive(spark):
    regs = reg.assign_versions(spark.createDataFrame(
        [("m", 1, 10), ("m", 2, 20), ("n", 3, 5)], "model_key string, event_seq int, created_at int"))
    promos = spark.createDataFrame([("m", 1, 1, 11), ("m", 2, 2, 21)],
                                   "model_key string, version int, event_seq int, at int")
    state = {(r["model_key"], r["version"]): r["stage"] for r in reg.registry_state(regs, promos).collect()}
    assert state == {("m", 1): "Archived", ("m", 2): "Production", ("n", 1): "Staging"}
    prod = {r["model_key"]: r["version"] for r in reg.production(reg.registry_state(regs, promos)).collect()}
    assert prod == {"m": 2}
    latest = {r["model_key"]: (r["version"], r["stage"]) for r in reg.latest(reg.registry_state(regs, promos)).collect()}
    assert latest == {"m": (2, "Production"), "n": (1, "Staging")}


def test_registry_repromote_and_unknown(spark):
    regs = reg.assign_versions(spark.createDataFrame([("m", 1, 1), ("m", 2, 2)],
                                                     "model_key string, event_seq int, created_at int"))
    promos = spark.createDataFrame([("m", 1, 1, 1), ("m", 2, 2, 2), ("m", 1, 3, 3), ("m", 9, 4, 4)],
                                   "model_key string, version int, event_seq int, at int")
    state = {r["version"]: r["stage"] for r in reg.registry_state(regs, promos).collect()}
    assert state == {1: "Production", 2: "Archived"}      # unknown version 9 is ignored
    assert [r["version"] for r in reg.unknown_promotions(regs, promos).collect()] == [9]


def test_slice_gate_all_slices_must_pass(spark):
    rows = spark.createDataFrame(
        [("m", "a", True, True, 0.5, 2), ("m", "a", True, False, 0.4, 2), ("m", "b", True, True, 0.3, 2),
         ("m", "b", True, True, 0.3, 4), ("m", "b", True, True, 0.3, 4),
         ("n", "a", True, True, 0.9, 2), ("n", "b", False, True, 0.9, 2)],
        "model string, tenant string, hit boolean, correct boolean, top_score double, cost int")
    got = {(r["model"], r["tenant"]): r for r in
           ev.slice_gate(rows, "tenant", key=["model"], max_p95_cost=3.0).collect()}
    assert got[("m", "a")]["slice_ok"] and got[("m", "a")]["p95_cost"] == 2.0
    # cost [2, 4, 4]: linear-interpolated 95th percentile is 4.0, above the ceiling
    assert not got[("m", "b")]["slice_ok"] and got[("m", "b")]["reason"] == "p95 cost 4.0 above ceiling 3.0"
    assert got[("n", "b")]["reason"] == "recall 0.0 below floor 0.75"
    assert {k: r["promote"] for k, r in got.items()} == {
        ("m", "a"): False, ("m", "b"): False, ("n", "a"): False, ("n", "b"): False}
    loose = {r["tenant"]: r["promote"] for r in
             ev.slice_gate(rows.where("model = 'm'"), "tenant", max_p95_cost=4.0).collect()}
    assert loose == {"a": True, "b": True}                  # one global decision, all slices pass


def test_registry_log_reopened_and_appended(spark, tmp_path):
    from coverwise.operators import registry as reg
    log = str(tmp_path / "registry")
    ddl = "model_key string, config_id int, event_seq int, created_at int"
    promo = "model_key string, event_seq int, at int, version int"
    reg.append_events(spark.createDataFrame([("m", 7, 0, 0), ("m", 8, 1, 1), ("m", 9, 2, 2)], ddl),
                      spark.createDataFrame([("m", 0, 3, 1)], promo), log)
    reg.append_events(None, spark.createDataFrame([("m", 1, 4, 2)], promo), log)
    regs, promos = reg.read_events(spark, log)
    state = reg.registry_state(reg.assign_versions(regs), promos)
    assert {r["version"]: r["stage"] for r in state.collect()} == {1: "Archived", 2: "Production", 3: "Staging"}
