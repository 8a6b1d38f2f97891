"""Evaluation, sweep, gate and registry queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import QaConfig, configs_frame, grid_configs
from ..operators import evaluation as ev
from ..operators import registry as reg
from ..sources import sinks, tables
from ..sources.json_docs import read_eval_set
from ..session import materialize, scratch_path
from .catalog import query
from .qa_q import _MARK, DEFAULT, answers, sql_overlap, sql_rewrite, sql_strip, sql_words
from .retrieval_q import Ctx, sql_topk
from .sqlkit import cte, statement

GRID = grid_configs()

# -- oracle building blocks -------------------------------------------------------------

cte("ev_pairs", """
SELECT b.item_id AS q_id, 'doc-' || CAST(d.doc_id AS VARCHAR) AS id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
cte("ev_must", "SELECT item_id AS q_id, regexp_extract(text, '[\\p{L}\\p{N}_]+') AS w FROM benchmark")
cte("configs", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {c.top_k}, {c.relevance_threshold}, {c.max_rewrites}, {c.max_regenerations}, "
    f"{c.min_keyword_overlap}, '{c.prompt_version}')" for i, c in enumerate(GRID))
    + ") AS t(config_id, top_k, relevance_threshold, max_rewrites, max_regenerations, "
      "min_keyword_overlap, prompt_version)")


def sql_correct(answer: str, word: str) -> str:
    return f"({word} = '' OR contains(lower({answer}), lower({word})))"


def sql_metrics(src: str, by: str) -> str:
    gb = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
SELECT {sel}count(*) AS n,
       round_even(coalesce(avg(CAST(hit AS DOUBLE)), 0.0), 4) AS recall_at_k,
       round_even(coalesce(avg(CAST(correct AS DOUBLE)), 0.0), 4) AS answer_accuracy,
       round_even(0.5 * coalesce(avg(CAST(hit AS DOUBLE)), 0.0)
                  + 0.5 * coalesce(avg(CAST(correct AS DOUBLE)), 0.0), 4) AS composite,
       round_even(coalesce(avg(top_score), 0.0), 4) AS avg_top_score
FROM {src} {gb}"""


cte("ev_default_rows", f"""
SELECT q.q_id,
       EXISTS (SELECT 1 FROM qad_docs d JOIN ev_pairs p ON p.q_id = d.q_id AND p.id = d.id
               WHERE d.q_id = q.q_id) AS hit,
       {sql_correct('q.answer', 'm.w')} AS correct, q.top_score
FROM qad_qa q JOIN ev_must m USING (q_id)""", "qad_qa", "ev_pairs", "ev_must")
cte("ev_default", sql_metrics("ev_default_rows", ""), "ev_default_rows")

# sweep: both passes at the largest k, answers per (pass, k, question)
_KS = sorted({c.top_k for c in GRID})
_KMAX = max(_KS)
_sw0 = sql_topk("sw0", "q_src", _KMAX, True)
cte("sw_q1", f"SELECT q_id, {sql_rewrite('question')} AS question FROM q_src", "q_src")
_sw1 = sql_topk("sw1", "sw_q1", _KMAX, True)
cte("sw_docs", f"""
SELECT t.pass, k.k, t.q_id, t.rank, t.id, t.score, c.title, c.text, p.q_id IS NOT NULL AS rel
FROM (SELECT 0 AS pass, * FROM {_sw0} UNION ALL SELECT 1 AS pass, * FROM {_sw1}) t
JOIN (SELECT unnest({_KS}) AS k) k ON t.rank <= k.k
JOIN search_corpus c ON c.id = t.id
LEFT JOIN (SELECT DISTINCT q_id, id FROM ev_pairs) p ON p.q_id = t.q_id AND p.id = t.id""",
    _sw0, _sw1, "search_corpus", "ev_pairs")
cte("sw_ctx", """
SELECT pass, k, q_id,
       string_agg('[' || title || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context,
       bool_or(rel) AS hit, arg_min(score, rank) AS top_score
FROM sw_docs GROUP BY pass, k, q_id""", "sw_docs")
cte("sw_sents", f"""
SELECT pass, k, q_id, parts[idx] AS s, idx
FROM (SELECT pass, k, q_id, parts, generate_subscripts(parts, 1) AS idx
      FROM (SELECT pass, k, q_id,
                   string_split(regexp_replace(replace(context, chr(10), ' '),
                                               '([.!?])\\s+', '\\1{_MARK}', 'g'), '{_MARK}') AS parts
            FROM sw_ctx))""", "sw_ctx")
cte("sw_best", f"""
SELECT pass, k, q_id, string_agg({sql_strip('s')}, ' ' ORDER BY rn) AS best
FROM (SELECT x.pass, x.k, x.q_id, x.s,
             row_number() OVER (PARTITION BY x.pass, x.k, x.q_id ORDER BY x.ov DESC, x.idx) AS rn
      FROM (SELECT s.pass, s.k, s.q_id, s.s, s.idx,
                   len(list_intersect({sql_words('q.question')}, {sql_words('s.s')})) AS ov
            FROM sw_sents s JOIN q_src q USING (q_id)) x
      WHERE x.ov > 0)
WHERE rn <= 2 GROUP BY pass, k, q_id""", "sw_sents", "q_src")
cte("sw_var", f"""
SELECT c.pass, c.k, c.q_id, c.hit, c.top_score,
       CASE WHEN length({sql_strip('c.context')}) = 0 THEN 'fallback'
            WHEN b.best IS NOT NULL THEN b.best ELSE {sql_strip('f.s')} END AS answer
FROM sw_ctx c LEFT JOIN sw_best b USING (pass, k, q_id)
LEFT JOIN (SELECT pass, k, q_id, s FROM sw_sents WHERE idx = 1) f USING (pass, k, q_id)""",
    "sw_ctx", "sw_best", "sw_sents")
cte("sw_g0", f"""
SELECT q.q_id, t.score, {sql_overlap('q.question', "c.title || ' ' || c.text")} AS ov
FROM q_src q LEFT JOIN {_sw0} t ON t.q_id = q.q_id AND t.rank = 1
LEFT JOIN search_corpus c ON c.id = t.id""", "q_src", _sw0, "search_corpus")
cte("sw_rows", f"""
SELECT config_id,
       CASE WHEN use1 THEN hit1 ELSE hit0 END AS hit,
       {sql_correct('CASE WHEN use1 THEN a1 ELSE a0 END', 'w')} AS correct,
       CASE WHEN use1 THEN s1 ELSE s0 END AS top_score
FROM (SELECT c.config_id, v0.hit AS hit0, v1.hit AS hit1, v0.answer AS a0, v1.answer AS a1,
             v0.top_score AS s0, v1.top_score AS s1, m.w,
             NOT coalesce(g.score >= c.relevance_threshold OR g.ov >= c.min_keyword_overlap, FALSE)
               AND c.max_rewrites > 0 AS use1
      FROM configs c
      JOIN sw_var v0 ON v0.k = c.top_k AND v0.pass = 0
      JOIN sw_var v1 ON v1.q_id = v0.q_id AND v1.k = v0.k AND v1.pass = 1
      JOIN sw_g0 g ON g.q_id = v0.q_id
      JOIN ev_must m ON m.q_id = v0.q_id)""", "configs", "sw_var", "sw_g0", "ev_must")
cte("sweep", f"""
SELECT c.*, coalesce(m.recall_at_k, 0.0) AS recall_at_k,
       coalesce(m.answer_accuracy, 0.0) AS answer_accuracy,
       coalesce(m.composite, 0.0) AS composite, coalesce(m.n, 0) AS n,
       coalesce(m.avg_top_score, 0.0) AS avg_top_score
FROM configs c LEFT JOIN ({sql_metrics('sw_rows', 'config_id')}) m USING (config_id)""",
    "configs", "sw_rows")
# Floors some trials clear on the driver tables, so that promotion itself is compared: a query
# parameter, like the default floors.
LOW_FLOORS = {"recall_at_k": 0.05, "answer_accuracy": 0.4}


def sql_gate(name: str, floors: dict[str, float]) -> str:
    fr, fa = floors["recall_at_k"], floors["answer_accuracy"]
    return cte(name, f"""
SELECT s.config_id, s.recall_at_k, s.answer_accuracy, s.composite, i.composite AS incumbent_composite,
       s.recall_at_k >= {fr} AND s.answer_accuracy >= {fa}
         AND (i.composite IS NULL OR s.composite > i.composite) AS promote,
       CASE WHEN s.recall_at_k < {fr} THEN 'recall_below_floor'
            WHEN s.answer_accuracy < {fa} THEN 'accuracy_below_floor'
            WHEN i.composite IS NULL THEN 'no_incumbent'
            WHEN s.composite > i.composite THEN 'beats_incumbent' ELSE 'not_better' END AS reason
FROM sweep s LEFT JOIN ev_default i ON TRUE""", "sweep", "ev_default")


def sql_stages(name: str, gate: str) -> str:
    return cte(name, f"""
SELECT 'qa' AS model_key, config_id, config_id + 1 AS version,
       CASE WHEN config_id = (SELECT max(config_id) FROM {gate} WHERE promote) THEN 'Production'
            WHEN promote THEN 'Archived' ELSE 'Staging' END AS stage
FROM {gate}""", gate)


sql_gate("gate", ev.PROMOTION_FLOORS)
sql_stages("reg_state", "gate")
sql_gate("gate_low", LOW_FLOORS)
sql_stages("reg_low", "gate_low")

# -- Spark side ---------------------------------------------------------------------

def eval_inputs(ctx: Ctx):
    if "_eval_inputs" in ctx.__dict__:
        return ctx.__dict__["_eval_inputs"]
    qs = ctx.questions
    docs = tables.documents(ctx.spark, ctx.sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text")
    pairs = materialize(ev.containment_pairs(qs, docs), "pairs")
    must = qs.select("q_id", ev.first_word(F.col("question")).alias("must_include"))
    ctx.__dict__["_eval_inputs"] = (qs, pairs, must)
    return qs, pairs, must


def default_metrics(ctx: Ctx):
    _, pairs, must = eval_inputs(ctx)
    return ev.evaluate_answers(answers(ctx, DEFAULT), pairs, must)


def sweep_results(ctx: Ctx):
    qs, pairs, must = eval_inputs(ctx)
    return ev.sweep(qs, ctx.index_reused, ctx.docs_text, pairs, must,
                    configs_frame(ctx.spark, GRID))


def gate_results(ctx: Ctx, floors: dict[str, float] | None = None):
    return ev.promotion_gate(sweep_results(ctx), default_metrics(ctx), key=[], floors=floors)


GATE_COLUMNS = ["config_id", "promote", "reason", "recall_at_k", "answer_accuracy", "composite",
                "incumbent_composite"]


def registry_frames(ctx: Ctx, floors: dict[str, float] | None = None):
    g = materialize(gate_results(ctx, floors).withColumn("model_key", F.lit("qa")), "gate")
    regs = reg.assign_versions(g.select("model_key", "config_id",
                                        F.col("config_id").alias("event_seq"),
                                        F.col("config_id").alias("created_at")))
    promos = g.where("promote").select("model_key", F.col("config_id").alias("event_seq"),
                                       F.col("config_id").alias("at"),
                                       (F.col("config_id") + 1).alias("version"))
    return regs, promos


@query("eval_relevance_pairs", statement("SELECT q_id, id FROM ev_pairs", "ev_pairs"), ops=("J3",))
def q_eval_pairs(spark, sf_dir):
    _, pairs, _ = eval_inputs(Ctx(spark, sf_dir))
    return pairs


@query("eval_set", statement("""
SELECT m.q_id, count(p.id) AS n_relevant, m.w AS must_include
FROM ev_must m LEFT JOIN ev_pairs p USING (q_id) GROUP BY m.q_id, m.w""", "ev_must", "ev_pairs"),
    ops=("S2",))
def q_eval_set(spark, sf_dir):
    qs, pairs, must = eval_inputs(Ctx(spark, sf_dir))
    n = pairs.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return must.join(n, "q_id", "left").select(
        "q_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        F.coalesce(F.element_at("must_include", 1), F.lit("")).alias("must_include"))


@query("eval_set_from_json", """
SELECT CAST(item_id AS VARCHAR) AS id, text AS question,
       regexp_extract(text, '[\\p{L}\\p{N}_]+') AS must_include, 1 AS n_must
FROM benchmark WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')""", ops=("S2",))
def q_eval_set_from_json(spark, sf_dir):
    """The eval set written as JSON lines and read back through the eval-set reader."""
    path = scratch_path(spark, "eval_json", uuid.uuid4().hex)
    tables.benchmark(spark, sf_dir).select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        ev.first_word(F.col("text")).alias("must_include")).write.json(path)
    got = read_eval_set(spark, path, multiline=False)
    return got.where(F.size("must_include") > 0).select(
        "id", "question", F.col("must_include")[0].alias("must_include"), F.size("must_include").alias("n_must"))


@query("eval_recall", statement("SELECT recall_at_k, n FROM ev_default", "ev_default"), ops=("E1", "J3"))
def q_eval_recall(spark, sf_dir):
    return default_metrics(Ctx(spark, sf_dir)).select("recall_at_k", "n")


@query("eval_accuracy", statement("SELECT answer_accuracy, n FROM ev_default", "ev_default"),
       ops=("E2",))
def q_eval_accuracy(spark, sf_dir):
    return default_metrics(Ctx(spark, sf_dir)).select("answer_accuracy", "n")


@query("eval_metrics", statement("SELECT * FROM ev_default", "ev_default"), ops=("E3", "A5"))
def q_eval_metrics(spark, sf_dir):
    return default_metrics(Ctx(spark, sf_dir))


@query("config_sweep", statement("SELECT * FROM sweep", "sweep"), ops=("E5", "J6"))
def q_config_sweep(spark, sf_dir):
    return sweep_results(Ctx(spark, sf_dir))


@query("best_trial", statement("""
SELECT * FROM sweep ORDER BY composite DESC, config_id LIMIT 1""", "sweep"), ops=("E6",))
def q_best_trial(spark, sf_dir):
    return ev.best_trial(sweep_results(Ctx(spark, sf_dir)))


@query("promotion_gate", statement(
    f"SELECT {', '.join(GATE_COLUMNS)} FROM gate", "gate"), ops=("E4", "J4"))
def q_promotion_gate(spark, sf_dir):
    return gate_results(Ctx(spark, sf_dir)).select(*GATE_COLUMNS)


@query("promotion_gate_low_floors", statement(
    f"SELECT {', '.join(GATE_COLUMNS)} FROM gate_low", "gate_low"), ops=("E4", "J4"))
def q_promotion_gate_low(spark, sf_dir):
    return gate_results(Ctx(spark, sf_dir), LOW_FLOORS).select(*GATE_COLUMNS)


@query("registry_replay", statement(
    "SELECT model_key, config_id, version, stage FROM reg_low", "reg_low"), ops=("L2", "L3", "S10"))
def q_registry_replay(spark, sf_dir):
    # events appended to a written log, reopened and replayed
    regs, promos = registry_frames(Ctx(spark, sf_dir), LOW_FLOORS)
    log = scratch_path(spark, "registry", uuid.uuid4().hex)
    reg.append_events(regs.drop("version"), promos, log)
    registrations, promotions = reg.read_events(spark, log)
    return reg.registry_state(reg.assign_versions(registrations), promotions).select(
        "model_key", "config_id", "version", "stage")


@query("registry_commits", statement(
    "SELECT model_key, config_id, version, stage FROM reg_low", "reg_low"), ops=("L1", "L2", "S10"))
def q_registry_commits(spark, sf_dir):
    # three commits to one log: trials in two halves by their order, then the promotions
    regs, promos = registry_frames(Ctx(spark, sf_dir), LOW_FLOORS)
    log = scratch_path(spark, "registry_commits", uuid.uuid4().hex)
    half = len(GRID) // 2
    events = regs.drop("version")
    reg.commit(spark, log, events.where(F.col("event_seq") < half))
    reg.commit(spark, log, events.where(F.col("event_seq") >= half), after=0)      # a writer that has not seen the first
    reg.commit(spark, log, promotions=promos)
    registrations, promotions = reg.read_commits(spark, log)
    return reg.registry_state(registrations, promotions).select("model_key", "config_id", "version", "stage")


@query("registry_register", statement(
    "SELECT model_key, config_id, version FROM reg_state", "reg_state"), ops=("L1",))
def q_registry_register(spark, sf_dir):
    regs, _ = registry_frames(Ctx(spark, sf_dir))
    return regs.select("model_key", "config_id", "version")


@query("registry_promote", statement(
    "SELECT model_key, config_id, version, stage FROM reg_state", "reg_state"), ops=("L2", "S10"))
def q_registry_promote(spark, sf_dir):
    regs, promos = registry_frames(Ctx(spark, sf_dir))
    return reg.registry_state(regs, promos).select("model_key", "config_id", "version", "stage")


@query("registry_production", statement(
    "SELECT model_key, max(version) AS version FROM reg_state WHERE stage = 'Production' "
    "GROUP BY model_key", "reg_state"), ops=("L3",))
def q_registry_production(spark, sf_dir):
    regs, promos = registry_frames(Ctx(spark, sf_dir))
    return reg.production(reg.registry_state(regs, promos))


@query("registry_latest", statement("""
SELECT model_key, max(version) AS version, arg_max(stage, version) AS stage
FROM reg_state GROUP BY model_key""", "reg_state"), ops=("L4",))
def q_registry_latest(spark, sf_dir):
    regs, promos = registry_frames(Ctx(spark, sf_dir))
    return reg.latest(reg.registry_state(regs, promos))


@query("run_log", statement("""
SELECT 'trial-' || CAST(config_id AS VARCHAR) AS run_name,
       CAST(top_k AS VARCHAR) AS p_top_k,
       CAST(CAST(relevance_threshold AS DOUBLE) AS VARCHAR) AS p_relevance_threshold,
       CAST(max_rewrites AS VARCHAR) AS p_max_rewrites,
       CAST(max_regenerations AS VARCHAR) AS p_max_regenerations,
       CAST(CAST(min_keyword_overlap AS DOUBLE) AS VARCHAR) AS p_min_keyword_overlap,
       prompt_version AS p_prompt_version,
       recall_at_k AS m_recall_at_k, answer_accuracy AS m_answer_accuracy, composite AS m_composite,
       CAST(n AS DOUBLE) AS m_n, avg_top_score AS m_avg_top_score
FROM sweep""", "sweep"), ops=("S9",))
def q_run_log(spark, sf_dir):
    path = scratch_path(spark, "runs", uuid.uuid4().hex)
    sinks.append_runs(sweep_results(Ctx(spark, sf_dir)), path)
    runs = sinks.read_runs(spark, path)
    # every logged parameter and metric read back from the JSON-lines log
    return runs.select("run_name",
                       *[F.col("params")[c].alias(f"p_{c}") for c in sinks.PARAM_COLS],
                       *[F.col("metrics")[c].alias(f"m_{c}") for c in sinks.METRIC_COLS])
