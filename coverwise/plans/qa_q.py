"""Question-answering queries (K1-K10) over benchmark questions and the gold corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import QaConfig
from ..functions.text import keyword_overlap
from ..operators import qa, qa_loop
from ..operators import retrieval as rt
from ..session import materialize
from .catalog import query
from .retrieval_q import Ctx, sql_topk
from .sqlkit import cte, statement

DEFAULT = QaConfig()
STRICT = QaConfig(relevance_threshold=0.99, min_keyword_overlap=0.99, max_rewrites=2)
REGEN = QaConfig(max_regenerations=2)

_MARK = ""


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sql_words(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9]+'))"


def sql_overlap(q: str, d: str) -> str:
    return (f"CASE WHEN len({sql_words(q)}) = 0 THEN 0.0 "
            f"ELSE len(list_intersect({sql_words(q)}, {sql_words(d)})) / len({sql_words(q)}) END")


_RULES_SQL = "[" + ", ".join(
    "{'kw': '%s', 'ex': '%s'}" % (k, e) for k, e in qa.REWRITE_RULES) + "]"


def sql_rewrite(q: str) -> str:
    hints = (f"list_transform(list_filter({_RULES_SQL}, lambda r: contains(lower({q}), r.kw)), "
             f"lambda r: r.ex)")
    return sql_strip(f"{q} || CASE WHEN len({hints}) > 0 THEN ' ' || array_to_string({hints}, ' ') "
                     f"ELSE '{qa.GENERIC_SUFFIX}' END")


def sql_qa(p: str, cfg: QaConfig) -> str:
    """Register the QA CTE chain for one config; returns the name of the result CTE."""
    k, thr, floor = cfg.top_k, cfg.relevance_threshold, cfg.min_keyword_overlap
    mr, mg = cfg.max_rewrites, cfg.max_regenerations
    t0 = sql_topk(f"{p}0", "q_src", k, True)
    cte(f"{p}_g0", f"""
SELECT q.q_id, q.question, t.score AS top_score,
       {sql_overlap('q.question', "c.title || ' ' || c.text")} AS overlap,
       coalesce(t.score >= {thr} OR {sql_overlap('q.question', "c.title || ' ' || c.text")} >= {floor},
                FALSE) AS ok0
FROM q_src q LEFT JOIN {t0} t ON t.q_id = q.q_id AND t.rank = 1
LEFT JOIN search_corpus c ON c.id = t.id""", "q_src", t0, "search_corpus")
    cte(f"{p}_need", f"""
SELECT q_id, question, {sql_rewrite('question')} AS query1 FROM {p}_g0
WHERE NOT ok0 AND {mr} > 0""", f"{p}_g0")
    cte(f"{p}_q1", f"SELECT q_id, query1 AS question FROM {p}_need", f"{p}_need")
    t1 = sql_topk(f"{p}1", f"{p}_q1", k, True)
    cte(f"{p}_g1", f"""
SELECT n.q_id, n.query1,
       coalesce(t.score >= {thr} OR {sql_overlap('n.question', "c.title || ' ' || c.text")} >= {floor},
                FALSE) AS ok1
FROM {p}_need n LEFT JOIN {t1} t ON t.q_id = n.q_id AND t.rank = 1
LEFT JOIN search_corpus c ON c.id = t.id""", f"{p}_need", t1)
    cte(f"{p}_flow", f"""
SELECT g.q_id, g.question, g.ok0, r.query1, r.ok1,
       CASE WHEN g.ok0 OR {mr} = 0 THEN 0 WHEN coalesce(r.ok1, FALSE) THEN 1 ELSE {mr} END
         AS rewrite_count
FROM {p}_g0 g LEFT JOIN {p}_g1 r USING (q_id)""", f"{p}_g0", f"{p}_g1")
    cte(f"{p}_docs", f"""
SELECT f.q_id, t.rank, t.id, t.score, c.title, c.text
FROM {p}_flow f
JOIN (SELECT *, 0 AS pass FROM {t0} UNION ALL SELECT *, 1 AS pass FROM {t1}) t
  ON t.q_id = f.q_id AND t.pass = CASE WHEN f.rewrite_count > 0 THEN 1 ELSE 0 END
JOIN search_corpus c ON c.id = t.id""", f"{p}_flow", t0, t1)
    cte(f"{p}_ctx", f"""
SELECT q_id,
       string_agg('[' || title || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context,
       string_agg(text, ' ' ORDER BY rank) AS texts,
       string_agg(id, ',' ORDER BY rank) AS context_ids,
       arg_min(id, rank) AS top_id, arg_min(score, rank) AS top_score
FROM {p}_docs GROUP BY q_id""", f"{p}_docs")
    cte(f"{p}_sents", f"""
SELECT q_id, parts[idx] AS s, idx
FROM (SELECT q_id, parts, generate_subscripts(parts, 1) AS idx
      FROM (SELECT q_id, string_split(regexp_replace(replace(context, chr(10), ' '),
                                                     '([.!?])\\s+', '\\1{_MARK}', 'g'), '{_MARK}') AS parts
            FROM {p}_ctx))""", f"{p}_ctx")
    cte(f"{p}_best", f"""
SELECT q_id, string_agg({sql_strip('s')}, ' ' ORDER BY rn) AS best
FROM (SELECT s.q_id, s.s, row_number() OVER (PARTITION BY s.q_id ORDER BY s.ov DESC, s.idx) AS rn
      FROM (SELECT x.q_id, x.s, x.idx,
                   len(list_intersect({sql_words('f.question')}, {sql_words('x.s')})) AS ov
            FROM {p}_sents x JOIN {p}_flow f USING (q_id)) s
      WHERE s.ov > 0)
WHERE rn <= 2 GROUP BY q_id""", f"{p}_sents", f"{p}_flow")
    cte(f"{p}_ans", f"""
SELECT f.q_id, f.question, f.rewrite_count, f.ok0, f.ok1, f.query1, c.texts, c.context_ids,
       c.top_id, c.top_score,
       CASE WHEN c.context IS NULL OR length({sql_strip('c.context')}) = 0
            THEN '{qa.FALLBACK_ANSWER.replace("'", "''")}'
            WHEN b.best IS NOT NULL THEN b.best
            ELSE {sql_strip('fs.s')} END AS answer
FROM {p}_flow f LEFT JOIN {p}_ctx c USING (q_id) LEFT JOIN {p}_best b USING (q_id)
LEFT JOIN (SELECT q_id, s FROM {p}_sents WHERE idx = 1) fs USING (q_id)""",
        f"{p}_flow", f"{p}_ctx", f"{p}_best", f"{p}_sents")
    cte(f"{p}_qa", f"""
SELECT q_id, question,
       CASE WHEN rewrite_count > 0 THEN query1 ELSE question END AS final_query,
       rewrite_count, rewrite_count + 1 AS n_retrieves,
       CASE WHEN rewrite_count > 0 THEN ok1 ELSE ok0 END AS retrieval_ok,
       top_id, top_score, answer, answer_ok,
       CASE WHEN answer_ok THEN 0 ELSE {mg} + 1 END AS regen_count,
       CASE WHEN answer_ok THEN 1 ELSE {mg} + 1 END AS n_generations,
       context_ids
FROM (SELECT *, length({sql_strip('answer')}) > 0
            AND len(list_intersect({sql_words('texts')}, {sql_words(sql_strip('answer'))})) >= 3
            AND NOT contains(lower({sql_strip('answer')}), '{qa.FALLBACK_PHRASE}') AS answer_ok
      FROM {p}_ans)""", f"{p}_ans")
    return f"{p}_qa"


def answers(ctx: Ctx, cfg: QaConfig):
    return qa.answer_questions(ctx.questions, ctx.index_reused, ctx.docs_text, cfg)


QA_COLS = ["q_id", "final_query", "rewrite_count", "n_retrieves", "retrieval_ok", "top_id",
           "top_score", "answer", "answer_ok", "regen_count", "n_generations", "context_ids"]


@query("keyword_overlap", statement(
    "SELECT q_id, round(overlap, 6) AS overlap FROM qad_g0", sql_qa("qad", DEFAULT)),
    ops=("K1",))
def q_keyword_overlap(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    qs = ctx.questions
    top = rt.tfidf_topk(qs, ctx.index_reused, DEFAULT.top_k, pad=True).where(F.col("rank") == 1)
    top = materialize(top, "ranked")
    c = rt.texts_of(ctx.corpus.select("id", "title", "text"), top)
    j = qs.join(top, "q_id", "left").join(c, "id", "left")
    ov = F.when(F.col("id").isNull(), F.lit(None).cast("double")).otherwise(
        keyword_overlap(F.col("question"), F.concat(F.col("title"), F.lit(" "), F.col("text"))))
    return j.select("q_id", F.round(ov, 6).alias("overlap"))


@query("grade_retrieval", statement(
    "SELECT q_id, top_score, round(overlap, 6) AS overlap, ok0 AS retrieval_ok FROM qad_g0",
    "qad_g0"), ops=("K2",))
def q_grade_retrieval(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    qs = ctx.questions
    c = ctx.corpus
    top = rt.tfidf_topk(qs, ctx.index, DEFAULT.top_k, pad=True)
    g = qa.gather_pass(top, c, qs)
    return g.select("q_id", "top_score", F.round("overlap", 6).alias("overlap"),
                    qa.grade_retrieval(F.col("top_score"), F.col("overlap"),
                                       DEFAULT.relevance_threshold,
                                       DEFAULT.min_keyword_overlap).alias("retrieval_ok"))


@query("rewrite_query", statement(
    f"SELECT q_id, {sql_rewrite('question')} AS query1 FROM q_src", "q_src"), ops=("K3",))
def q_rewrite_query(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return ctx.questions.select("q_id", qa.rewrite(F.col("question")).alias("query1"))


@query("rewrite_loop", statement(
    "SELECT q_id, final_query, rewrite_count, n_retrieves, retrieval_ok FROM qas_qa",
    sql_qa("qas", STRICT)), ops=("K4",))
def q_rewrite_loop(spark, sf_dir):
    return answers(Ctx(spark, sf_dir), STRICT).select(
        "q_id", "final_query", "rewrite_count", "n_retrieves", "retrieval_ok")


@query("extractive_answer", statement(
    "SELECT q_id, context_ids, answer FROM qad_qa", "qad_qa"), ops=("K5", "K6"))
def q_extractive_answer(spark, sf_dir):
    return answers(Ctx(spark, sf_dir), DEFAULT).select("q_id", "context_ids", "answer")


@query("grade_answer", statement("SELECT q_id, answer_ok FROM qad_qa", "qad_qa"), ops=("K7",))
def q_grade_answer(spark, sf_dir):
    return answers(Ctx(spark, sf_dir), DEFAULT).select("q_id", "answer_ok")


@query("regen_accounting", statement(
    "SELECT q_id, answer_ok, regen_count, n_generations FROM qar_qa", sql_qa("qar", REGEN)),
    ops=("K8",))
def q_regen(spark, sf_dir):
    return answers(Ctx(spark, sf_dir), REGEN).select("q_id", "answer_ok", "regen_count", "n_generations")


@query("qa_end_to_end", statement(f"SELECT {', '.join(QA_COLS)} FROM qad_qa", "qad_qa"),
       ops=("K9", "R10"))
def q_qa_end_to_end(spark, sf_dir):
    return answers(Ctx(spark, sf_dir), DEFAULT).select(*QA_COLS)


@query("qa_trace", statement("""
SELECT q_id, CAST(3 * r AS INTEGER) AS seq, 'retrieve' AS step, CAST(r AS INTEGER) AS round,
       CASE WHEN r = 0 THEN question ELSE final_query END AS detail
FROM (SELECT *, unnest(range(0, rewrite_count + 1)) AS r FROM qas_qa)
UNION ALL
SELECT q_id, CAST(3 * r + 1 AS INTEGER), 'grade_retrieval', CAST(r AS INTEGER),
       CASE WHEN r = rewrite_count THEN CAST(retrieval_ok AS VARCHAR) ELSE 'false' END
FROM (SELECT *, unnest(range(0, rewrite_count + 1)) AS r FROM qas_qa)
UNION ALL
SELECT q_id, CAST(3 * r + 2 AS INTEGER), 'rewrite_query', CAST(r AS INTEGER), final_query
FROM (SELECT *, unnest(range(0, rewrite_count)) AS r FROM qas_qa)
UNION ALL
SELECT q_id, CAST(3 * rewrite_count + 2 * g AS INTEGER), 'generate', CAST(g AS INTEGER),
       CAST(length(answer) AS VARCHAR)
FROM (SELECT *, unnest(range(1, n_generations + 1)) AS g FROM qas_qa)
UNION ALL
SELECT q_id, CAST(3 * rewrite_count + 2 * g + 1 AS INTEGER), 'grade_answer', CAST(g AS INTEGER),
       CAST(answer_ok AS VARCHAR)
FROM (SELECT *, unnest(range(1, n_generations + 1)) AS g FROM qas_qa)""", "qas_qa"), ops=("K10",))
def q_qa_trace(spark, sf_dir):
    a = answers(Ctx(spark, sf_dir), STRICT)
    t = qa.qa_trace(a, STRICT)
    return t.select("q_id", F.posexplode("trace").alias("seq", "ev")).select(
        "q_id", "seq", "ev.step", "ev.round", "ev.detail")


# -- rounds with parts of the caller's choice ----------------------------------------------

@query("qa_rounds", statement(f"SELECT {', '.join(QA_COLS)} FROM qas_qa", "qas_qa"), ops=("K4", "K9", "R10"))
def q_qa_rounds(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return qa.answer_questions(ctx.questions, ctx.index_reused, ctx.docs_text, STRICT,
                               retriever=qa_loop.keyword_retriever(ctx.index_reused)).select(*QA_COLS)


#: Some questions pass at once, some after one or two rewrites, some never.
ROUNDS = QaConfig(relevance_threshold=0.06, min_keyword_overlap=0.6, max_rewrites=3)


def later_words(question, query_, round_no):
    """The question without its first 4 * round words: a rule whose query differs in every round."""
    words = F.split(question, " ")
    return F.array_join(F.slice(words, 4 * round_no + 1, F.greatest(F.size(words), F.lit(1))), " ")


def _sql_rounds(p: str, cfg: QaConfig) -> str:
    cte(f"{p}_f0", "SELECT q_id, question, question AS query FROM q_src", "q_src")
    for r in range(cfg.max_rewrites + 1):
        cte(f"{p}_q{r}", f"SELECT q_id, query AS question FROM {p}_f{r}", f"{p}_f{r}")
        top = sql_topk(f"{p}{r}", f"{p}_q{r}", cfg.top_k, True)
        overlap = sql_overlap("f.question", "c.title || ' ' || c.text")
        cte(f"{p}_g{r}", f"""
SELECT f.q_id, f.question, f.query, {r} AS rewrites, t.id AS top_id, t.score AS top_score,
       coalesce(t.score >= {cfg.relevance_threshold} OR {overlap} >= {cfg.min_keyword_overlap}, FALSE) AS ok,
       (SELECT string_agg(x.id, ',' ORDER BY x.rank) FROM {top} x WHERE x.q_id = f.q_id) AS context_ids
FROM {p}_f{r} f LEFT JOIN {top} t ON t.q_id = f.q_id AND t.rank = 1 LEFT JOIN search_corpus c ON c.id = t.id""",
            f"{p}_f{r}", top, "search_corpus")
        cte(f"{p}_f{r + 1}", f"""
SELECT q_id, question, array_to_string(list_slice(string_split(question, ' '), {4 * (r + 1) + 1}, len(string_split(question, ' '))), ' ') AS query
FROM {p}_g{r} WHERE NOT ok""", f"{p}_g{r}")
    rows = [f"SELECT * FROM {p}_g{r}" + ("" if r == cfg.max_rewrites else " WHERE ok") for r in range(cfg.max_rewrites + 1)]
    return cte(f"{p}_rounds", " UNION ALL ".join(rows), *(f"{p}_g{r}" for r in range(cfg.max_rewrites + 1)))


@query("qa_rounds_by_rule", statement("""
SELECT q_id, query AS final_query, CAST(rewrites AS INTEGER) AS rewrite_count, CAST(rewrites + 1 AS INTEGER) AS n_retrieves, ok AS retrieval_ok,
       top_id, top_score, context_ids FROM qar3_rounds""", _sql_rounds("qar3", ROUNDS)), ops=("K4", "R10"))
def q_qa_rounds_by_rule(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return qa.answer_questions(ctx.questions, ctx.index_reused, ctx.docs_text, ROUNDS, rewriter=later_words).select(
        "q_id", "final_query", "rewrite_count", "n_retrieves", "retrieval_ok", "top_id", "top_score", "context_ids")
