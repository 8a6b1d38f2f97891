"""Question answering as a batch job over a table of questions.

Control flow of the reference (retrieve -> grade -> rewrite -> retrieve ...,
generate -> grade -> generate ...) becomes data flow:

* The rewrite is a deterministic function of the *original* question, so
  every rewrite produces the same query and the same documents. The loop
  therefore has at most two distinct retrievals; we run pass 0 for every
  question and pass 1 only for the questions that need it, then derive
  ``rewrite_count`` arithmetically (0 if pass 0 was good or no budget, 1 if
  pass 1 was good, else the full budget).
* Answers are deterministic too, so regeneration never changes the answer:
  ``regen_count`` is 0 when the answer grades ok, else ``max_regenerations+1``.

Per-question text work (context assembly, sentence scoring, grading) is done
with higher-order array functions inside one row per question: no explode,
no shuffle, all JVM-side. The only shuffles are the retrieval join/top-k and
one ``groupBy(q_id)`` that gathers each question's k documents (k is bounded).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QaConfig
from ..functions.text import grading_terms, keyword_overlap, py_strip, sentences
from ..session import materialize
from .retrieval import TfidfIndex, query_term_rows, texts_of, tfidf_topk

# The reference's offline rewrite rules (keyword -> expansion), in order.
REWRITE_RULES = [
    ("enroll", "open enrollment plan change dates"),
    ("prior auth", "prior authorization MRI requirements"),
    ("specialist", "specialist copay cost sharing"),
    ("copay", "copay deductible cost sharing"),
    ("telehealth", "virtual care visit cost"),
    ("pharmacy", "formulary tier generic copay"),
    ("therapy", "mental health outpatient visits"),
    ("preventive", "preventive care no copay"),
    ("nurse", "nurse advice line phone"),
    ("portal", "member portal registration"),
    ("hmo", "referral primary care specialist"),
    ("emergency", "emergency room copay"),
]
# Suffix when no rule matches, the empty-context answer, and the
# phrase the answer grader treats as a fallback answer.
GENERIC_SUFFIX = " member benefits policy"
FALLBACK_ANSWER = "I'll connect you with member services for a detailed answer."
FALLBACK_PHRASE = "front desk"
MIN_GROUNDED_TERMS = 3


# -- K3 rewrite ---------------------------------------------------------------------

def rewrite(question: Column, rules: list[tuple[str, str]] | None = None,
            generic_suffix: str = GENERIC_SUFFIX) -> Column:
    """Append the expansion of every matching keyword (list order), else a generic suffix."""
    rs = REWRITE_RULES if rules is None else rules
    arr = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(e).alias("ex")) for k, e in rs])
    ql = F.lower(question)
    hints = F.transform(F.filter(arr, lambda r: F.contains(ql, r["kw"])), lambda r: r["ex"])
    suffix = F.when(F.size(hints) > 0, F.concat(F.lit(" "), F.array_join(hints, " "))) \
              .otherwise(F.lit(generic_suffix))
    return py_strip(F.concat(question, suffix))


# -- K2 grade retrieval ----------------------------------------------------------------

def grade_retrieval(top_score: Column, overlap: Column, threshold: Column | float,
                    min_overlap: Column | float) -> Column:
    """ok = top score >= threshold OR overlap >= floor; no documents => not ok."""
    ok = (top_score >= threshold) | (overlap >= min_overlap)
    return F.coalesce(ok, F.lit(False))


# -- K5 / K6 context and extractive answer ---------------------------------------------

def context_of(docs: Column) -> Column:
    """``[title] text`` blocks in rank order, separated by blank lines."""
    return F.array_join(F.transform(docs, lambda d: F.concat(F.lit("["), F.coalesce(d["title"], F.lit("")),
                                                             F.lit("] "), F.coalesce(d["text"], F.lit("")))), "\n\n")


def extractive_answer(question: Column, context: Column) -> Column:
    """Best two sentences by distinct shared words (ties in text order), joined by a space.

    No sentence shares a word => the first sentence; blank context => fixed fallback.
    """
    def best_of(b: Column) -> Column:
        scored = F.transform(b["sents"], lambda s, i: F.struct(
            (-F.size(F.array_intersect(b["q"], grading_terms(s)))).alias("neg_ov"),
            i.alias("idx"), s.alias("s")))
        return F.struct(b["sents"].alias("sents"), F.slice(F.sort_array(
            F.filter(scored, lambda x: x["neg_ov"] < 0)), 1, 2).alias("kept"))

    # one-element arrays bind the question's words, the sentences and the best two once per row
    bound = F.array(F.struct(grading_terms(question).alias("q"), sentences(context).alias("sents")))
    answer = F.element_at(F.transform(F.transform(bound, best_of), lambda b: F.when(
        F.size(b["kept"]) > 0, F.array_join(F.transform(b["kept"], lambda x: py_strip(x["s"])), " ")).otherwise(
        py_strip(F.get(b["sents"], F.lit(0))))), 1)
    return F.when(F.length(py_strip(context)) == 0, F.lit(FALLBACK_ANSWER)).otherwise(answer)


# -- K7 grade answer -------------------------------------------------------------------

def grade_answer(answer: Column, context_texts: Column,
                 fallback_phrase: str = FALLBACK_PHRASE) -> Column:
    """Non-empty, >= 3 distinct words shared with the context *texts*, not a fallback."""
    a = py_strip(F.coalesce(answer, F.lit("")))
    grounded = F.size(F.array_intersect(grading_terms(context_texts), grading_terms(a))) \
        >= MIN_GROUNDED_TERMS
    is_fallback = F.contains(F.lower(a), F.lit(fallback_phrase))
    return (F.length(a) > 0) & grounded & ~is_fallback


def regen_count(answer_ok: Column, max_regenerations: Column | int) -> Column:
    """K8: deterministic answers never change, so either 0 or budget + 1."""
    return F.when(answer_ok, F.lit(0)).otherwise(F.lit(max_regenerations) + 1
                                                 if isinstance(max_regenerations, int)
                                                 else max_regenerations + 1)


def rewrite_count(ok0: Column, ok1: Column, max_rewrites: Column | int) -> Column:
    """K4 unrolled: 0 if pass 0 ok or no budget; 1 if pass 1 ok; else the budget."""
    mr = F.lit(max_rewrites) if isinstance(max_rewrites, int) else max_rewrites
    return (F.when(ok0 | (mr == 0), F.lit(0))
             .when(F.coalesce(ok1, F.lit(False)), F.lit(1))
             .otherwise(mr))


# -- passes -------------------------------------------------------------------------------

def gather_pass(top: DataFrame, docs_text: DataFrame, questions: DataFrame,
                q_col: str = "q_id", question_col: str = "question",
                docs_extra: list[str] | None = None) -> DataFrame:
    """One row per question: its ranked documents (rank <= k) with title/text.

    Columns: q_id, question, docs array<struct<rank,id,score,title,text>>,
    top_score, overlap (original question vs the rank-1 document).
    The document text is joined back *after* top-k, so only k rows per
    question carry text through the shuffle.
    """
    top = materialize(top, "ranked")
    withtext = top.join(texts_of(docs_text.select("id", "title", "text"), top), "id")
    per_q = withtext.groupBy("q_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "id", "score", "title", "text", *(docs_extra or [])))).alias("docs"))
    qs = questions.select(F.col(q_col).alias("q_id"), F.col(question_col).alias("question"))
    j = qs.join(per_q, "q_id", "left")
    first = F.element_at("docs", 1)
    return j.withColumn("top_score", first["score"]).withColumn(
        "overlap", F.when(first.isNull(), F.lit(None).cast("double"))
        .otherwise(keyword_overlap(F.col("question"), F.concat(first["title"], F.lit(" "), first["text"]))))


def answer_docs(docs: Column, question: Column) -> tuple[Column, Column, Column]:
    """(answer, answer_ok, context_ids) for a ranked document array."""
    ctx = context_of(F.coalesce(docs, F.array()))
    answer = extractive_answer(question, ctx)
    texts = F.array_join(F.transform(F.coalesce(docs, F.array()), lambda d: d["text"]), " ")
    ok = grade_answer(answer, texts)
    ids = F.array_join(F.transform(F.coalesce(docs, F.array()), lambda d: d["id"]), ",")
    return answer, ok, ids


def answer_questions(questions: DataFrame, index: TfidfIndex, docs_text: DataFrame,
                     config: QaConfig = QaConfig(), q_col: str = "q_id",
                     question_col: str = "question", retriever=None, rewriter=None, answerer=None) -> DataFrame:
    """End-to-end QA for a whole table of questions under one configuration (K9).

    With a ``retriever``, ``rewriter`` or ``answerer`` (see :mod:`.qa_loop`) the rounds run one after the other;
    with the fixed parts two passes give the same rows.

    Returns one row per question: q_id, question, final_query, rewrite_count,
    n_retrieves, retrieval_ok, top_id, top_score, answer, answer_ok,
    regen_count, n_generations, context_ids.
    """
    if retriever or rewriter or answerer:
        from . import qa_loop
        return qa_loop.answer_rounds(questions, docs_text, retriever or qa_loop.keyword_retriever(index), config,
                                     rewriter or qa_loop.rule_rewriter, answerer, q_col, question_col)
    k = config.top_k
    qs = questions.select(F.col(q_col).alias("q_id"), F.col(question_col).alias("question"))
    p0 = gather_pass(tfidf_topk(qs, index, k, pad=True), docs_text, qs)
    # both passes and the answers read the graded pass: written once (k documents a question), never ranked again
    p0 = materialize(p0.withColumn("ok0", grade_retrieval(F.col("top_score"), F.col("overlap"),
                                                          config.relevance_threshold, config.min_keyword_overlap)), "pass-0")
    if config.max_rewrites > 0:
        need = p0.where(~F.col("ok0")).select("q_id", "question",
                                              rewrite(F.col("question")).alias("query1"))
        # size bound from the rewrites of *all* questions (a question-only job):
        # counting ``need`` itself would run pass 0 an extra time
        bound1 = query_term_rows(qs.select("q_id", rewrite(F.col("question")).alias("question")),
                                 index.stop_words)
        top1 = tfidf_topk(need.select("q_id", F.col("query1").alias("question")), index, k, pad=True,
                          query_terms=bound1)
        p1 = gather_pass(top1, docs_text, need.select("q_id", "question")).join(
            need.select("q_id", "query1"), "q_id")
        p1 = p1.select("q_id", "query1", F.col("docs").alias("docs1"),
                       F.col("top_score").alias("top_score1"),
                       grade_retrieval(F.col("top_score"), F.col("overlap"),
                                       config.relevance_threshold,
                                       config.min_keyword_overlap).alias("ok1"))
        p1 = materialize(p1, "pass-1")
        both = p0.join(p1, "q_id", "left")
    else:
        both = p0.select("*", F.lit(None).cast("string").alias("query1"),
                         F.lit(None).alias("docs1"), F.lit(None).cast("double").alias("top_score1"),
                         F.lit(None).cast("boolean").alias("ok1"))
    rc = rewrite_count(F.col("ok0"), F.col("ok1"), config.max_rewrites)
    out = both.withColumn("rewrite_count", rc)
    rewritten = F.col("rewrite_count") > 0
    out = out.select(
        "q_id", "question",
        F.when(rewritten, F.col("query1")).otherwise(F.col("question")).alias("final_query"),
        "rewrite_count",
        (F.col("rewrite_count") + 1).alias("n_retrieves"),
        F.when(rewritten, F.col("ok1")).otherwise(F.col("ok0")).alias("retrieval_ok"),
        F.when(rewritten, F.col("docs1")).otherwise(F.col("docs")).alias("final_docs"),
    )
    answer, ok, ids = answer_docs(F.col("final_docs"), F.col("question"))
    out = out.select("*", answer.alias("answer")).withColumn(
        "answer_ok", grade_answer(F.col("answer"), F.array_join(
            F.transform(F.coalesce(F.col("final_docs"), F.array()), lambda d: d["text"]), " ")))
    out = out.withColumn("regen_count", regen_count(F.col("answer_ok"), config.max_regenerations))
    return out.select(
        "q_id", "question", "final_query", "rewrite_count", "n_retrieves", "retrieval_ok",
        F.element_at("final_docs", 1)["id"].alias("top_id"),
        F.element_at("final_docs", 1)["score"].alias("top_score"),
        "answer", "answer_ok", "regen_count",
        (F.when(F.col("answer_ok"), F.lit(1)).otherwise(F.lit(config.max_regenerations + 1)))
        .alias("n_generations"),
        F.array_join(F.transform(F.coalesce(F.col("final_docs"), F.array()), lambda d: d["id"]), ",")
        .alias("context_ids"),
        "final_docs",
    )


def qa_trace(answers: DataFrame, config: QaConfig = QaConfig()) -> DataFrame:
    """The step log of each question as an array<struct<step, round, detail>>.

    Mirrors the append reducer: one ``retrieve``/``grade_retrieval`` pair per
    retrieval round, a ``rewrite_query`` between rounds, then one
    ``generate``/``grade_answer`` pair per generation.
    """
    def ev(step: str, rnd: Column, detail: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), rnd.alias("round"), detail.alias("detail"))

    rounds = F.sequence(F.lit(0), F.col("rewrite_count"))
    retrieve = F.flatten(F.transform(rounds, lambda r: F.array(
        ev("retrieve", r, F.when(r == 0, F.col("question")).otherwise(F.col("final_query"))),
        ev("grade_retrieval", r, F.when(r == F.col("rewrite_count"),
                                        F.col("retrieval_ok").cast("string")).otherwise(F.lit("false"))),
        ev("rewrite_query", r, F.col("final_query")))))
    # drop the trailing rewrite after the last retrieval round
    retrieve = F.slice(retrieve, 1, F.size(retrieve) - 1)
    gens = F.sequence(F.lit(1), F.col("n_generations"))
    generate = F.flatten(F.transform(gens, lambda g: F.array(
        ev("generate", g, F.length("answer").cast("string")),
        ev("grade_answer", g, F.col("answer_ok").cast("string")))))
    return answers.select("q_id", F.concat(retrieve, generate).alias("trace"))
