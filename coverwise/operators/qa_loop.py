"""The question loop with parts of the caller's choice.

``answer_rounds`` runs retrieve -> grade -> rewrite -> retrieve as rounds over the questions still open. Every
round is one retrieval for all of them; the frontier (open questions with their next query) is a written
table, so a round reads no earlier round's plan, and the loop ends when it is empty or the budget is spent.
The parts are plain callables:

* ``retriever(questions, k)`` takes (q_id, question) and returns (q_id, rank, id, score), k rows a question at
  most. ``keyword_retriever`` wraps the TF-IDF ranking, ``blockmax_retriever`` the pruned one;
* ``rewriter(question, query, round)`` takes Columns and returns the next query as a Column (built-in functions, or
  a pandas UDF applied to them). ``round`` counts rewrites from 1;
* ``answerer(question, docs, attempt)`` takes Columns and returns the answer as a Column; ``docs`` is
  array<struct<rank, id, score, title, text>>, ``attempt`` counts from 0. A later attempt is made
  where the one before was graded not ok.

Counts are those of the rounds and attempts that ran. A question without documents is never ok; a null query
retrieves what the retriever returns for null.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QaConfig
from ..session import materialize
from . import qa
from . import retrieval as rt

Retriever = Callable[[DataFrame, int], DataFrame]
Rewriter = Callable[[Column, Column, Column], Column]
Answerer = Callable[[Column, Column, int], Column]


def keyword_retriever(index: rt.TfidfIndex) -> Retriever:
    return lambda questions, k: rt.tfidf_topk(questions, index, k)


def blockmax_retriever(blocks) -> Retriever:
    from .blockmax import blockmax_topk
    return lambda questions, k: blockmax_topk(questions, blocks, k)


def rule_rewriter(question: Column, query: Column, round_no: Column) -> Column:
    """The fixed rules: the expansion of the question, the same in every round."""
    return qa.rewrite(question)


def extractive_answerer(question: Column, docs: Column, attempt: int) -> Column:
    return qa.extractive_answer(question, qa.context_of(F.coalesce(docs, F.array())))


def retrieval_rounds(questions: DataFrame, docs_text: DataFrame, config: QaConfig, retriever: Retriever,
                     rewriter: Rewriter = rule_rewriter) -> DataFrame:
    """One row per question as it left the loop: (q_id, question, query, rewrites, docs, top_score, ok)."""
    frontier = questions.select("q_id", "question", F.col("question").alias("query"))
    closed = []
    for done in range(config.max_rewrites + 1):
        # written first: the join with the texts sees how few rows these are and leaves the texts where they lie
        top = materialize(retriever(frontier.select("q_id", F.col("query").alias("question")), config.top_k), f"top-{done}")
        graded = qa.gather_pass(top, docs_text, frontier.select("q_id", "question")).join(frontier.select("q_id", "query"), "q_id")
        graded = materialize(graded.select(
            "q_id", "question", "query", F.lit(done).alias("rewrites"), "docs", "top_score",
            qa.grade_retrieval(F.col("top_score"), F.col("overlap"), config.relevance_threshold, config.min_keyword_overlap).alias("ok")), f"round-{done}")
        last = done == config.max_rewrites
        closed.append(graded if last else graded.where("ok"))
        if not last:
            frontier = materialize(graded.where("not ok").select(
                "q_id", "question", rewriter(F.col("question"), F.col("query"), F.lit(done + 1)).alias("query")), f"frontier-{done + 1}")
            if frontier.isEmpty():
                break
    return reduce(DataFrame.unionByName, closed)


def answer_rounds(questions: DataFrame, docs_text: DataFrame, retriever: Retriever, config: QaConfig = QaConfig(),
                  rewriter: Rewriter = rule_rewriter, answerer: Answerer | None = None,
                  q_col: str = "q_id", question_col: str = "question") -> DataFrame:
    """The columns of ``qa.answer_questions`` from a loop over rounds. Without an ``answerer`` the extractive one
    answers; it never changes its answer, so its attempts are counted without being repeated."""
    qs = questions.select(F.col(q_col).alias("q_id"), F.col(question_col).alias("question"))
    found = retrieval_rounds(qs, docs_text, config, retriever, rewriter)
    texts = F.array_join(F.transform(F.coalesce(F.col("docs"), F.array()), lambda d: d["text"]), " ")
    attempts = config.max_regenerations + 1 if answerer else 1
    out = found.withColumn("answer", (answerer or extractive_answerer)(F.col("question"), F.col("docs"), 0)) \
        .withColumn("answer_ok", qa.grade_answer(F.col("answer"), texts)).withColumn("n_generations", F.lit(1))
    for attempt in range(1, attempts):  # a fixed small number of column expressions, no jobs
        again = out.withColumn("_next", F.when(~F.col("answer_ok"), answerer(F.col("question"), F.col("docs"), attempt)))
        out = again.withColumn("answer", F.when(F.col("answer_ok"), F.col("answer")).otherwise(F.col("_next"))) \
            .withColumn("n_generations", F.when(F.col("answer_ok"), F.col("n_generations")).otherwise(F.lit(attempt + 1))) \
            .withColumn("answer_ok", F.col("answer_ok") | qa.grade_answer(F.col("answer"), texts)).drop("_next")
    n = F.col("n_generations") if answerer else F.when(F.col("answer_ok"), F.lit(1)).otherwise(F.lit(config.max_regenerations + 1))
    first = F.element_at("docs", 1)
    return out.select(
        "q_id", "question", F.col("query").alias("final_query"), F.col("rewrites").alias("rewrite_count"), (F.col("rewrites") + 1).alias("n_retrieves"),
        F.col("ok").alias("retrieval_ok"), first["id"].alias("top_id"), F.col("top_score"), "answer", "answer_ok",
        F.when(F.col("answer_ok"), n - 1).otherwise(F.lit(config.max_regenerations + 1)).alias("regen_count"), n.alias("n_generations"),
        F.array_join(F.transform(F.coalesce(F.col("docs"), F.array()), lambda d: d["id"]), ",").alias("context_ids"), F.col("docs").alias("final_docs"))
