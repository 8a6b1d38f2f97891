"""Retrieval queries (R1-R8, W2, W3, J1) over the active gold corpus."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import effective_stop_words, retrieval_tokens, with_bigrams
from ..operators import blockmax, vector_cells
from ..operators import retrieval as rt
from ..session import materialize
from ..sources import adapters as ad
from ..sources import tables
from .catalog import query
from .medallion_q import corpus
from .sqlkit import cte, statement

TOP_K = 3
HYBRID_DEPTH = 10
HYBRID_K = 5
VECTOR_K = 5

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in effective_stop_words()) + "]"
_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def sql_terms(expr: str) -> str:
    """DuckDB: unigrams + bigrams of the stop-filtered retrieval tokens of ``expr``."""
    toks = (f"list_filter(regexp_extract_all(lower({expr}), '{_TOKEN_RE}'), "
            f"lambda x: NOT list_contains({_STOP_SQL}, x))")
    return toks


cte("q_src", "SELECT item_id AS q_id, text AS question FROM benchmark")
cte("doc_toks", f"""
SELECT id, pos, {sql_terms("title || '. ' || text")} AS toks FROM search_corpus""", "search_corpus")
cte("doc_tf", """
SELECT id, pos, term, count(*) AS tf
FROM (SELECT id, pos, unnest(toks || list_transform(range(1, len(toks)),
             lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM doc_toks)
GROUP BY id, pos, term""", "doc_toks")
cte("n_docs", "SELECT CAST(count(*) AS DOUBLE) AS n FROM search_corpus", "search_corpus")
cte("vocab", """
SELECT term, count(*) AS df, ln((1 + any_value(n)) / (count(*) + 1)) + 1 AS idf
FROM doc_tf, n_docs GROUP BY term""", "doc_tf", "n_docs")
cte("postings", """
SELECT id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
FROM (SELECT d.id, d.pos, d.term, (ln(d.tf) + 1) * v.idf AS w FROM doc_tf d JOIN vocab v USING (term))""",
    "doc_tf", "vocab")
cte("norms", """
SELECT d.pos, sqrt(sum(((ln(d.tf) + 1) * v.idf) * ((ln(d.tf) + 1) * v.idf))) AS norm
FROM doc_tf d JOIN vocab v USING (term) GROUP BY d.pos""", "doc_tf", "vocab")


def sql_topk(prefix: str, questions_cte: str, k: int, pad: bool,
             corpus_cte: str = "search_corpus", tf_cte: str = "doc_tf",
             vocab_cte: str = "vocab", norms_cte: str = "norms") -> str:
    """Register CTEs ``{prefix}_qvec`` / ``{prefix}_topk`` and return the top-k CTE name.

    ``questions_cte`` must expose (q_id, question).
    """
    cte(f"{prefix}_qtf", f"""
SELECT q_id, term, count(*) AS tf
FROM (SELECT q_id, unnest(toks || list_transform(range(1, len(toks)),
             lambda i: toks[i] || ' ' || toks[i + 1])) AS term
      FROM (SELECT q_id, {sql_terms("question")} AS toks FROM {questions_cte}))
GROUP BY q_id, term""", questions_cte)
    cte(f"{prefix}_qvec", f"""
SELECT q_id, term, idf, w / sqrt(sum(w * w) OVER (PARTITION BY q_id)) AS weight
FROM (SELECT q.q_id, q.term, v.idf, (ln(q.tf) + 1) * v.idf AS w FROM {prefix}_qtf q JOIN {vocab_cte} v USING (term))""",
        f"{prefix}_qtf", vocab_cte)
    pad_sql = (f"""
      UNION ALL
      SELECT q.q_id, p.pos, 0.0 AS c
      FROM {questions_cte} q, (SELECT pos FROM {corpus_cte} ORDER BY pos LIMIT {k}) p"""
               if pad else "")
    cte(f"{prefix}_scores", f"""
SELECT s.q_id, c.id, s.pos, coalesce(s.dot / n.norm, 0.0) AS score_raw
FROM (SELECT q_id, pos, sum(c) AS dot
      FROM (SELECT q.q_id, d.pos, q.weight * ((ln(d.tf) + 1) * q.idf) AS c
            FROM {prefix}_qvec q JOIN {tf_cte} d USING (term){pad_sql})
      GROUP BY q_id, pos) s
JOIN {corpus_cte} c ON c.pos = s.pos
LEFT JOIN {norms_cte} n ON n.pos = s.pos""", f"{prefix}_qvec", tf_cte, corpus_cte, questions_cte, norms_cte)
    cte(f"{prefix}_topk", f"""
SELECT q_id, rank, id, pos, round(score_raw, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score_raw, 9) DESC, pos) AS rank
      FROM {prefix}_scores)
WHERE rank <= {k}""", f"{prefix}_scores")
    return f"{prefix}_topk"


# -- Spark side helpers --------------------------------------------------------------------

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # per-question text work (answers, grading) is CPU-bound: a question table
    # read as a single split is spread over the cores (no-op when it is not)
    return ad.spread(ad.questions(tables.benchmark(spark, sf_dir)))


class Ctx:
    """Per-query inputs, each built once: the active corpus (written once to the
    checkpoint folder, since ranking, padding, N and answer text all read it),
    the TF-IDF index over it, and the questions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def corpus(self) -> DataFrame:
        # written once, as it leaves the dedupe shuffle (already spread over
        # the cores); a parquet table keeps no partitioning, so a repartition
        # by position first would only add a second shuffle of all the text
        return materialize(corpus(self.spark, self.sf_dir), "corpus")

    @cached_property
    def index(self) -> rt.TfidfIndex:
        return rt.build_tfidf_index(self.corpus)

    @cached_property
    def index_reused(self) -> rt.TfidfIndex:
        """The index with terms as 64-bit codes, for jobs that read no term."""
        return rt.build_tfidf_index(self.corpus, coded=True)

    @cached_property
    def questions(self) -> DataFrame:
        return questions(self.spark, self.sf_dir)

    @cached_property
    def docs_text(self) -> DataFrame:
        return self.corpus.select("id", "title", "text")

    @cached_property
    def page_corpus(self) -> DataFrame:
        # pages are read without a shuffle: spread only when under-parallelised
        pages = ad.page_corpus(ad.spread(tables.pages(self.spark, self.sf_dir)))
        return materialize(pages, "page_corpus")

    @cached_property
    def page_index(self) -> rt.TfidfIndex:
        return rt.build_tfidf_index(self.page_corpus, coded=True)


# -- queries ---------------------------------------------------------------------------------

@query("token_stats", statement(f"""
SELECT id, len(toks) AS n_tokens,
       len(list_distinct(toks || list_transform(range(1, len(toks)),
           lambda i: toks[i] || ' ' || toks[i + 1]))) AS n_distinct_terms
FROM doc_toks""", "doc_toks"), ops=("R1", "R2"))
def q_token_stats(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    c = ctx.corpus
    toks = retrieval_tokens(rt.doc_text(F.col("title"), F.col("text")))
    return c.select("id", toks.alias("toks")).select(
        "id", F.size("toks").alias("n_tokens"),
        F.size(F.array_distinct(with_bigrams(F.col("toks")))).alias("n_distinct_terms"))


@query("tfidf_vocab", statement("SELECT term, df, round(idf, 6) AS idf FROM vocab", "vocab"),
       ops=("R3",))
def q_tfidf_vocab(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    v = ctx.index.vocab
    return v.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_doc_norms", statement("""
SELECT id, count(*) AS n_terms, round(max(weight), 6) AS max_weight,
       round(sum(weight * weight), 6) AS sum_sq
FROM postings GROUP BY id""", "postings"), ops=("R3",))
def q_tfidf_doc_norms(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    p = ctx.index_reused.postings
    per_doc = p.groupBy("pos").agg(F.count(F.lit(1)).alias("n_terms"),
                                   F.round(F.max("weight"), 6).alias("max_weight"),
                                   F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("sum_sq"))
    return per_doc.join(ctx.index_reused.docs.select("pos", "id"), "pos").drop("pos")


@query("tfidf_topk", statement(
    f"SELECT q_id, rank, id, score FROM {sql_topk('kw', 'q_src', TOP_K, False)}",
    "kw_topk"), ops=("R4", "R5", "J1", "W2"))
def q_tfidf_topk(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    top = rt.tfidf_topk(ctx.questions, ctx.index, TOP_K, pad=False)
    return top.select("q_id", "rank", "id", "score")


@query("tfidf_topk_padded", statement(
    f"SELECT q_id, rank, id, score FROM {sql_topk('kwp', 'q_src', TOP_K, True)}",
    "kwp_topk"), ops=("R5", "R6"))
def q_tfidf_topk_padded(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    top = rt.tfidf_topk(ctx.questions, ctx.index, TOP_K, pad=True)
    return top.select("q_id", "rank", "id", "score")


@query("tfidf_topk_blockmax", statement("SELECT q_id, rank, id, score FROM kwp_topk", "kwp_topk"), ops=("R5", "W2"))
def q_tfidf_topk_blockmax(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return blockmax.blockmax_topk(ctx.questions, blockmax.build_blocks(ctx.index_reused), TOP_K).select("q_id", "rank", "id", "score")


@query("rank_derived_score", statement("""
SELECT q_id, rank, id,
       round((greatest(count(*) OVER (PARTITION BY q_id), 1) - (rank - 1))
             / greatest(count(*) OVER (PARTITION BY q_id), 1), 6) AS rank_score
FROM kwp_topk""", "kwp_topk"), ops=("W3",))
def q_rank_derived(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    top = rt.tfidf_topk(ctx.questions, ctx.index_reused, TOP_K, pad=True)
    return rt.rank_derived_score(top).select("q_id", "rank", "id", "rank_score")


cte("corpus_en", "SELECT * FROM search_corpus WHERE category = 'en'", "search_corpus")
cte("doc_tf_en", "SELECT d.* FROM doc_tf d SEMI JOIN corpus_en c ON d.pos = c.pos",
    "doc_tf", "corpus_en")


@query("filtered_topk", statement(
    f"SELECT q_id, rank, id, score FROM "
    f"{sql_topk('kwf', 'q_src', TOP_K, True, 'corpus_en', 'doc_tf_en')}", "kwf_topk"),
    ops=("R8",))
def q_filtered_topk(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    idx = ctx.index
    allowed = idx.docs.where(F.col("category") == "en")
    top = rt.tfidf_topk(ctx.questions, idx, TOP_K, pad=True, allowed_docs=allowed)
    return top.select("q_id", "rank", "id", "score")


# -- vectors and hybrid --------------------------------------------------------------------

cte("q_vecs", """
SELECT b.item_id AS q_id, CAST(e.embedding AS DOUBLE[]) AS vec
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""")
cte("doc_vecs", """
SELECT e.vec_id AS id, e.vec_id AS pos, CAST(e.embedding AS DOUBLE[]) AS vec
FROM embeddings e SEMI JOIN search_corpus c ON c.pos = e.vec_id""", "search_corpus")


def sql_vector_topk(name: str, k: int) -> str:
    cte(name, f"""
SELECT q_id, rank, id, pos, round(s, 6) AS score
FROM (SELECT q.q_id, d.id, d.pos, list_cosine_similarity(q.vec, d.vec) AS s,
             row_number() OVER (PARTITION BY q.q_id
                                ORDER BY round(list_cosine_similarity(q.vec, d.vec), 9) DESC, d.pos) AS rank
      FROM q_vecs q, doc_vecs d)
WHERE rank <= {k}""", "q_vecs", "doc_vecs")
    return name


def _vectors(spark, sf_dir, active_corpus: DataFrame):
    emb = tables.embeddings(spark, sf_dir)
    bench = tables.benchmark(spark, sf_dir)
    qv = bench.join(emb, emb["vec_id"] == bench["item_id"]).select(
        F.col("item_id").alias("q_id"), F.col("embedding").alias("vec"))
    active = active_corpus.select("pos")
    dv = emb.join(active, emb["vec_id"] == active["pos"], "left_semi").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return qv, dv


@query("vector_topk", statement(
    f"SELECT q_id, rank, id, score FROM {sql_vector_topk('vec_topk', VECTOR_K)}", "vec_topk"),
    ops=("R7",))
def q_vector_topk(spark, sf_dir):
    qv, dv = _vectors(spark, sf_dir, corpus(spark, sf_dir))
    return rt.vector_topk(qv, dv, VECTOR_K).select("q_id", "rank", "id", "score")


def _embedding_queries(spark, sf_dir):
    """Every twentieth embedding as a query against all embeddings."""
    rows = tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    return rows.where("id % 20 = 0").select(F.col("id").alias("q_id"), "vec"), rows


cte("emb_topk", f"""
SELECT q_id, rank, id, round(s, 6) AS score
FROM (SELECT q.vec_id AS q_id, d.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) DESC, d.vec_id) AS rank
      FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)
WHERE rank <= {VECTOR_K}""")


@query("vector_cells_exact", statement("SELECT * FROM emb_topk", "emb_topk"), ops=("R7",))
def q_vector_cells_exact(spark, sf_dir):
    asked, rows = _embedding_queries(spark, sf_dir)
    return vector_cells.cells_topk(asked, vector_cells.build_cells(rows), VECTOR_K, exact=True).select("q_id", "rank", "id", "score")


@query("vector_cells_recall", statement(f"""
SELECT count(DISTINCT q_id) AS n_queries, count(*) AS wanted, TRUE AS recall_ok, CAST(0 AS BIGINT) AS other_scores FROM emb_topk""", "emb_topk"), ops=("R7",))
def q_vector_cells_recall(spark, sf_dir):
    asked, rows = _embedding_queries(spark, sf_dir)
    cells = vector_cells.build_cells(rows)
    exact = materialize(vector_cells.cells_topk(asked, cells, VECTOR_K, exact=True), "exact")
    found = materialize(vector_cells.cells_topk(asked, cells, VECTOR_K), "found")
    wrong = found.select("q_id", "id", "score").join(exact.select("q_id", "id", F.col("score").alias("want")), ["q_id", "id"]).where("score <> want")
    return vector_cells.recall(found, exact).select("n_queries", "wanted", (F.col("recall") >= 0.9).alias("recall_ok"),
                                                    wrong.agg(F.count("*")).scalar().alias("other_scores"))


@query("hybrid_topk", statement(f"""
SELECT q_id, rank, 'doc-' || CAST(pos AS VARCHAR) AS id, fused,
       round((greatest(count(*) OVER (PARTITION BY q_id), 1) - (rank - 1))
             / greatest(count(*) OVER (PARTITION BY q_id), 1), 6) AS score
FROM (SELECT q_id, pos, round(f, 6) AS fused,
             row_number() OVER (PARTITION BY q_id ORDER BY round(f, 9) DESC, pos) AS rank
      FROM (SELECT q_id, pos, sum(1.0 / (60 + rank)) AS f
            FROM (SELECT q_id, pos, rank FROM {sql_topk('kwh', 'q_src', HYBRID_DEPTH, False)}
                  UNION ALL
                  SELECT q_id, pos, rank FROM {sql_vector_topk('vec_h', HYBRID_DEPTH)})
            GROUP BY q_id, pos))
WHERE rank <= {HYBRID_K}""", "kwh_topk", "vec_h"), ops=("R7", "R10"))
def q_hybrid_topk(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    qs = ctx.questions
    kw = rt.tfidf_topk(qs, ctx.index_reused, HYBRID_DEPTH, pad=False)
    qv, dv = _vectors(spark, sf_dir, ctx.corpus)
    vec = rt.vector_topk(qv, dv, HYBRID_DEPTH)
    fused = rt.reciprocal_rank_fusion([kw, vec], HYBRID_K)
    scored = rt.rank_derived_score(fused).withColumnRenamed("rank_score", "score")
    return scored.select("q_id", "rank", F.concat(F.lit("doc-"), F.col("pos").cast("string")).alias("id"),
                         "fused", "score")


# -- two corpora searched and merged (C6) ------------------------------------------------------

FED_DEPTH = 10
FED_K = 5

cte("page_corpus", f"""
SELECT 'page-' || CAST(page_id AS VARCHAR) AS id, CAST(page_id AS BIGINT) AS pos,
       regexp_extract(html, '{ad.PAGE_TITLE}', 1) AS title, 'web' AS category,
       regexp_replace(regexp_replace(html, '{ad.SCRIPT_STYLE}', ' ', 'g'), '{ad.MARKUP_TAG}', ' ', 'g')
         AS text
FROM pages""")
cte("page_toks", f"""
SELECT id, pos, {sql_terms("title || '. ' || text")} AS toks FROM page_corpus""", "page_corpus")
cte("page_tf", """
SELECT id, pos, term, count(*) AS tf
FROM (SELECT id, pos, unnest(toks || list_transform(range(1, len(toks)),
             lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM page_toks)
GROUP BY id, pos, term""", "page_toks")
cte("page_vocab", """
SELECT term, count(*) AS df,
       ln((1 + (SELECT CAST(count(*) AS DOUBLE) FROM page_corpus)) / (count(*) + 1)) + 1 AS idf
FROM page_tf GROUP BY term""", "page_tf", "page_corpus")
cte("page_norms", """
SELECT d.pos, sqrt(sum(((ln(d.tf) + 1) * v.idf) * ((ln(d.tf) + 1) * v.idf))) AS norm
FROM page_tf d JOIN page_vocab v USING (term) GROUP BY d.pos""", "page_tf", "page_vocab")


@query("federated_topk", statement(f"""
SELECT q_id, rank, corpus, id, fused
FROM (SELECT q_id, corpus, id, round(f, 6) AS fused,
             row_number() OVER (PARTITION BY q_id ORDER BY round(f, 9) DESC, corpus_no, pos) AS rank
      FROM (SELECT q_id, corpus, id, min(corpus_no) AS corpus_no, min(pos) AS pos,
                   sum(1.0 / (60 + rank)) AS f
            FROM (SELECT q_id, 'kb' AS corpus, 0 AS corpus_no, id, pos, rank
                  FROM {sql_topk('kfa', 'q_src', FED_DEPTH, True)}
                  UNION ALL
                  SELECT q_id, 'web' AS corpus, 1 AS corpus_no, id, pos, rank
                  FROM {sql_topk('kfb', 'q_src', FED_DEPTH, True, 'page_corpus', 'page_tf',
                                 'page_vocab', 'page_norms')})
            GROUP BY q_id, corpus, id))
WHERE rank <= {FED_K}""", "kfa_topk", "kfb_topk"), ops=("C6", "R5", "R6"))
def q_federated_topk(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    qs = ctx.questions
    kb = rt.tfidf_topk(qs, ctx.index_reused, FED_DEPTH, pad=True)
    web = rt.tfidf_topk(qs, ctx.page_index, FED_DEPTH, pad=True)
    return rt.federated_topk([("kb", kb), ("web", web)], FED_K)
