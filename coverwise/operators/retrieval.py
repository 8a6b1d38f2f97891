"""Retrieval as distributed joins: TF-IDF postings, cosine top-k, vectors, fusion.

Data model
----------
The reference's in-memory sparse matrix becomes a long **postings** table
``(id, pos, term, weight)``: one row per distinct term of a document, with
sublinear tf (1 + ln tf), smoothed idf (ln((1+N)/(1+df)) + 1) and an L2 norm
per document. ``pos`` is the corpus position used to break score ties.

Plan shape (``tfidf_topk``)
---------------------------
questions -> terms -> (q, term, weight) ⋈ tf on ``term`` -> ``sum`` per
(q, doc) inside the buckets of ``pos`` -> top-k per question with ``row_number() <= k``, which
Catalyst compiles into a partial ``WindowGroupLimit`` before the shuffle: each
map task forwards at most k rows per question. Questions are never crossed
with documents; only documents sharing a term are touched. A hot term (one in
most documents) is a skewed join key: AQE's skew-join splits that partition
(the postings side) and replicates the matching query rows.

Zero-score padding (the reference always returns min(k, N) documents): the
first k corpus documents by position are fetched once as a scalar subquery and
ranked at score 0 with each question's winners, at most 2k rows a question.

A ``coded`` index names its terms by 64-bit codes (xxhash64; a bigram's code is that of its tokens' codes) in the
column ``term`` of tf and vocabulary. Most postings are bigrams of one or two documents, so their texts are most
of what a string index writes, shuffles, sorts and scans. Two terms of one code count as one term: among n
distinct terms n * n / 2 ** 65 such pairs are expected (0.01 for 700 million). Readers of the
terms themselves (vocabulary, postings, synonyms) use the string index.

Scores are summed in different orders by different engines; ranking uses the
score rounded to 9 places, output is rounded to 6.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import code_bigrams, retrieval_tokens, term_codes, with_bigrams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package on their path

RANK_DIGITS = 9
OUT_DIGITS = 6


@dataclass
class TfidfIndex:
    """A fitted TF-IDF index.

    ``tf`` (pos, term, tf) holds the raw counts, ``vocab`` (term, df, idf) the
    document frequencies and ``norms`` (pos, norm) each document's L2 norm of
    (1 + ln tf) * idf. Scores are computed as sum(q_weight * (1 + ln tf) * idf)
    over the matching terms, divided by the document norm *after* the per
    (question, document) sum, so ranking never rewrites all postings.
    """
    docs: DataFrame        # (id, pos, title, category) — the indexed corpus
    tf: DataFrame          # (pos, term, tf)
    vocab: DataFrame       # (term, df, idf)
    norms: DataFrame       # (pos, norm)
    stop_words: list[str] | None = None
    fitted: bool = False   # the tables are written (lineage cut), not plans
    coded: bool = False    # ``term`` is a 64-bit code

    @property
    def postings(self) -> DataFrame:
        """Normalised postings (pos, term, weight) — for export and inspection."""
        w = self.tf.join(self.norms, "pos").join(self.vocab.select("term", "idf"), "term")  # norms inside the buckets
        return w.select("pos", "term", (_w_raw(F.col("tf"), F.col("idf")) / F.col("norm")).alias("weight"))

    def vocab_of(self, terms: DataFrame) -> DataFrame:
        """The vocabulary, of the given terms at least."""
        return self.vocab

    def checkpoint(self) -> "TfidfIndex":
        """Materialise vocabulary and norms once in the shared checkpoint folder.

        Use when one job ranks several question sets (e.g. both QA passes).
        A fitted index (the default build) is returned as is.
        """
        if self.fitted:
            return self
        from ..session import materialize
        return TfidfIndex(self.docs, self.tf, materialize(self.vocab, "vocab"), materialize(self.norms, "norms"),
                          self.stop_words, fitted=True, coded=self.coded)

    def persist(self, path: str) -> "TfidfIndex":
        """Write the index once and read it back (lineage cut at the written tables)."""
        spark = self.tf.sparkSession
        for name in ("docs", "tf", "vocab", "norms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        r = {n: spark.read.parquet(f"{path}/{n}") for n in ("docs", "tf", "vocab", "norms")}
        return TfidfIndex(r["docs"], r["tf"], r["vocab"], r["norms"], self.stop_words, fitted=True, coded=self.coded)


def _w_raw(tf: Column, idf: Column) -> Column:
    return (F.log(tf.cast("double")) + 1) * idf


def doc_text(title: Column, text: Column) -> Column:
    """Indexed text of a document: title, ". ", body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))


def gathered_terms(df: DataFrame, key_cols: list[str], text: Column, stop_words: list[str] | None = None,
                   coded: bool = False) -> DataFrame:
    """(keys..., _s): all terms of a key's rows (or their codes) as one sorted array."""
    # tokens and sorted terms are projected once and referenced by column: a nested
    # expression would be computed again wherever it is named
    toks = df.select(*key_cols, retrieval_tokens(text, stop_words).alias("_toks"))
    if coded:
        toks = toks.select(*key_cols, term_codes(F.col("_toks")).alias("_toks"))
    terms = toks.select(*key_cols, (code_bigrams if coded else with_bigrams)(F.col("_toks")).alias("_terms"))
    per_key = terms.groupBy(*key_cols).agg(F.sort_array(F.flatten(F.collect_list("_terms"))).alias("_s"))
    return per_key.where(F.size("_s") > 0)


def term_frequencies(df: DataFrame, key_cols: list[str], text: Column,
                     stop_words: list[str] | None = None, coded: bool = False) -> DataFrame:
    """(keys..., term, tf): the terms of a key's rows are gathered, sorted and counted as one array,
    so what is grouped is texts, not terms. A key's rows are one document (repeated keys add up)."""
    per_key = gathered_terms(df, key_cols, text, stop_words, coded)
    # last place (from 1) of each run of equal terms
    ends = F.filter(F.sequence(F.lit(1), F.size("_s")),
                    lambda i: (i == F.size("_s")) | (F.get(F.col("_s"), i - 1) != F.get(F.col("_s"), i)))
    runs = per_key.select(*key_cols, "_s", ends.alias("_e"))
    counted = F.transform("_e", lambda e, j: F.struct(
        F.get(F.col("_s"), e - 1).alias("term"),
        (e - F.coalesce(F.get(F.col("_e"), j - 1), F.lit(0))).cast("long").alias("tf")))
    return runs.select(*key_cols, F.explode(counted).alias("_t")).select(*key_cols, "_t.term", "_t.tf")


#: Codes counted at a time by a task.
COUNT_CODES = 1 << 20


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(a, b)`` of 64-bit integers."""
    def rotl(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    h = np.full(len(a), 42, np.uint64)
    for x in (a, b):
        h = h + _P5 + np.uint64(8)
        h ^= rotl(x.view(np.uint64) * _P2, 31) * _P1
        h = rotl(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _code_counter(limit: int = COUNT_CODES):
    return _term_counter(limit)


def _term_counter(limit: int = COUNT_CODES, keys: int = 1, coded: bool = True):
    """Counts the terms of rows (keys..., tokens or their codes); the rows of a document, those of equal keys, follow each other."""
    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """Whether a row is the first of its document."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for col in batch.columns[:keys]:
            empty, key = col.is_null().to_numpy(zero_copy_only=False), col.fill_null(0).to_numpy()
            new[1:] |= (key[1:] != key[:-1]) | (empty[1:] != empty[:-1])
        return new

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # about ``limit`` tokens at a time
            ends = np.asarray(batch.column(keys).value_lengths()).cumsum()
            lo = 0
            while lo < len(ends):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def counted(first: np.ndarray, n: np.ndarray, codes: np.ndarray, pair) -> tuple[np.ndarray, np.ndarray]:
        """(end of each document's terms, all terms, sorted by document)"""
        # a row's terms: its tokens, then its bigrams
        ends, pairs = n.cumsum(), np.maximum(n - 1, 0)
        inside = np.ones(len(codes), bool)
        inside[(ends - 1)[n > 0]] = False
        left = np.flatnonzero(inside)
        start = np.concatenate([[0], (n + pairs).cumsum()])[:-1]
        both = np.empty(len(codes) + len(left), np.int64)
        both[np.repeat(start - (ends - n), n) + np.arange(len(codes))] = codes
        both[np.repeat(start + n - (pairs.cumsum() - pairs), pairs) + np.arange(len(left))] = pair(codes[left], codes[left + 1])
        stops = np.append(start, len(both))[np.append(first[1:], len(n))]
        lo = 0
        for hi in stops.tolist():
            both[lo:hi].sort()
            lo = hi
        return stops, both

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last document's rows wait for what follows
        for batch in rows(batches):
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(starts(batch))[-1])
            rest = batch.slice(cut)
            if cut:
                yield from runs(batch.slice(0, cut))
        if rest is not None:
            yield from runs(rest)

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(starts(batch))
        n = np.asarray(batch.column(keys).value_lengths())
        toks = batch.column(keys).flatten()
        if coded:
            ends, terms = counted(first, n, toks.to_numpy(), _xxhash64)
        else:
            # numbers of this batch's tokens, and behind them those of their pairs
            texts = toks.dictionary_encode()
            size = len(texts.dictionary)
            ends, terms = counted(first, n, texts.indices.to_numpy().astype(np.int64), lambda a, b: size + a * size + b)
        new = np.ones(len(terms), bool)  # the first of a run of equal terms
        new[1:] = terms[1:] != terms[:-1]
        new[ends[:-1]] = True
        at = np.flatnonzero(new)
        doc, tf, terms = first[np.searchsorted(ends, at, "right")], np.diff(at, append=len(terms)), terms[at]
        # terms of many tokens are written as text some at a time
        for lo in range(0, len(at), limit):
            term = pa.array(terms[lo:lo + limit])
            if not coded:
                one, two = np.divmod(terms[lo:lo + limit] - size, size)
                single = pa.array(one < 0)
                left = texts.dictionary.take(pa.array(np.where(one < 0, two, one)))
                term = pc.if_else(single, left, pc.binary_join_element_wise(left, texts.dictionary.take(pa.array(two)), " "))
            who = pa.array(doc[lo:lo + limit])
            yield pa.RecordBatch.from_arrays([c.take(who) for c in batch.columns[:keys]] + [term, pa.array(tf[lo:lo + limit])],
                                             names=[*batch.schema.names[:keys], "term", "tf"])
    return count


def code_frequencies(df: DataFrame, key: str, text: Column, stop_words: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """``term_frequencies`` of coded terms for many texts: what is sorted by key is codes of tokens; bigrams are coded and the
    runs of a task's arrays counted together. ``dealt``: the rows of a key are in one partition already."""
    toks = (df if dealt else df.repartition(key)).select(key, retrieval_tokens(text, stop_words).alias("_toks"))
    codes = toks.select(key, term_codes(F.col("_toks")).alias("_toks")).where(F.size("_toks") > 0).sortWithinPartitions(key)
    schema = T.StructType([codes.schema[key], T.StructField("term", T.LongType()), T.StructField("tf", T.LongType())])
    return codes.mapInArrow(_code_counter(), schema)


def dealt_frequencies(df: DataFrame, key_cols: list[str], text: Column, stop_words: list[str] | None = None) -> DataFrame:
    """``term_frequencies`` by numeric keys whose rows are in one partition already: tokens are numbered, counted and
    paired as numbers, and become text again as distinct terms of a document."""
    toks = df.select(*key_cols, retrieval_tokens(text, stop_words).alias("_toks")).where(F.size("_toks") > 0).sortWithinPartitions(*key_cols)
    schema = T.StructType([*(toks.schema[k] for k in key_cols), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return toks.mapInArrow(_term_counter(keys=len(key_cols), coded=False), schema)


def _l2_normalised(df: DataFrame, key: str, raw: str = "w_raw") -> DataFrame:
    # window on the document/question key: rows per key are bounded by its distinct terms
    norm = F.sqrt(F.sum(F.col(raw) * F.col(raw)).over(Window.partitionBy(key)))
    return df.withColumn("weight", F.col(raw) / norm).drop(raw)


def document_norms(tf: DataFrame, vocab: DataFrame, n_docs: Column) -> DataFrame:
    """(pos, norm): L2 norm of (1 + ln tf) * idf per document. Most terms lie in one document and share one
    idf, so only the terms of several documents are joined; as codes they are hashed where they meet their postings,
    which are then not sorted."""
    shared = vocab.where("df > 1").select("term", "idf")
    if vocab.schema["term"].dataType == T.LongType():
        shared = shared.hint("shuffle_hash")
    alone = F.log((F.lit(1.0) + n_docs) / 2) + 1
    w = tf.join(shared, "term", "left").select("pos", _w_raw(F.col("tf"), F.coalesce("idf", alone)).alias("w"))
    return w.groupBy("pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


class FittedIndex(TfidfIndex):
    """An index whose norms are written, bucketed like its postings, by the first reader that scores: a
    reader of the vocabulary alone does not pay for them."""

    @property
    def norms(self) -> DataFrame:
        if self._norms is None:
            from ..session import materialize_buckets
            buckets = int(self._plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self._norms = materialize_buckets(self._plan.repartition(buckets, "pos"), "norms", "pos", buckets)
        return self._norms

    @norms.setter
    def norms(self, plan: DataFrame) -> None:
        self._plan, self._norms = plan, None


class CodedIndex(FittedIndex):
    """A fitted index of term codes. Nobody reads its vocabulary as a table: rankings count the terms that are asked, and
    norms meet document frequencies where postings are packed (:mod:`.packed`)."""

    @property
    def norms(self) -> DataFrame:
        if self._norms is None:
            from ..session import materialize_buckets
            from .packed import document_norms as packed_norms
            buckets = int(self.tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            n_docs = float(self.docs.count())
            self._norms = materialize_buckets(packed_norms(self.tf, n_docs).repartition(buckets, "pos"), "norms", "pos", buckets)
        return self._norms

    @norms.setter
    def norms(self, plan: DataFrame) -> None:
        self._plan, self._norms = plan, None

    def vocab_of(self, terms: DataFrame) -> DataFrame:
        from ..session import materialize
        df = self.tf.join(terms, "term", "left_semi").groupBy("term").agg(F.count("tf").alias("df"))
        n_docs = self.docs.select(F.count(F.lit(1)).cast("double")).scalar()
        return materialize(df.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1), "asked-vocab")


def build_tfidf_index(corpus: DataFrame, id_col: str = "id", pos_col: str = "pos",
                      title_col: str = "title", text_col: str = "text",
                      category_col: str | None = "category",
                      stop_words: list[str] | None = None, checkpoint: bool = True, coded: bool = False) -> TfidfIndex:
    """Fit the TF-IDF index over a corpus DataFrame.

    ``pos`` (unique, numeric) is the internal document key. With ``checkpoint``
    (the default) the three index tables are fitted once and written to the
    shared checkpoint folder: term frequencies, then the vocabulary (a partial
    aggregate per term), then the document norms (tf joined to idf on term -- a
    hot term is a skewed key that AQE's skew join splits -- aggregated per
    document). The texts are dealt by ``pos`` once; a document's terms are
    counted where its text is, and tf and norms are written bucketed by ``pos``
    with as many buckets as shuffle partitions. A ranking scans the written
    tables: it never re-tokenises the corpus, and its sums per (question,
    document) and the norms join run inside a bucket, without an exchange.
    """
    from ..session import materialize, materialize_buckets
    cols = [F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), F.col(title_col).alias("title")]
    cols.append(F.col(category_col).alias("category") if category_col else F.lit(None).alias("category"))
    docs = corpus.select(*cols)
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    texts = corpus.select(F.col(pos_col).alias("pos"), doc_text(F.col(title_col), F.col(text_col)).alias("_t"))
    buckets = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if checkpoint:
        texts = texts.repartition(buckets, "pos")
    if coded:
        tf = code_frequencies(texts, "pos", F.col("_t"), stop_words, dealt=checkpoint)
    else:
        tf = (dealt_frequencies if checkpoint else term_frequencies)(texts, ["pos"], F.col("_t"), stop_words)
    if checkpoint:
        tf = materialize_buckets(tf, "tf", "pos", buckets)
    vocab = (tf.groupBy("term").agg(F.count("tf").alias("df"))
             .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1))
    if checkpoint and not coded:
        vocab = materialize(vocab, "vocab")
    norms = document_norms(tf, vocab, n_docs)
    if checkpoint:
        return (CodedIndex if coded else FittedIndex)(docs, tf, vocab, norms, stop_words, fitted=True, coded=coded)
    return TfidfIndex(docs, tf, vocab, norms, stop_words, coded=coded)


# Question-side term rows (q_id, term) are broadcast to the scans of the index
# tables only up to this many rows (counted first); beyond it both joins are
# shuffle joins on term.
MAX_BROADCAST_QUERY_TERMS = 1_000_000


def query_vectors(questions: DataFrame, index: TfidfIndex, q_col: str = "q_id",
                  text_col: str = "question", broadcast: bool | None = None) -> DataFrame:
    """(q_id, term, idf, weight): out-of-vocabulary terms dropped before normalising.

    ``broadcast`` says whether the question terms may be broadcast to the
    vocabulary scan; ``None`` decides by counting them first.
    """
    tf = term_frequencies(questions.select(F.col(q_col).alias("q_id"), F.col(text_col).alias("_t")),
                          ["q_id"], F.col("_t"), index.stop_words, index.coded)
    if broadcast is None:
        broadcast = tf.count() <= MAX_BROADCAST_QUERY_TERMS
    q = F.broadcast(tf) if broadcast else tf
    asked = tf.select("term").distinct()
    w = (q.join(index.vocab_of(F.broadcast(asked) if broadcast else asked).select("term", "idf"), "term")
         .select("q_id", "term", "idf", _w_raw(F.col("tf"), F.col("idf")).alias("w_raw")))
    return _l2_normalised(w, "q_id")


def first_k_docs(docs: DataFrame, k: int) -> Column:
    """Scalar subquery: the first k corpus documents by position, as array<struct<pos,id>>."""
    return (docs.select("pos", "id").orderBy("pos").limit(k)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("a")).scalar())


def rank_top_k(scored: DataFrame, k: int, score_col: str = "score_raw",
               part: str = "q_id") -> DataFrame:
    """Keep rows with row_number() <= k per ``part``, by score desc then position."""
    w = Window.partitionBy(part).orderBy(F.round(F.col(score_col), RANK_DIGITS).desc(),
                                         F.col("pos").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_term_rows(questions: DataFrame, stop_words: list[str] | None = None,
                    q_col: str = "q_id", text_col: str = "question") -> int:
    """Number of (question, term) rows of a question table: the size that
    decides whether question vectors are broadcast. One job over the questions."""
    return term_frequencies(questions.select(F.col(q_col).alias("q_id"), F.col(text_col).alias("_t")),
                            ["q_id"], F.col("_t"), stop_words).count()


def tfidf_topk(questions: DataFrame, index: TfidfIndex, k: int, pad: bool = True,
               q_col: str = "q_id", text_col: str = "question",
               allowed_docs: DataFrame | None = None,
               query_terms: int | None = None) -> DataFrame:
    """Cosine top-k for every question at once.

    Returns (q_id, rank, id, pos, score). With ``pad`` every question gets
    min(k, N) rows. ``allowed_docs`` (a DataFrame with an ``id`` column)
    restricts the candidates *before* ranking; idf stays that of the full index.
    Document ids are joined back only to the k winners per question.
    ``query_terms`` is an upper bound on the questions' term rows when the
    caller knows one (say, from a superset of the questions); otherwise they
    are counted here.
    """
    # one number bounds both question-side joins: question vectors have at most
    # as many rows as question terms. Small: broadcast them to the scans of the
    # vocabulary and of tf (tf is never shuffled). Large: shuffle joins on term.
    if query_terms is None:
        query_terms = query_term_rows(questions, index.stop_words, q_col, text_col)
    small = query_terms <= MAX_BROADCAST_QUERY_TERMS
    qv = query_vectors(questions, index, q_col, text_col, broadcast=small)
    docs = index.docs
    # the question side carries idf, so the big tf table is joined as stored
    contrib = (F.broadcast(qv) if small else qv).join(index.tf, "term").select(
        "q_id", "pos", (F.col("weight") * _w_raw(F.col("tf"), F.col("idf"))).alias("c"))
    if allowed_docs is not None:
        docs = docs.join(allowed_docs.select("id").distinct(), "id", "left_semi")
    pads = questions.select(F.col(q_col).alias("q_id"), F.explode(first_k_docs(docs, k)).alias("p")) \
        .select("q_id", F.col("p.pos").alias("pos")) if pad else None
    return _rank_contributions(contrib, index, docs, k, pads, docs.select("pos") if allowed_docs is not None else None)


def _rank_contributions(contrib: DataFrame, index: TfidfIndex, docs: DataFrame, k: int,
                        pads: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(q_id, pos, c) -> top-k (q_id, rank, id, pos, score): sums per (question,
    document) and the cosine by the document norm inside the index's buckets,
    ``row_number() <= k`` (a partial ``WindowGroupLimit`` before the one shuffle),
    ids joined to the winners. ``only`` (pos) restricts the documents once the
    terms have cut the index down. ``pads`` (q_id, pos) are candidates with score 0,
    ranked with the winners: at most 2k rows per question, so a pad that scores but
    is no winner has k better rows before it."""
    summed = contrib.groupBy("q_id", "pos").agg(F.sum("c").alias("dot"))
    if only is not None:
        summed = summed.join(only, "pos", "left_semi")
    # norms are hashed: sums per (question, document) outnumber them by far and are not sorted to meet them
    scored = summed.join(index.norms.hint("shuffle_hash"), "pos", "left").select(
        "q_id", "pos", F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)).alias("score_raw"))
    top = rank_top_k(scored, k)
    if pads is not None:
        both = top.select("q_id", "pos", "score_raw").unionByName(pads.withColumn("score_raw", F.lit(0.0)))
        top = rank_top_k(both.groupBy("q_id", "pos").agg(F.max("score_raw").alias("score_raw")), k)
    top = top.join(docs.select("pos", "id"), "pos")
    return top.select("q_id", "rank", "id", "pos",
                      F.round("score_raw", OUT_DIGITS).alias("score"))


def texts_of(docs_text: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs_text`` that a written ``ranked`` names: while its rows are few (counted), their ids are brought to
    the texts, and the corpus is not dealt by id to meet them."""
    ids = ranked.select("id").distinct()
    few = ranked.count() <= MAX_BROADCAST_QUERY_TERMS
    return docs_text.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def tenant_topk(questions: DataFrame, index: TfidfIndex, doc_tenants: DataFrame, k: int,
                pad: bool = True, q_col: str = "q_id", text_col: str = "question",
                tenant_col: str = "tenant", query_terms: int | None = None) -> DataFrame:
    """Cosine top-k where every question searches only its own tenant's documents.

    ``questions`` carries (q_id, question, tenant) and ``doc_tenants`` (pos,
    tenant). Question terms cut the index first; what they hit is joined to
    ``doc_tenants`` on pos and cut to the question's tenant before it is summed, inside the index's buckets,
    so no document of another tenant is ever scored. Padding takes the first k documents *of the question's tenant* (a
    per-tenant ``row_number() <= k``, partially limited before its shuffle).
    Rows without a tenant on either side never match; report them with
    ``tenant_rejects``. idf stays that of the shared index, as with any
    filter applied before ranking (R8). Returns (q_id, tenant, rank, id, pos, score).
    ``query_terms`` bounds the question term rows as in ``tfidf_topk``.
    """
    qs = questions.select(F.col(q_col).alias("q_id"), F.col(text_col).alias("question"),
                          F.col(tenant_col).alias("tenant")).where(F.col("tenant").isNotNull())
    dt = doc_tenants.select("pos", F.col(tenant_col).alias("tenant")).where(F.col("tenant").isNotNull())
    if query_terms is None:
        query_terms = query_term_rows(qs, index.stop_words)
    small = query_terms <= MAX_BROADCAST_QUERY_TERMS
    qv = query_vectors(qs, index, broadcast=small).join(qs.select("q_id", "tenant"), "q_id")
    hits = (F.broadcast(qv) if small else qv).join(index.tf, "term").select(
        "q_id", "tenant", "pos", (F.col("weight") * _w_raw(F.col("tf"), F.col("idf"))).alias("c"))
    # written as two bounds: with the tenant as a second join key Spark would deal the hits anew
    owner = dt.withColumnRenamed("tenant", "_owner")
    contrib = hits.join(owner, "pos").where("tenant >= _owner and tenant <= _owner").select("q_id", "pos", "c")
    docs = index.docs.join(dt.select("pos"), "pos", "left_semi")
    pads = None
    if pad:
        first = dt.withColumn("_r", F.row_number().over(Window.partitionBy("tenant").orderBy("pos")))
        pads = qs.select("q_id", "tenant").join(first.where(F.col("_r") <= k), "tenant").select("q_id", "pos")
    top = _rank_contributions(contrib, index, docs, k, pads)
    return top.join(qs.select("q_id", "tenant"), "q_id").select(
        "q_id", "tenant", "rank", "id", "pos", "score")


def tenant_rejects(questions: DataFrame, docs: DataFrame, q_col: str = "q_id",
                   doc_col: str = "id", tenant_col: str = "tenant") -> DataFrame:
    """Rows that lack a tenant and are kept out of every retrieval: (kind, key, reason)."""
    q = questions.where(F.col(tenant_col).isNull()).select(
        F.lit("question").alias("kind"), F.col(q_col).cast("string").alias("key"))
    d = docs.where(F.col(tenant_col).isNull()).select(
        F.lit("document").alias("kind"), F.col(doc_col).cast("string").alias("key"))
    return q.unionByName(d).withColumn("reason", F.lit("missing tenant"))


def rank_derived_score(ranked: DataFrame, part: str = "q_id", rank_col: str = "rank") -> DataFrame:
    """Score a ranked list by position: (n - rank0) / n, n = rows of the list."""
    n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(part)), F.lit(1))
    return ranked.withColumn("rank_score", F.round((n - (F.col(rank_col) - 1)) / n, OUT_DIGITS))


# -- dense vectors -------------------------------------------------------------------

def _vector_topk_fn(bc, k: int):
    def fn(batches):
        query_ids, query_mat = bc.value
        qn = query_mat / np.maximum(np.linalg.norm(query_mat, axis=1, keepdims=True), 1e-300)
        for pdf in batches:
            if pdf.empty:
                continue
            d = np.vstack(pdf["vec"].to_numpy()).astype(np.float64)
            dn = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
            kk = min(k, len(dn))
            pos = pdf["pos"].to_numpy()
            block = max(1, PRODUCT_VALUES // len(dn))
            for lo in range(0, len(qn), block):
                sims = qn[lo:lo + block] @ dn.T    # (queries of the block, docs in this batch)
                # partial top-k per query inside the batch: exactly k, cut by the final ranking's
                # own key (rounded score, then position), so near-ties cannot lose a row
                di = np.concatenate([np.lexsort((pos, -row))[:kk] for row in np.round(sims, 9)])
                qi = np.repeat(np.arange(len(sims)), kk)
                yield pd.DataFrame({
                    "q_id": query_ids[lo + qi],
                    "id": pdf["id"].to_numpy()[di],
                    "pos": pos[di],
                    "score_raw": sims[qi, di],
                })
    return fn


VECTOR_OUT = T.StructType([
    T.StructField("q_id", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("pos", T.LongType()), T.StructField("score_raw", T.DoubleType()),
])

# Query vectors are broadcast to every task; above this many values the
# queries are split by hash into several passes over the corpus instead.
MAX_BROADCAST_QUERY_VALUES = 4_000_000
# Similarities held at once by a task (64 MB).
PRODUCT_VALUES = 8_000_000


def vector_topk(query_vecs: DataFrame, doc_vecs: DataFrame, k: int,
                q_col: str = "q_id", vec_col: str = "vec",
                id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Exact cosine top-k of every query vector over a corpus of vectors.

    The query matrix is broadcast only in passes of at most
    ``MAX_BROADCAST_QUERY_VALUES`` values (size checked with one aggregate
    first; larger query sets are split by hash of the query id). Each corpus
    partition computes its similarities with one matrix product (Arrow batches
    through ``mapInPandas``) and emits only its own top-k per query; the global
    top-k is a ``row_number`` window. Query x document pairs are never
    materialised as rows. A vector that is null, or not as long as the longest query
    vector, is similar to nothing and is left out on either side.
    """
    spark = query_vecs.sparkSession
    qv = query_vecs.select(F.col(q_col).cast("long").alias("q_id"),
                           F.col(vec_col).cast("array<double>").alias("vec"))
    stats = qv.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n_q, dims = int(stats["n"]), int(stats["dims"] or 0)
    out_schema = "q_id long, rank int, id long, pos long, score double"
    if n_q == 0 or dims <= 0:
        return spark.createDataFrame([], out_schema)
    passes = max(1, -(-(n_q * max(dims, 1)) // MAX_BROADCAST_QUERY_VALUES))
    qv = qv.where(F.size("vec") == dims)
    docs = doc_vecs.select(F.col(id_col).cast("long").alias("id"),
                           F.col(pos_col).cast("long").alias("pos"),
                           F.col(vec_col).cast("array<double>").alias("vec")).where(F.size("vec") == dims)
    cand = None
    for p in range(passes):
        part = qv if passes == 1 else qv.where(F.pmod(F.hash("q_id"), F.lit(passes)) == p)
        chunk = part.toPandas()   # bounded: at most MAX_BROADCAST_QUERY_VALUES values
        if chunk.empty:
            continue
        mat = np.vstack(chunk["vec"].to_numpy()).astype(np.float64)
        ids = chunk["q_id"].to_numpy().astype(np.int64)
        bc = spark.sparkContext.broadcast((ids, mat))
        res = docs.mapInPandas(_vector_topk_fn(bc, k), VECTOR_OUT)
        cand = res if cand is None else cand.unionByName(res)
    top = rank_top_k(cand, k)
    return top.select("q_id", "rank", "id", "pos", F.round("score_raw", OUT_DIGITS).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, rrf_k: int = 60,
                           part: str = "q_id") -> DataFrame:
    """Fuse ranked lists (q_id, rank, pos, ...) by sum of 1/(rrf_k + rank); top-k.

    Returns (q_id, rank, pos, fused) ordered by fused desc, then position.
    """
    u = None
    for r in rankings:
        x = r.select(part, "pos", (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("c"))
        u = x if u is None else u.unionByName(x)
    fused = u.groupBy(part, "pos").agg(F.sum("c").alias("score_raw"))
    top = rank_top_k(fused, k, part=part)
    return top.select(part, "rank", "pos", F.round("score_raw", OUT_DIGITS).alias("fused"))


def federated_topk(rankings: list[tuple[str, DataFrame]], k: int, rrf_k: int = 60,
                   part: str = "q_id") -> DataFrame:
    """Search several corpora and merge their ranked lists.

    ``rankings`` pairs a corpus name with a ranked list (q_id, rank, id, pos)
    over that corpus. Items are keyed by (corpus, id), so lists over the same
    corpus (say, two retrievers) add their reciprocal ranks, while lists over
    different corpora interleave by rank. Ties go to the earlier corpus in
    ``rankings``, then to corpus position. Returns (q_id, rank, corpus, id,
    fused), k rows per question at most.
    """
    u = None
    for no, (name, r) in enumerate(rankings):
        x = r.select(part, F.lit(name).alias("corpus"), F.lit(no).alias("corpus_no"), "id", "pos",
                     (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("c"))
        u = x if u is None else u.unionByName(x)
    fused = u.groupBy(part, "corpus", "id").agg(F.min("corpus_no").alias("corpus_no"),
                                                F.first("pos").alias("pos"),
                                                F.sum("c").alias("score_raw"))
    w = Window.partitionBy(part).orderBy(F.round("score_raw", RANK_DIGITS).desc(),
                                         F.col("corpus_no").asc(), F.col("pos").asc())
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(part, "rank", "corpus", "id", F.round("score_raw", OUT_DIGITS).alias("fused"))
