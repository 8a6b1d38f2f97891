"""Substring dedup over sliding sentence spans.

A text is cut into sentences (up to ``.``, ``!``, ``?``, their wide forms or a line end, terminators
and following marks included, so the sentences concatenate to the text). From every sentence a run of
consecutive sentences is taken that is as short as may be: ``SPAN`` sentences at least, and as many as it takes to
hold ``MIN_WORDS`` words. Short lines thereby make longer runs, not none. In scripts without spaces
``WORD_CHARS`` characters count as a word. A single sentence of ``LONG_WORDS`` words or more is a run
too. Every run is hashed. Equal runs are found
by one global aggregation on the hash; the first occurrence (smallest document id,
then position) stays, and every sentence covered by any later occurrence is removed.
Runs are judged on the input, not on what is left; case and runs of white space
do not distinguish two runs.

Hashes are a 64-bit and a 32-bit function of the run's sentences, compared together.
A run that a third of the documents share is summed before the shuffle; the join
back is an equi-join on the hash whose skewed partitions are split at run time.

Defined results: null is the empty text: no sentences, nothing removed; a text of
marks only is one sentence that never repeats (no words); repeated rows are later
occurrences of the first (for equal ids the order among them is arbitrary, one
stays: every run of the other rows with its id and text is a later one); only the
named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SPAN = 2
MIN_WORDS = 12
LONG_WORDS = 40
WORD_CHARS = 8
_SENTENCE = r"[^.!?\n。！？]+[.!?\n。！？]*|^[.!?\n。！？]+"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SENTENCE), F.lit(0))


def _keys(s: Column) -> Column:
    return F.transform(s, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))


def _n_words(x: Column) -> Column:
    """Words of a sentence, a word for every WORD_CHARS characters if that is more, one at least."""
    spaces = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.greatest(spaces + 1, F.floor(F.length(x) / WORD_CHARS).cast("int"))


def runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, rid, at, n, h, h2): every run, ``n`` sentences from sentence ``at``."""
    cut = docs.select("doc_id", "rid", _keys(sentences(F.col("text"))).alias("k")) \
        .select("doc_id", "rid", "k", F.transform("k", _n_words).alias("c"))

    def run(i, n):
        of = F.slice("k", i + 1, n)
        return F.struct(i.alias("at"), n.alias("n"), F.xxhash64(of).alias("h"), F.hash(of).alias("h2"))

    def enough(i):
        """Sentences that a run from ``i`` takes; null where the text ends before. Each has a word at least."""
        words = sum((F.get("c", i + j) for j in range(1, span)), F.get("c", i))
        n = F.when(words >= min_words, F.lit(span))
        for more in range(span, min_words):
            words = words + F.get("c", i + more)
            n = n.when(words >= min_words, F.lit(more + 1))
        return n

    size = F.size("k")
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    many = F.transform(F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), enough(i).alias("n"))), lambda x: x["n"].isNotNull()),
                       lambda x: run(x["i"], x["n"]))
    single = F.transform(F.filter(every, lambda i: F.get("c", i) >= long_words), lambda i: run(i, F.lit(1)))
    return cut.select("doc_id", "rid", F.explode(F.concat(many, single)).alias("r")).select("doc_id", "rid", "r.*")


def repeated_runs(r: DataFrame) -> DataFrame:
    """(doc_id, rid, at, n): the occurrences that are not the first of their run."""
    first = (r.groupBy("n", "h", "h2").agg(F.min(F.struct("doc_id", "rid", "at")).alias("first"), F.count("*").alias("times"))
             .where(F.col("times") > 1).drop("times"))
    here = F.struct("doc_id", "rid", "at")
    return r.join(first, ["n", "h", "h2"]).where(here > F.col("first")).select("doc_id", "rid", "at", "n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                   min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, n_spans, kept_text) for every row of ``docs``.

    ``removed`` holds the numbers of the removed sentences, ``n_spans`` counts their
    maximal runs and ``kept_text`` is the concatenation of the others.
    """
    # rid tells rows with the same id apart; it depends on the row alone, so a rerun agrees
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("rid", F.xxhash64("text"))
    r = save(runs(d, span, min_words, long_words), "sentence-runs")
    copied = save(d.groupBy("doc_id", "rid").agg(F.count("*").alias("rows")).where("rows > 1"), "sentence-copies")
    gone = repeated_runs(r).withColumn("copy", F.lit(False))
    d = d.withColumn("copy", F.lit(False))
    if not copied.isEmpty():
        of = copied.toDF("of_id", "of_rid", "rows")
        is_copied = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("rid") == F.col("of_rid"))
        gone = gone.unionByName(r.join(of, is_copied, "left_semi").withColumn("copy", F.lit(True)).select(*gone.columns))
        # rows with equal id and text are the same but for their number: the first is as ever, the others are copies
        again = d.join(of, is_copied, "left_semi").groupBy("doc_id", "rid").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
        again = again.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        d = d.join(of, is_copied, "left_anti").unionByName(again.select("doc_id", "text", "rid", (F.col("no") > 1).alias("copy")))
    cover = (gone.groupBy("doc_id", "rid", "copy")
             .agg(F.collect_set(F.struct("at", "n")).alias("spans")))  # as many as the document has sentences
    cover = save(cover.select(
        F.col("doc_id").alias("c_id"), F.col("rid").alias("c_rid"), F.col("copy").alias("c_copy"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).alias("removed")), "sentence-cover")
    # the texts are dealt by id whatever the size of the other side: cost grows evenly with the input
    s = d.join(cover.hint("merge"), d["doc_id"].eqNullSafe(cover["c_id"]) & (d["rid"] == cover["c_rid"]) & (d["copy"] == cover["c_copy"]), "left") \
        .select("doc_id", sentences(F.col("text")).alias("s"),
                F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    starts = F.size(F.filter("removed", lambda x, i: (i == 0) | (F.get("removed", i - 1) != x - 1)))
    keep_at = F.array_except(F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>")), F.col("removed"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"),
                    "removed", starts.cast("long").alias("n_spans"),
                    F.array_join(F.transform(keep_at, lambda i: F.get("s", i)), "").alias("kept_text"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^.!?\n。！？]+[.!?\n。！？]*|^[.!?\n。！？]+'), []) AS s FROM documents
), keyed AS (
  SELECT doc_id, s, list_transform(s, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS k FROM cut
), counted AS (
  SELECT doc_id, s, k, list_transform(k, lambda x: greatest(length(x) - length(replace(x, ' ', '')) + 1, length(x) // 8)) AS c
  FROM keyed
), started AS (
  SELECT doc_id, k, c, unnest(range(1, len(k) + 1)) AS i FROM counted
), spans AS (
  SELECT doc_id, k, i, list_filter(range(2, 13), lambda m: i + m - 1 <= len(c) AND list_sum(c[i:i + m - 1]) >= 12)[1] AS n FROM started
), runs AS (
  SELECT doc_id, i AS pos, n, array_to_string(k[i:i + n - 1], chr(1)) AS run FROM spans WHERE n IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 1, k[i] FROM started WHERE c[i] >= 40
), ranked AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) AS r FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM ranked WHERE r > 1
), starts AS (
  SELECT doc_id, pos, CASE WHEN lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1 THEN 0 ELSE 1 END AS first FROM gone
), per AS (SELECT doc_id, count(*) AS n_removed, sum(first) AS n_spans, list(pos) AS removed FROM starts GROUP BY doc_id
)
SELECT c.doc_id, len(s)::BIGINT AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(array_to_string(list_filter(s, lambda x, i: NOT list_contains(coalesce(removed, []), i)), '')) AS kept_sha256
FROM cut c LEFT JOIN per USING (doc_id)
"""
