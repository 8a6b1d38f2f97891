"""Registered queries of the corpus operators and their DuckDB oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, language_id, ngram_join, packing, pivots, quality, runs, sharding, substring_dedup, suffix_dedup, token_files, warc
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents", "doc_id", "text"),
                                      read(spark, sf_dir, "benchmark", "item_id", "text"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return token_files.read_tokens(spark, folder, manifest).drop("ids")


def op4_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected", "entropy")


def op5_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_substrings(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents", "doc_id", "text"), 40)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_warc(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.alignments(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    told = aligned.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links",
                          F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
    return told.join(alignment.link_support(aligned), "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.word_runs(runs.with_repeated_tails(read(spark, sf_dir, "documents", "doc_id", "text")))
    line = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_decontamination, op3_token_files, op4_kneser_ney_language, op5_suffix_sort, op6_sum_of_squares_packing, op7_quality_rules,
                                       op8_sentence_spans, op9_slot_sharding, op10_warc, op11_token_alignment, op12_periodic_runs, op13_pivot_permutation, pipeline)}


def oracles() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_join.ORACLE, "op2_decontamination": decontamination.ORACLE, "op8_sentence_spans": substring_dedup.ORACLE, "op10_warc": warc.ORACLE, "op12_periodic_runs": runs.ORACLE, "op13_pivot_permutation": pivots.ORACLE}
