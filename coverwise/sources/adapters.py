"""Deterministic adapters from the driver tables to the domain datasets.

Every adapter is a pure projection (plus, for gold, one left join to
``labels``), so Catalyst fuses it into the consumer's scan stage. The mapping is
the one written down in FIXTURES.md section 3; ``oracle`` holds the same
mapping in DuckDB SQL.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# Fixed timestamp used as "now" in every compared query (repeatable results).
AS_OF = datetime(2024, 2, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
LANDING_EPOCH_SQL = "timestamp_ntz'2024-01-01 00:00:00'"


def as_of_col(as_of: datetime | None = None) -> Column:
    """The injected clock as a ``timestamp_ntz`` literal."""
    ts = as_of or AS_OF
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input is under-parallelised.

    Driver parquet files hold a single row group, so they scan as one task.
    On a cluster, inputs are many files and this is a no-op (no extra shuffle).
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def raw_policy_feed(documents: DataFrame) -> DataFrame:
    """bronze.raw_policy_feed from ``documents``."""
    d = F.col("doc_id")
    body = (F.when(d % 101 == 0, F.lit(None).cast("string"))
             .when(d % 97 == 0, F.lit("   "))
             .otherwise(F.col("text")))
    return documents.select(
        F.concat(F.lit("doc-"), d.cast("string")).alias("source_id"),
        F.col("source").alias("source_system"),
        F.concat(F.lit("batch_"), (d % 7).cast("string")).alias("ingest_batch_id"),
        F.expr(f"{LANDING_EPOCH_SQL} + make_dt_interval(0, 0, 0, doc_id)").alias("ingested_at"),
        F.substring("text", 1, 60).alias("raw_title"),
        F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")).alias("raw_category"),
        body.alias("raw_body"),
        F.parse_json(F.to_json(F.struct(F.col("n_chars")))).alias("raw_metadata"),
        F.when(d % 53 == 0, F.lit(None).cast("string")).otherwise(F.md5("text")).alias("file_hash"),
    )


def raw_member_events(events: DataFrame) -> DataFrame:
    """bronze.raw_member_events from ``events`` (identifier hashed at landing)."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("member_id_hash"),
        F.parse_json("props").alias("payload"),
        F.col("ts").alias("ingested_at"),
    )


def active_flags(labels: DataFrame) -> DataFrame:
    """Per policy id: active unless a label row marks quality 0."""
    return labels.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("label_policy_id"),
        (F.col("quality") == 1).alias("label_active"),
    )


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


# Markup removal for the web-page corpus: script and style elements with their
# contents, then every remaining tag (each replaced by a space).
SCRIPT_STYLE = r"(?s)<(script|style)[^>]*>.*?</(script|style)>"
MARKUP_TAG = r"<[^>]*>"
PAGE_TITLE = r"<title>([^<]*)</title>"


def page_corpus(pages: DataFrame) -> DataFrame:
    """A second searchable corpus from raw web pages: (id, pos, title, category, text).

    The text is the page with scripts, styles and tags removed; the title is
    the ``<title>`` element; the corpus position is the page number.
    """
    text = F.regexp_replace(F.regexp_replace("html", SCRIPT_STYLE, " "), MARKUP_TAG, " ")
    return pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.col("page_id").cast("long").alias("pos"),
        F.regexp_extract("html", PAGE_TITLE, 1).alias("title"),
        F.lit("web").alias("category"),
        text.alias("text"),
    )


def corpus_position(id_col: str = "id") -> Column:
    """Corpus position of a gold row: the numeric part of ``doc-<n>``."""
    return F.regexp_extract(F.col(id_col), r"(\d+)$", 1).cast("long")


# -- convenience loaders used by the query catalogue ---------------------------------

def bronze_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_policy_feed(tables.documents(spark, sf_dir))


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_member_events(tables.events(spark, sf_dir))
