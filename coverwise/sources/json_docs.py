"""JSON document sources: the knowledge-base and eval-set file shapes.

The reference keeps one JSON object per file with a top-level array
(``documents`` / ``examples``). Spark reads such a file as one record
(``multiLine``), which is fine for a small reference file; for large corpora
write JSON lines (one document per line, ``multiline=False``) so the read
splits across tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("text", T.StringType()),
])

EXAMPLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("relevant_ids", T.ArrayType(T.StringType())),
    T.StructField("must_include", T.ArrayType(T.StringType())),
])


def read_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Documents from ``{"documents": [...]}`` files, or JSON lines of documents."""
    if not multiline:
        return spark.read.schema(DOCUMENT).json(path)
    wrapper = T.StructType([T.StructField("documents", T.ArrayType(DOCUMENT))])
    return (spark.read.schema(wrapper).option("multiLine", True).json(path)
            .select(F.inline("documents")))


def read_eval_set(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Eval examples from ``{"examples": [...]}`` files, or JSON lines of examples."""
    if not multiline:
        return spark.read.schema(EXAMPLE).json(path)
    wrapper = T.StructType([T.StructField("examples", T.ArrayType(EXAMPLE))])
    return (spark.read.schema(wrapper).option("multiLine", True).json(path)
            .select(F.inline("examples")))


def bronze_from_json_documents(staged: DataFrame, json_col: str, source_system: str,
                               ingest_batch_id: str) -> DataFrame:
    """Stage JSON -> bronze rows: parse to VARIANT, flatten ``documents``,
    extract typed fields by path, hash the body (lateral flatten + path casts)."""
    v = staged.select(F.parse_json(F.col(json_col)).alias("v"))
    # lateral flatten: the documents array as array<variant>, one row per element
    docs = v.select(F.explode(F.variant_get("v", "$.documents", "array<variant>")).alias("d"))
    text = F.variant_get("d", "$.text", "string")
    return docs.select(
        F.variant_get("d", "$.id", "string").alias("source_id"),
        F.lit(source_system).alias("source_system"),
        F.lit(ingest_batch_id).alias("ingest_batch_id"),
        F.variant_get("d", "$.title", "string").alias("raw_title"),
        F.variant_get("d", "$.category", "string").alias("raw_category"),
        text.alias("raw_body"),
        F.md5(text).alias("file_hash"),
    )
