"""Helpers shared by the corpus operators: written intermediate tables."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coverwise.session import ensure_checkpoint_dir, scratch_path

from . import texthash

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    The table replaces the lineage, so a lost executor costs at most the running
    stage, and the shuffle files of the writing job are released when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy(task: Callable) -> Callable:
    """``task`` for ``mapInArrow`` that gives memory back when it ends. Its Python worker lives on and serves tasks of other
    steps; several such workers share what an executor has beside its heap."""
    def run(batches):
        yield from task(batches)
        texthash.forget_powers()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what it has
            pass
    return run
