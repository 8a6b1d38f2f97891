"""Session helpers.

The library never creates a session behind the caller's back in library code:
operators take DataFrames. These helpers exist for tests, ``bench.py`` and the
driver entry point, and they encode the settings every compared query relies on
(UTC session time zone, AQE on, no UI).
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results or plans; applied to every session we build.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "coverwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("COVERWISE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is always used as
    is; a cluster session without it is an error, because a machine-local
    folder would scatter the written tables over the executors. Only a local
    session (tests, bench) may leave it unset: then we pick a scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               f"executors share (master is {master!r})")
        path = tempfile.mkdtemp(prefix="coverwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "coverwise", *parts])


def materialize(df, name: str = "t"):
    """Compute ``df`` once and cut its lineage with a table written to the shared
    checkpoint folder (``spark.checkpoint.dir``), then read it back.

    One write job, columnar and compressed; an executor loss after this point
    only re-reads files. (An eager ``checkpoint()`` would run its input twice
    unless cached, and caching costs extra jobs.)
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_buckets(df, name: str, key: str | list[str], buckets: int):
    """Like :func:`materialize`, as a table bucketed by ``key`` (or a list of keys): joins and sums on the key
    then run inside a bucket. ``df`` should be dealt by ``repartition(buckets, key)``, which
    gives one file per bucket. The table's files lie in the shared checkpoint folder."""
    import uuid
    spark = df.sparkSession
    table = f"coverwise_{name}_{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    df.write.bucketBy(buckets, *keys).option("path", scratch_path(spark, "tables", table)).saveAsTable(table, format="parquet")
    return spark.table(table)
