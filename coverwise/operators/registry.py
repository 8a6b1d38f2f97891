"""A configuration registry as an append-only event table.

The reference keeps a list of versions in a JSON file that is rewritten on
every change. Here the registry is two event tables, appended to and never
rewritten, and its current state is *derived*:

* ``register`` events: (model_key, event_seq, created_at, config..., metrics...);
  version = position of the event among its key's registrations (L1);
* ``promote`` events: (model_key, version, event_seq, at) (L2).

A version is Production if it is the last one promoted for its key, Archived
if it was promoted before that, otherwise Staging. Current production (L3)
and latest (L4) are per-key aggregates (``max_by``), which Spark computes with
partial aggregation before the shuffle, so a key with a huge event history
never lands in one task as raw rows.
"""
from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import fs_path

STAGING, PRODUCTION, ARCHIVED = "Staging", "Production", "Archived"


def append_events(registrations: DataFrame | None, promotions: DataFrame | None, path: str) -> None:
    """Append register and promote events to the log under ``path`` (shared storage)."""
    for kind, events in (("register", registrations), ("promote", promotions)):
        if events is not None:
            events.write.mode("append").parquet(f"{path}/{kind}")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(registrations, promotions) of a reopened log, in no order; replay orders them by their columns."""
    return spark.read.parquet(f"{path}/register"), spark.read.parquet(f"{path}/promote")


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the log's commits, in order."""
    p, fs = fs_path(spark, f"{path}/_log")
    numbers = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    out = []
    for name in numbers:
        stream = fs.open(fs_path(spark, f"{path}/_log/{name}")[0])
        try:
            out.append((int(name), stream.readUTF()))
        finally:
            stream.close()
    return out


def commit(spark: SparkSession, path: str, registrations: DataFrame | None = None, promotions: DataFrame | None = None,
           key: str = "model_key", order: tuple[str, ...] = ("created_at", "event_seq"), after: int | None = None) -> int:
    """S10 for writers at the same time: write events to a folder of their own, then take the log's next number.

    A number is taken by creating its file where none is (put if absent): of two writers one gets it and the other tries the
    next, so the log orders all commits, and nobody reads events whose commit has no number. A registration holds its rank
    among its commit's, and a commit how many it registers per key: versions follow from the log (:func:`read_commits`).
    ``after`` is the last number the caller has read, where a search for the next one starts.
    """
    folder = f"{path}/events/{uuid.uuid4().hex}"
    if registrations is not None:
        ranked = assign_versions(registrations, key, order).withColumnRenamed("version", "_rank")
        ranked.write.parquet(f"{folder}/register")
        spark.read.parquet(f"{folder}/register").groupBy(key).agg(F.max("_rank").alias("_n")).write.parquet(f"{folder}/counts")
    if promotions is not None:
        promotions.write.parquet(f"{folder}/promote")
    n = after if after is not None else max((k for k, _ in _commits(spark, path)), default=0)
    while True:
        n += 1
        if _take(spark, f"{path}/_log/{n:012d}", folder):
            return n


def _take(spark: SparkSession, file: str, text: str) -> bool:
    """Create ``file`` with ``text`` if it is not there. Written whole under another name first: readers see all or nothing."""
    p, fs = fs_path(spark, file)
    draft = fs_path(spark, f"{file.rsplit('/_log/', 1)[0]}/drafts/{uuid.uuid4().hex}")[0]
    out = fs.create(draft, False)
    out.writeUTF(text)
    out.close()
    fs.mkdirs(p.getParent())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE       # fails where the target exists
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(p), _rename_options(spark, options))
        return True
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def _rename_options(spark: SparkSession, *options):
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, len(options))
    for k, o in enumerate(options):
        array[k] = o
    return array


def read_commits(spark: SparkSession, path: str, key: str = "model_key") -> tuple[DataFrame | None, DataFrame | None]:
    """(registrations with their version, promotions) of the log's commits, each with ``commit`` = its number; None where no
    commit has any. A version is the number its key has in earlier commits plus the rank in its own: the sum runs over
    (key, commit) counts, never over one key's registrations."""
    log = _commits(spark, path)

    def table(name: str) -> DataFrame | None:
        folders = [(n, f"{folder}/{name}") for n, folder in log]
        folders = [(n, f) for n, f in folders if (lambda p, fs: fs.exists(p))(*fs_path(spark, f))]
        if not folders:
            return None
        number = spark.createDataFrame([(f.rsplit("/events/", 1)[1].split("/")[0], n) for n, f in folders], "_writer string, commit long")
        rows = spark.read.parquet(*[f for _, f in folders]).withColumn("_writer", F.regexp_extract(F.col("_metadata.file_path"), "/events/([0-9a-f]+)/", 1))
        return rows.join(number, "_writer").drop("_writer")

    registered, promotions = table("register"), table("promote")
    if registered is not None:
        before = Window.partitionBy(key).orderBy("commit").rowsBetween(Window.unboundedPreceding, -1)
        base = table("counts").select(F.col(key).alias("_key"), F.col("commit").alias("_commit"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        registered = (registered.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("commit") == F.col("_commit")))
                      .withColumn("version", (F.col("_base") + F.col("_rank")).cast("int")).drop("_key", "_commit", "_base", "_rank"))
    return registered, promotions


def assign_versions(registrations: DataFrame, key: str = "model_key",
                    order: tuple[str, ...] = ("created_at", "event_seq")) -> DataFrame:
    """L1: version = count + 1 at registration time, i.e. row_number per key.

    Versions are dense per key in registration order; every registered config
    starts in Staging, whether or not it later passes the gate.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in order])
    return registrations.withColumn("version", F.row_number().over(w))


def registry_state(versions: DataFrame, promotions: DataFrame,
                   key: str = "model_key") -> DataFrame:
    """Stage of every version after replaying all promotions (L2).

    A promotion naming an unregistered version fails in the reference and
    changes nothing, so such events are ignored here (see ``unknown_promotions``).
    """
    promotions = promotions.join(versions.select(key, "version"), [key, "version"], "left_semi")
    last = promotions.groupBy(key).agg(
        F.max_by("version", F.struct("at", "event_seq")).alias("prod_version"))
    ever = promotions.select(key, "version").distinct().withColumn("was_promoted", F.lit(True))
    s = versions.join(last, key, "left").join(ever, [key, "version"], "left")
    stage = (F.when(F.col("version") == F.col("prod_version"), F.lit(PRODUCTION))
              .when(F.col("was_promoted"), F.lit(ARCHIVED))
              .otherwise(F.lit(STAGING)))
    return s.withColumn("stage", stage).drop("prod_version", "was_promoted")


def unknown_promotions(versions: DataFrame, promotions: DataFrame,
                       key: str = "model_key") -> DataFrame:
    """Promote events naming a version that was never registered (the reference raises)."""
    return promotions.join(versions.select(key, "version"), [key, "version"], "left_anti")


def production(state: DataFrame, key: str = "model_key") -> DataFrame:
    """L3: the version in Production per key (keys without one are absent)."""
    return state.where(F.col("stage") == PRODUCTION).groupBy(key).agg(
        F.max("version").alias("version"))


def latest(state: DataFrame, key: str = "model_key") -> DataFrame:
    """L4: the newest version per key, with its stage."""
    return state.groupBy(key).agg(
        F.max_by(F.struct("version", "stage"), F.col("version")).alias("v")).select(
        key, "v.version", "v.stage")
