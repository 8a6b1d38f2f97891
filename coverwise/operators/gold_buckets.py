"""Gold as a bucketed table that a merge rewrites only where something changed.

Rows lie in buckets by the hash of their id. A version of the table is a list of one folder per bucket
(the manifest); a load writes new folders for the buckets it touches and a new manifest that
names the old folders of all others, then publishes it (:func:`coverwise.sources.sinks.publish`). Readers take the
manifest published last, so they see the old version or the new one, and an unchanged bucket keeps its files.

What a load touches is decided without texts: every row is stored with a digest of its content, and the change set is
one full outer join of (id, digest) by id. Only the touched buckets' rows are then read and merged whole.

A load is named by the caller and applied once: a load whose manifest is published is not applied again, and one
that failed before that is written anew.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import sinks
from . import medallion as med

#: Buckets of a new table: a number by its size, about 256 MB of rows each.
BUCKETS = 32
STORED = [*med.GOLD_COLUMNS, "digest"]


def bucket_of(id_: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def digest() -> Column:
    """Of the columns whose change is an update. Null and '' differ: a null field is left out of the JSON."""
    return F.sha2(F.to_json(F.struct("title", "category", "text", "lineage_sk", "is_active")), 256)


class GoldBuckets:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    # -- versions --------------------------------------------------------------------------------

    def loads(self) -> list[str]:
        """Names of the published loads, oldest first (one small row per load)."""
        path = f"{self.base}/_published"
        p, fs = sinks.fs_path(self.spark, path)
        if not fs.exists(p):
            return []
        rows = self.spark.read.parquet(path).groupBy("path").agg(F.min("at").alias("at")).orderBy("at").collect()
        return [r["path"].rsplit("load=", 1)[1] for r in rows]

    def manifest(self, load: str | None = None) -> dict[int, str]:
        """bucket -> folder of a load's version, the last one by default; at most one row per bucket."""
        names = self.loads()
        if not names:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.base}/manifest/load={load or names[-1]}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = "id string, title string, category string, text string, effective_date date, is_active boolean, " \
                 "lineage_sk string, updated_at timestamp_ntz, digest string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, load: str | None = None) -> DataFrame:
        """The table as of a load, the last one by default."""
        return self._rows(sorted(self.manifest(load).values())).select(*med.GOLD_COLUMNS)

    def changes(self, load: str) -> DataFrame:
        """(id, change) of the rows that a load inserted, updated or deactivated."""
        return self.spark.read.schema("id string, change string").parquet(f"{self.base}/changes/load={load}")

    # -- a load ------------------------------------------------------------------------------------

    def merge(self, load: str, incoming: DataFrame, full: bool = True) -> list[int]:
        """Apply ``incoming`` (GOLD_COLUMNS, one row per id) and return the buckets it rewrote.

        ``full``: incoming is the whole new table, and ids it no longer holds are deactivated as in
        :func:`~coverwise.operators.medallion.merge_gold`; only digests of the current table are read to find what changed.
        Else it holds some ids only, all others stay as they are, and only the buckets of its ids are looked at.
        Rows without an id are not taken. An empty load changes no bucket.
        """
        if load in self.loads():
            return []
        current = self.manifest()
        new = materialize(incoming.where("id IS NOT NULL").select(*med.GOLD_COLUMNS, digest().alias("digest"),
                                                                  bucket_of("id", self.buckets).alias("bucket")), "gold-incoming")
        at = range(self.buckets) if full else [r[0] for r in new.select("bucket").distinct().collect()]
        have = self._rows([current[b] for b in at if b in current])
        light = have.select(F.col("id").alias("c_id"), F.col("digest").alias("c_digest"),
                            F.col("is_active").alias("c_active"), F.col("updated_at").alias("c_at"))
        known, given = F.col("c_id").isNotNull(), F.col("id").isNotNull()
        gone = F.when(F.lit(full) & F.col("c_active"), "deactivate")
        change = (F.when(~known, "insert").when(~given, gone)
                  .when(F.col("c_digest") != F.col("digest"), "update").when(~F.col("c_at").eqNullSafe(F.col("updated_at")), "touch"))
        delta = (new.select("id", "digest", "updated_at").join(light, F.col("id") == F.col("c_id"), "full_outer")
                 .select(F.coalesce("id", "c_id").alias("id"), change.alias("change")).where("change IS NOT NULL"))
        delta = materialize(delta.withColumn("bucket", bucket_of("id", self.buckets)), "gold-delta")
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())   # at most one row per bucket

        folders = dict(current)
        if touched:
            old = self._rows([current[b] for b in touched if b in current])
            rows = med.merge_gold(old, new.where(F.col("bucket").isin(touched)))
            if not full:  # an id that is not in the load is not gone
                rows = rows.withColumn("is_active", (F.col("change") == "deactivate") | F.col("is_active"))
            out = f"{self.base}/rows/load={load}"
            (rows.withColumn("digest", digest()).select(*STORED, bucket_of("id", self.buckets).alias("bucket"))
             .repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(out))
            folders |= {b: f"{out}/bucket={b}" for b in touched}
        delta.where("change <> 'touch'").select("id", "change").write.mode("overwrite").parquet(f"{self.base}/changes/load={load}")
        version = f"{self.base}/manifest/load={load}"
        self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(version)
        sinks.publish(self.spark, self.base, version)
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Delete the rows' folders that none of the last ``keep`` versions names, and return their number."""
        names = self.loads()
        used = {f for n in names[-keep:] for f in self.manifest(n).values()}
        old = {f for n in names[:-keep] for f in self.manifest(n).values()} - used
        for f in old:
            sinks.drop_path(self.spark, f)
        return len(old)
