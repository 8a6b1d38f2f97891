"""Sharding over fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots (4096 by
default). Bytes and rows are summed per slot in Spark; the slot-to-shard map is
made from those sums alone (one line per slot, so its size is fixed), stored
with a version number, and *edited* when shards are added or loads drift: only
the slots that must move change their shard.

The law that holds is ``bytes``: the shards' sizes are near equal. Balance is as
fine as a slot (or as the largest single record, which cannot be split).

Defined results: a null text has size 16 and CRC 0; an empty text the same;
repeated rows (same id and text) share a slot and get consecutive positions in
an arbitrary but gapless order; a null id is hashed like any other value; an
empty table gives no rows. Only the named columns are read, so extra columns of
any name are ignored.
"""
from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, save

N_SLOTS = 4096
OVERHEAD = 16
ROWS_PER_GROUP = 100_000

MAP_SCHEMA = "version int, vslot int, shard int"


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def virtual_slot(id_col: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record: its id and text decide, so neither a repeated id nor a text
    with many copies fills a slot on its own."""
    return F.pmod(F.xxhash64(id_col, text), F.lit(n_slots)).cast("int")


def initial_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Largest slot first, to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for v in sorted(range(n_slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        load, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (load + slot_bytes.get(v, 0), s))
    return out


def edit_map(slot_map: dict[int, int], slot_bytes: dict[int, int], n_shards: int,
             tolerance: float = 0.02) -> dict[int, int]:
    """Next version of a map: move as few slots as it takes until every shard is within
    ``tolerance`` of the mean (or no single move helps). Shards that no longer exist
    lose all their slots; new shards start empty and fill up."""
    out, load = {}, dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in load}
    homeless = []
    for v, s in slot_map.items():
        b = slot_bytes.get(v, 0)
        if s in load:
            out[v] = s
            load[s] += b
            held[s].append((b, v))
        else:
            homeless.append((b, v))

    def put(b: int, v: int) -> int:
        s = min(load, key=lambda s: (load[s], s))
        out[v] = s
        load[s] += b
        held[s].append((b, v))
        return s

    for b, v in sorted(homeless, reverse=True):
        put(b, v)
    mean = sum(load.values()) / n_shards
    for _ in range(len(slot_map)):
        high, low = max(load, key=load.get), min(load, key=load.get)
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        gap = load[high] - load[low]
        movable = [x for x in held[high] if 0 < x[0] < gap]
        if not movable:
            break
        want = min(load[high] - mean, mean - load[low])
        b, v = min(movable, key=lambda x: (abs(x[0] - want), x[1]))
        held[high].remove((b, v))
        held[low].append((b, v))
        load[high] -= b
        load[low] += b
        out[v] = low
    return out


def store_map(spark: SparkSession, slot_map: dict[int, int], version: int, folder: str) -> str:
    """Write one version of the map; earlier versions stay readable."""
    path = f"{folder}/version={version}"
    rows = [(version, v, s) for v, s in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).drop("version").write.parquet(path)
    return path


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={version}")


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                  n_slots: int = N_SLOTS, map_folder: str | None = None) -> DataFrame:
    """Shard and gapless position for every record.

    One light pass writes (id, size, crc, slot); text is never shuffled. Positions are
    counted per (virtual slot, split) group, whose number grows with the rows, and
    shifted by the group's place in its shard, so no task ever holds a whole shard.
    """
    spark = docs.sparkSession
    light = save(docs.select(
        F.col(id_col).alias("doc_id"), record_size(F.col(text_col)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(F.col(id_col), F.col(text_col), n_slots).alias("vslot")), "shard-light")
    n_split = 1 + light.count() // (n_slots * ROWS_PER_GROUP)
    light = light.withColumn("split", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(n_split)).cast("int"))
    groups = save(light.groupBy("vslot", "split").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    sums = {r["vslot"]: r["bytes"] for r in groups.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}  # at most n_slots rows
    folder = map_folder or new_path(spark, "slot-map")
    store_map(spark, initial_map(sums, n_shards, n_slots), 1, folder)
    slot_map = load_map(spark, folder, 1)
    in_shard = Window.partitionBy("shard").orderBy("vslot", "split").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.join(F.broadcast(slot_map), "vslot").select(  # the map has n_slots rows
        "vslot", "split", "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("base"))
    in_group = Window.partitionBy("vslot", "split").orderBy("doc_id", "text_crc32")
    return (light.withColumn("at", F.row_number().over(in_group) - 1)
            .join(base, ["vslot", "split"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "vslot"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the records, one folder per shard. A third column deals each shard to several
    tasks, so a shard is several files and never one task. Ids must be unique here."""
    spread = F.pmod(F.xxhash64(id_col), F.lit(16))
    (docs.join(shards.select(F.col("doc_id").alias(id_col), "shard"), id_col)
     .repartition("shard", spread).write.partitionBy("shard").parquet(path))
