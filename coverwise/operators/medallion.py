"""Bronze -> silver -> gold refinement, lineage and data-quality checks.

All functions take and return DataFrames; nothing is executed here.

Scale notes
-----------
* Latest-wins dedupe is ``row_number() == 1`` over the dedupe key. Catalyst
  turns this into a *partial* ``WindowGroupLimit`` before the shuffle, so each
  map task forwards at most one row per key: a key that holds a third of all
  rows costs one row per map task on the wire, not a third of the table in one
  reducer.
* Gold adds the active flag with a left join to a small label table; AQE turns
  it into a broadcast join when the label side is measured small, otherwise it
  stays a sort-merge join (no unchecked broadcast).
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import as_of_col


def _strip_spaces(c: Column) -> Column:
    # Warehouse TRIM strips blanks only; Spark's trim does the same.
    return F.trim(c)


def body_is_present(col: str = "raw_body") -> Column:
    return F.col(col).isNotNull() & (F.length(_strip_spaces(F.col(col))) > 0)


def dedupe_key_col(dedupe_key: str = "file_hash") -> Column:
    if dedupe_key == "file_hash":
        return F.coalesce(F.col("file_hash"), F.col("source_id"))
    if dedupe_key == "source_id":
        return F.col("source_id")
    raise ValueError(f"unknown dedupe key {dedupe_key!r}")


def latest_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Keep one row per key: the first under ``order`` (QUALIFY row_number()=1)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def silver_benefit_policy(bronze: DataFrame, as_of: datetime | None = None,
                          dedupe_key: str = "file_hash") -> DataFrame:
    """silver.benefit_policy: clean, conform, drop empty bodies, latest ingest wins.

    Ties on ``ingested_at`` are broken by ``ingest_batch_id`` then ``source_id``
    (both descending) so the result is deterministic.
    """
    key = dedupe_key_col(dedupe_key)
    kept = bronze.where(body_is_present("raw_body")).select(
        F.md5(key).alias("policy_sk"),
        F.col("source_id").alias("policy_id"),
        _strip_spaces(F.col("raw_title")).alias("title"),
        F.lower(_strip_spaces(F.col("raw_category"))).alias("category"),
        _strip_spaces(F.col("raw_body")).alias("body_text"),
        "ingest_batch_id",
        "ingested_at",
        as_of_col(as_of).alias("refined_at"),
    )
    # the md5 of the key is 1:1 with the key, so it partitions the same way
    return latest_wins(kept, F.col("policy_sk"),
                       [F.col("ingested_at").desc(), F.col("ingest_batch_id").desc(),
                        F.col("policy_id").desc()])


def silver_rejects(bronze: DataFrame) -> DataFrame:
    """Rows the silver filter drops, counted by reason (complement of P3)."""
    reason = (F.when(F.col("raw_body").isNull(), F.lit("null_body"))
               .when(F.length(_strip_spaces(F.col("raw_body"))) == 0, F.lit("blank_body")))
    return (bronze.select(reason.alias("reason")).where(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows")))


def gold_member_kb(silver: DataFrame, active: DataFrame | None = None,
                   as_of: datetime | None = None) -> DataFrame:
    """gold.member_kb from silver.

    ``active`` is an optional (label_policy_id, label_active) table; documents
    without a row there take the column default (active). ``effective_date``
    is the ingest date and ``updated_at`` the ingest time (FIXTURES section 3).
    """
    g = silver.select(
        F.col("policy_id").alias("id"),
        "title",
        "category",
        F.col("body_text").alias("text"),
        F.to_date("ingested_at").alias("effective_date"),
        F.col("policy_sk").alias("lineage_sk"),
        F.col("ingested_at").alias("updated_at"),
    )
    if active is None:
        return g.withColumn("is_active", F.lit(True)).select(*GOLD_COLUMNS)
    j = g.join(active, g["id"] == active["label_policy_id"], "left")
    return j.withColumn("is_active", F.coalesce(F.col("label_active"), F.lit(True))).select(*GOLD_COLUMNS)


GOLD_COLUMNS = ["id", "title", "category", "text", "effective_date", "is_active",
                "lineage_sk", "updated_at"]


def search_corpus(gold: DataFrame) -> DataFrame:
    """Active rows only, the columns the search index needs."""
    return gold.where(F.col("is_active")).select("id", "title", "category", "text")


def current_kb_view(gold: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Relational view with a fixed column list and an effective-date predicate."""
    return (gold.where(F.col("effective_date") <= F.to_date(as_of_col(as_of)))
            .select("id", "title", "category", "effective_date", "is_active"))


# -- lineage ---------------------------------------------------------------------

def lineage_trace(gold: DataFrame, silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """gold -> silver (lineage_sk = policy_sk) -> the bronze row that won."""
    s = silver.select("policy_sk", "policy_id", "ingest_batch_id", "ingested_at")
    b = bronze.select(F.col("source_id"), F.col("ingest_batch_id").alias("b_batch"),
                      F.col("ingested_at").alias("b_ingested_at"), "source_system",
                      F.col("file_hash").isNotNull().alias("has_file_hash"))
    gs = gold.select("id", "lineage_sk").join(s, F.col("lineage_sk") == F.col("policy_sk"))
    gsb = gs.join(b, (F.col("policy_id") == F.col("source_id"))
                  & (F.col("ingest_batch_id") == F.col("b_batch"))
                  & (F.col("ingested_at") == F.col("b_ingested_at")))
    return gsb.select("id", "lineage_sk", "source_system", "ingest_batch_id",
                      "ingested_at", "has_file_hash")


def lineage_dropped(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Bronze rows with no silver descendant and why (anti join on row identity)."""
    s = silver.select(F.col("policy_id").alias("s_id"), F.col("ingest_batch_id").alias("s_batch"),
                      F.col("ingested_at").alias("s_at"))
    dropped = bronze.join(s, (F.col("source_id") == F.col("s_id"))
                          & (F.col("ingest_batch_id") == F.col("s_batch"))
                          & (F.col("ingested_at") == F.col("s_at")), "left_anti")
    reason = F.when(body_is_present("raw_body"), F.lit("superseded")).otherwise(F.lit("empty_body"))
    return dropped.select("source_id", reason.alias("reason"))


def lineage_orphans(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Gold rows whose lineage key has no silver row (should be empty)."""
    return gold.join(silver.select("policy_sk"), gold["lineage_sk"] == F.col("policy_sk"),
                     "left_anti").select("id", "lineage_sk")


# -- data quality ------------------------------------------------------------------

def dq_null_count(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Null-count check as a one-row table (A1)."""
    return df.agg(F.count_if(F.col(column).isNull()).alias(alias or f"null_{column}"))


def dq_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their count (A2, A4)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def dq_not_null(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, quarantine) on NOT NULL columns (A3).

    The quarantine keeps every column plus ``dq_reasons``: the comma-separated
    list of failed checks, in the order given.
    """
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}_is_null")) for c in required]
    with_reasons = df.withColumn("dq_reasons", F.concat_ws(",", *checks))
    bad = F.col("dq_reasons") != ""
    return (with_reasons.where(~bad).drop("dq_reasons"), with_reasons.where(bad))


# -- incremental merge into gold (C1) --------------------------------------------------

def _matched(current: DataFrame, incoming: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    cur = current.select(*[F.col(c).alias(f"c_{c}") for c in [*GOLD_COLUMNS, *extra]])
    inc = incoming.select(*[F.col(c).alias(f"n_{c}") for c in GOLD_COLUMNS])
    return cur.join(inc, F.col("c_id") == F.col("n_id"), "full_outer")


def _changed() -> Column:
    same = F.lit(True)
    for c in ("title", "category", "text", "lineage_sk", "is_active"):
        same = same & F.col(f"c_{c}").eqNullSafe(F.col(f"n_{c}"))
    return ~same


def merge_gold(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """MERGE of a freshly built gold snapshot into the current gold table, by ``id``.

    A full outer join (one shuffle on id per side) classifies every id:
    ``insert`` (new id), ``update`` (content or lineage changed),
    ``deactivate`` (id no longer produced: kept, with is_active = false),
    ``unchanged``. Plain Parquet has no MERGE statement, so the result is
    written as a new table version by the caller.
    """
    j = _matched(current, incoming)
    change = (F.when(F.col("c_id").isNull(), F.lit("insert"))
               .when(F.col("n_id").isNull(),
                     F.when(F.col("c_is_active"), F.lit("deactivate")).otherwise(F.lit("unchanged")))
               .when(_changed(), F.lit("update"))
               .otherwise(F.lit("unchanged")))
    take_new = F.col("n_id").isNotNull()
    cols = [F.when(take_new, F.col(f"n_{c}")).otherwise(F.col(f"c_{c}")).alias(c) for c in GOLD_COLUMNS]
    out = j.select(*cols, change.alias("change"))
    return out.withColumn("is_active", F.when(F.col("change") == "deactivate", F.lit(False))
                          .otherwise(F.col("is_active")))


HISTORY_COLUMNS = [*GOLD_COLUMNS, "valid_from", "valid_to"]


def scd2_open(snapshot: DataFrame) -> DataFrame:
    """The history after a first load: every row valid since it was last updated, none closed."""
    return snapshot.select(*GOLD_COLUMNS, F.col("updated_at").alias("valid_from"),
                           F.lit(None).cast("timestamp_ntz").alias("valid_to"))


def scd2_merge(history: DataFrame, incoming: DataFrame, load_at: Column) -> DataFrame:
    """Apply one load to an SCD2 history (HISTORY_COLUMNS); at most one open version per id.

    Versions are half-open, ``[valid_from, valid_to)``; open ones have no
    ``valid_to``. An id whose content or active flag changed has its open
    version closed and a new one opened at the new row's ``updated_at`` (at
    ``load_at`` if the row itself is not newer, e.g. a flag that flipped). An id
    the load no longer produces is closed at ``load_at``. A new id opens at its
    ``updated_at``. Closed versions pass through; one full outer join by id of
    the open ones, so no key's history is gathered anywhere.
    """
    closed = history.where(F.col("valid_to").isNotNull()).select(*HISTORY_COLUMNS)
    j = _matched(history.where(F.col("valid_to").isNull()), incoming, ("valid_from",))
    known, produced = F.col("c_id").isNotNull(), F.col("n_id").isNotNull()
    update = known & produced & _changed()
    starts = (F.when(~known | (F.col("n_updated_at") > F.col("c_valid_from")), F.col("n_updated_at"))
              .otherwise(load_at))
    old_end = F.when(update, F.col("_starts")).when(~produced, F.col("_load_at"))
    old = F.struct(*[F.col(f"c_{c}").alias(c) for c in GOLD_COLUMNS], F.col("c_valid_from").alias("valid_from"),
                   old_end.cast("timestamp_ntz").alias("valid_to"))
    new = F.struct(*[F.col(f"n_{c}").alias(c) for c in GOLD_COLUMNS], F.col("_starts").alias("valid_from"),
                   F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    versions = F.array_compact(F.array(F.when(known, old), F.when(~known | update, new)))
    open_ = (j.withColumn("_load_at", load_at).withColumn("_starts", starts)
             .select(F.explode(versions).alias("_v")).select("_v.*"))
    return closed.unionByName(open_.select(*HISTORY_COLUMNS))


def member_facts(events: DataFrame, member_col: str = "member_id_hash", type_col: str = "event_type",
                 ts_col: str = "ingested_at") -> DataFrame:
    """Per hashed member: event count, distinct event types, first and last event time.

    Partial aggregation per member; distinct types are counted with a second
    partial aggregation over (member, type), never with an in-memory set per member.
    """
    per_type = events.groupBy(member_col, type_col).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"))
    return per_type.groupBy(member_col).agg(
        F.sum("_n").alias("n_events"), F.count(F.lit(1)).alias("n_event_types"),
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"))


def lookup_member_facts(requests: DataFrame, facts: DataFrame,
                        member_col: str = "member_id_hash") -> DataFrame:
    """Attach each request's member facts by the hashed member id (an equi-join).

    The facts side is one row per member and already partitioned by the hash
    after its aggregation; a member holding a third of all requests is a skewed
    key on the request side only, which AQE's skew join splits. Requests with no
    facts keep NULL facts (left join).
    """
    return requests.join(facts, member_col, "left")


def version_in_effect(requests: DataFrame, history: DataFrame, key: str, at: str,
                      valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """For each request (key, time), the version of that key in effect then.

    Range join on the key: ``valid_from <= at < coalesce(valid_to, +inf)``.
    The equality on ``key`` makes it a sort-merge (or, for a small history, a
    broadcast) join with the range as a join condition, so each request only
    meets the versions of its own key -- never a band join over all versions.
    Requests before the first version keep NULL version columns (left join).
    """
    h = history.withColumnRenamed(key, "_hkey")
    cond = ((requests[key] == h["_hkey"]) & (h[valid_from] <= requests[at])
            & (h[valid_to].isNull() | (requests[at] < h[valid_to])))
    return requests.join(h, cond, "left").drop("_hkey")
