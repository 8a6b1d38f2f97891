"""Queries for sources, the medallion tables, DQ, semantic layer and governance."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as gov
from ..operators import medallion as med
from ..operators import semantic as sem
from ..operators.gold_buckets import GoldBuckets
from ..session import scratch_path
from ..sources import adapters as ad
from ..sources import sinks, tables
from ..sources.json_docs import bronze_from_json_documents
from .catalog import query
from .sqlkit import cte, statement

# -- oracle building blocks ------------------------------------------------------------

cte("raw_policy_feed", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS source_id,
       source AS source_system,
       'batch_' || CAST(doc_id % 7 AS VARCHAR) AS ingest_batch_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ingested_at,
       substring(text, 1, 60) AS raw_title,
       '  ' || upper(lang) || ' ' AS raw_category,
       CASE WHEN doc_id % 101 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN '   ' ELSE text END AS raw_body,
       n_chars AS meta_n_chars,
       CASE WHEN doc_id % 53 = 0 THEN NULL ELSE md5(text) END AS file_hash
FROM documents""")

cte("silver", """
SELECT md5(coalesce(file_hash, source_id)) AS policy_sk,
       source_id AS policy_id,
       trim(raw_title, ' ') AS title,
       lower(trim(raw_category, ' ')) AS category,
       trim(raw_body, ' ') AS body_text,
       ingest_batch_id,
       ingested_at,
       TIMESTAMP '2024-02-01 00:00:00' AS refined_at
FROM raw_policy_feed
WHERE raw_body IS NOT NULL AND length(trim(raw_body, ' ')) > 0
QUALIFY row_number() OVER (PARTITION BY coalesce(file_hash, source_id)
                           ORDER BY ingested_at DESC, ingest_batch_id DESC, source_id DESC) = 1""",
    "raw_policy_feed")

cte("gold", """
SELECT s.policy_id AS id, s.title, s.category, s.body_text AS text,
       CAST(s.ingested_at AS DATE) AS effective_date,
       coalesce(l.quality = 1, TRUE) AS is_active,
       s.policy_sk AS lineage_sk,
       s.ingested_at AS updated_at
FROM silver s LEFT JOIN labels l ON s.policy_id = 'doc-' || CAST(l.doc_id AS VARCHAR)""",
    "silver")

cte("search_corpus", """
SELECT id, title, category, text, CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS pos
FROM gold WHERE is_active""", "gold")

cte("raw_member_events", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
       sha256(CAST(user_id AS VARCHAR)) AS member_id_hash,
       CAST(json_extract(props, '$.k') AS INTEGER) AS payload_k,
       ts AS ingested_at
FROM events""")


# -- loaders shared by the Spark side --------------------------------------------------

def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.bronze_policy(spark, sf_dir)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return med.silver_benefit_policy(bronze(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return med.gold_member_kb(silver(spark, sf_dir), ad.active_flags(tables.labels(spark, sf_dir)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active gold rows with their corpus position."""
    return med.search_corpus(gold(spark, sf_dir)).withColumn("pos", ad.corpus_position("id"))


# -- sources -------------------------------------------------------------------------

@query("bronze_policy_feed", statement("SELECT * FROM raw_policy_feed", "raw_policy_feed"),
       ops=("S4",))
def q_bronze_policy_feed(spark, sf_dir):
    b = bronze(spark, sf_dir)
    return b.select("source_id", "source_system", "ingest_batch_id", "ingested_at", "raw_title",
                    "raw_category", "raw_body",
                    F.variant_get("raw_metadata", "$.n_chars", "bigint").alias("meta_n_chars"),
                    "file_hash")


@query("bronze_landed", statement("""
SELECT source_id, source_system, ingest_batch_id, ingested_at, raw_title, raw_category, md5(raw_body) AS body_md5,
       meta_n_chars, file_hash FROM raw_policy_feed""", "raw_policy_feed"), ops=("S4",))
def q_bronze_landed(spark, sf_dir):
    """All bronze columns appended to the landing table in two loads, the newest batch second, partitioned by
    batch, and read back."""
    path = scratch_path(spark, "bronze_landed", uuid.uuid4().hex)
    b = bronze(spark, sf_dir)
    b = b.withColumn("raw_metadata", F.to_json("raw_metadata"))  # a VARIANT column travels as its JSON text
    newest = b.agg(F.max("ingest_batch_id")).scalar()
    sinks.append_landing(b.where(F.col("ingest_batch_id") < newest), path)
    sinks.append_landing(b.where(F.col("ingest_batch_id") >= newest), path)
    back = spark.read.schema(b.schema).parquet(path)
    return back.select("source_id", "source_system", "ingest_batch_id", "ingested_at", "raw_title", "raw_category",
                       F.md5("raw_body").alias("body_md5"),
                       F.get_json_object("raw_metadata", "$.n_chars").cast("bigint").alias("meta_n_chars"), "file_hash")


@query("bronze_member_events", statement("SELECT * FROM raw_member_events", "raw_member_events"),
       ops=("S5",))
def q_bronze_member_events(spark, sf_dir):
    e = ad.bronze_events(spark, sf_dir)
    return e.select("event_id", "event_type", "member_id_hash",
                    F.variant_get("payload", "$.k", "int").alias("payload_k"), "ingested_at")


@query("member_fact_lookup", statement("""
SELECT e.event_id, e.member_id_hash, f.n_events, f.n_event_types, f.first_seen, f.last_seen
FROM raw_member_events e
LEFT JOIN (SELECT member_id_hash, count(*) AS n_events, count(DISTINCT event_type) AS n_event_types,
                  min(ingested_at) AS first_seen, max(ingested_at) AS last_seen
           FROM raw_member_events GROUP BY member_id_hash) f USING (member_id_hash)""",
    "raw_member_events"), ops=("C7",))
def q_member_fact_lookup(spark, sf_dir):
    e = ad.bronze_events(spark, sf_dir)
    facts = med.member_facts(e)
    return med.lookup_member_facts(e.select("event_id", "member_id_hash"), facts).select(
        "event_id", "member_id_hash", "n_events", "n_event_types", "first_seen", "last_seen")


@query("bronze_from_json", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS source_id, 'portfolio_json' AS source_system,
       'batch_001' AS ingest_batch_id, substring(text, 1, 60) AS raw_title, lang AS raw_category,
       text AS raw_body, md5(text) AS file_hash
FROM documents""", ops=("S3", "J2"))
def q_bronze_from_json(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    # one staged JSON object per document row, shaped like the reference's file
    staged = docs.select(F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("lang").alias("category"),
        F.col("text").alias("text"))).alias("documents"))).alias("json"))
    return bronze_from_json_documents(staged, "json", source_system="portfolio_json",
                                      ingest_batch_id="batch_001").select(
        "source_id", "source_system", "ingest_batch_id", "raw_title", "raw_category",
        "raw_body", "file_hash")


# -- silver / gold -----------------------------------------------------------------------

@query("silver_benefit_policy", statement("SELECT * FROM silver", "silver"),
       ops=("P1", "P2", "P3", "W1", "S6"))
def q_silver(spark, sf_dir):
    return silver(spark, sf_dir)


@query("silver_current", statement("SELECT * FROM silver", "silver"), ops=("S6",))
def q_silver_current(spark, sf_dir):
    """Full refresh: a version of the first loads, then of all, each published; a third is written but
    never published. Readers get the second."""
    base = scratch_path(spark, "silver_versions", uuid.uuid4().hex)
    first = med.silver_benefit_policy(bronze(spark, sf_dir).where("ingest_batch_id <> 'batch_6'"))
    rows = silver(spark, sf_dir).select(*first.columns)
    for version, part in (("1", first), ("2", rows)):
        sinks.publish(spark, base, sinks.write_version(part, base, version))
    sinks.write_version(first, base, "3")
    return sinks.read_current(spark, base)


@query("silver_rejects", statement("""
SELECT CASE WHEN raw_body IS NULL THEN 'null_body' ELSE 'blank_body' END AS reason,
       count(*) AS n_rows
FROM raw_policy_feed
WHERE raw_body IS NULL OR length(trim(raw_body, ' ')) = 0
GROUP BY 1""", "raw_policy_feed"), ops=("P3",))
def q_silver_rejects(spark, sf_dir):
    return med.silver_rejects(bronze(spark, sf_dir))


@query("gold_member_kb", statement("SELECT * FROM gold", "gold"), ops=("S7", "P4"))
def q_gold(spark, sf_dir):
    return gold(spark, sf_dir)


@query("lineage_trace", statement("""
SELECT g.id, g.lineage_sk, b.source_system, s.ingest_batch_id, s.ingested_at,
       b.file_hash IS NOT NULL AS has_file_hash
FROM gold g
JOIN silver s ON g.lineage_sk = s.policy_sk
JOIN raw_policy_feed b ON s.policy_id = b.source_id AND s.ingest_batch_id = b.ingest_batch_id
                      AND s.ingested_at = b.ingested_at""", "gold", "raw_policy_feed"),
       ops=("J5", "P4"))
def q_lineage_trace(spark, sf_dir):
    b = bronze(spark, sf_dir)
    s = med.silver_benefit_policy(b)
    g = med.gold_member_kb(s, ad.active_flags(tables.labels(spark, sf_dir)))
    return med.lineage_trace(g, s, b)


@query("lineage_dropped", statement("""
SELECT b.source_id,
       CASE WHEN b.raw_body IS NOT NULL AND length(trim(b.raw_body, ' ')) > 0
            THEN 'superseded' ELSE 'empty_body' END AS reason
FROM raw_policy_feed b
WHERE NOT EXISTS (SELECT 1 FROM silver s WHERE s.policy_id = b.source_id
                  AND s.ingest_batch_id = b.ingest_batch_id AND s.ingested_at = b.ingested_at)""",
    "raw_policy_feed", "silver"), ops=("J5",))
def q_lineage_dropped(spark, sf_dir):
    b = bronze(spark, sf_dir)
    return med.lineage_dropped(b, med.silver_benefit_policy(b))


@query("lineage_orphans", statement("""
SELECT id, lineage_sk FROM gold
WHERE lineage_sk NOT IN (SELECT policy_sk FROM silver)""", "gold"), ops=("J5",))
def q_lineage_orphans(spark, sf_dir):
    b = bronze(spark, sf_dir)
    s = med.silver_benefit_policy(b)
    return med.lineage_orphans(med.gold_member_kb(s, ad.active_flags(tables.labels(spark, sf_dir))), s)


# -- data quality ----------------------------------------------------------------------------

@query("dq_null_bodies", statement(
    "SELECT count(*) FILTER (WHERE body_text IS NULL) AS null_bodies FROM silver", "silver"),
    ops=("A1",))
def q_dq_null_bodies(spark, sf_dir):
    return med.dq_null_count(silver(spark, sf_dir), "body_text", "null_bodies")


@query("dq_duplicate_policy_id", statement("""
SELECT policy_id, count(*) AS n_rows FROM silver GROUP BY policy_id HAVING count(*) > 1""",
    "silver"), ops=("A2",))
def q_dq_dup_policy(spark, sf_dir):
    return med.dq_duplicate_keys(silver(spark, sf_dir), ["policy_id"])


@query("dq_duplicate_bronze_hash", statement("""
SELECT file_hash, count(*) AS n_rows FROM raw_policy_feed
WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1""", "raw_policy_feed"),
    ops=("A2",))
def q_dq_dup_hash(spark, sf_dir):
    b = bronze(spark, sf_dir).where(F.col("file_hash").isNotNull())
    return med.dq_duplicate_keys(b, ["file_hash"])


@query("dq_not_null_quarantine", statement("""
SELECT source_id,
       concat_ws(',', CASE WHEN raw_title IS NULL THEN 'raw_title_is_null' END,
                      CASE WHEN raw_category IS NULL THEN 'raw_category_is_null' END,
                      CASE WHEN raw_body IS NULL THEN 'raw_body_is_null' END) AS dq_reasons
FROM raw_policy_feed
WHERE raw_title IS NULL OR raw_category IS NULL OR raw_body IS NULL""", "raw_policy_feed"),
    ops=("A3",))
def q_dq_not_null(spark, sf_dir):
    _, quarantine = med.dq_not_null(bronze(spark, sf_dir).drop("raw_metadata"),
                                    ["raw_title", "raw_category", "raw_body"])
    return quarantine.select("source_id", "dq_reasons")


@query("dq_pk_violations", statement("""
SELECT id, count(*) AS n_rows FROM gold GROUP BY id HAVING count(*) > 1""", "gold"),
    ops=("A4",))
def q_dq_pk(spark, sf_dir):
    return med.dq_duplicate_keys(gold(spark, sf_dir), ["id"])


# -- views, search corpus ----------------------------------------------------------------------

@query("v_member_kb_current", statement("""
SELECT id, title, category, effective_date, is_active FROM gold
WHERE effective_date <= CAST(TIMESTAMP '2024-02-01 00:00:00' AS DATE)""", "gold"),
    ops=("P5", "P7"))
def q_v_member_kb(spark, sf_dir):
    return med.current_kb_view(gold(spark, sf_dir))


@query("search_corpus", statement("SELECT id, title, category, text FROM search_corpus",
                                  "search_corpus"), ops=("P6",))
def q_search_corpus(spark, sf_dir):
    return med.search_corpus(gold(spark, sf_dir))


# -- semantic layer ------------------------------------------------------------------------

def _orders_model(spark, sf_dir):
    orders = tables.read_table(spark, sf_dir, "orders")
    customer = tables.read_table(spark, sf_dir, "customer")
    return sem.orders_model(orders, customer)


@query("semantic_orders", """
SELECT c.c_mktsegment AS market_segment, o.o_orderpriority AS order_priority,
       sum(o.o_totalprice) AS revenue, count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F'
GROUP BY 1, 2""", ops=("V1",))
def q_semantic_orders(spark, sf_dir):
    m = _orders_model(spark, sf_dir)
    return sem.semantic_query(m, ["market_segment", "order_priority"],
                              aggregates={"revenue": "sum(total_price)", "n_orders": "count(*)"},
                              filters=[F.col("o_orderstatus") == "F"])


@query("semantic_synonym_query", """
SELECT c.c_mktsegment AS market_segment, max(o.o_totalprice) AS max_price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1""", ops=("V2",))
def q_semantic_synonyms(spark, sf_dir):
    m = _orders_model(spark, sf_dir)
    return sem.semantic_query(m, ["Segment"], aggregates={"max_price": "max(total_price)"})


@query("semantic_orders_rows", """
SELECT o.o_orderpriority AS order_priority, o.o_orderstatus AS order_status,
       o.o_totalprice AS total_price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'BUILDING'""", ops=("V1",))
def q_semantic_rows(spark, sf_dir):
    m = _orders_model(spark, sf_dir)
    return sem.semantic_query(m, ["priority", "status"], facts=["total_price"],
                              filters=[F.col("c_mktsegment") == "BUILDING"])


# -- governance ------------------------------------------------------------------------------

def _masked(spark, sf_dir, role):
    e = ad.bronze_events(spark, sf_dir).select("event_id", "event_type", "member_id_hash")
    return gov.apply_masks(e, {"member_id_hash": gov.MEMBER_HASH_MASK}, role)


@query("masked_events_agent", statement(
    "SELECT event_id, event_type, '***' AS member_id_hash FROM raw_member_events",
    "raw_member_events"), ops=("G1",))
def q_masked_agent(spark, sf_dir):
    return _masked(spark, sf_dir, gov.AGENT_ROLE)


@query("masked_events_analyst", statement(
    "SELECT event_id, event_type, member_id_hash FROM raw_member_events", "raw_member_events"),
    ops=("G1",))
def q_masked_analyst(spark, sf_dir):
    return _masked(spark, sf_dir, gov.ANALYST_ROLE)


@query("row_policy_agent", statement("SELECT id, is_active FROM gold WHERE is_active = TRUE", "gold"),
       ops=("G2",))
def q_row_policy_agent(spark, sf_dir):
    return gov.apply_row_policy(gold(spark, sf_dir), gov.ACTIVE_KB_ONLY, gov.AGENT_ROLE).select(
        "id", "is_active")


@query("row_policy_admin", statement("SELECT id, is_active FROM gold", "gold"), ops=("G2",))
def q_row_policy_admin(spark, sf_dir):
    return gov.apply_row_policy(gold(spark, sf_dir), gov.ACTIVE_KB_ONLY, gov.ADMIN_ROLE).select(
        "id", "is_active")


# -- incremental merge (C1) -----------------------------------------------------------------
# Two loads, cut from the data: the first covers every row landed up to the middle of the
# landing period and ran before any label was known (every policy active); the second covers
# every row, with labels, and ran at the last landing time.

cte("load_times", """
SELECT (CAST(epoch(min(ingested_at)) AS BIGINT) + CAST(epoch(max(ingested_at)) AS BIGINT)) // 2 AS cut_s,
       max(ingested_at) AS load_at
FROM raw_policy_feed""", "raw_policy_feed")
# the first load from its definition: a present body that no other present body of the same
# file, landed in time, comes after
cte("raw_prev", """
SELECT coalesce(file_hash, source_id) AS k, raw_policy_feed.* FROM raw_policy_feed, load_times
WHERE epoch(ingested_at) <= cut_s AND trim(coalesce(raw_body, ''), ' ') <> ''""",
    "raw_policy_feed", "load_times")
cte("gold_prev", """
SELECT r.source_id AS id, trim(r.raw_title, ' ') AS title, lower(trim(r.raw_category, ' ')) AS category,
       trim(r.raw_body, ' ') AS text, TRUE AS is_active, md5(r.k) AS lineage_sk, r.ingested_at AS updated_at
FROM raw_prev r
WHERE NOT EXISTS (SELECT 1 FROM raw_prev o
                  WHERE o.k = r.k AND (o.ingested_at > r.ingested_at
                     OR (o.ingested_at = r.ingested_at AND (o.ingest_batch_id > r.ingest_batch_id
                         OR (o.ingest_batch_id = r.ingest_batch_id AND o.source_id > r.source_id)))))""",
    "raw_prev")
cte("gold_same", """
SELECT c.id FROM gold_prev c JOIN gold n ON c.id = n.id
 AND (c.title, c.category, c.text, c.lineage_sk, c.is_active)
     IS NOT DISTINCT FROM (n.title, n.category, n.text, n.lineage_sk, n.is_active)""", "gold_prev", "gold")
cte("gold_merge", """
SELECT id, CASE WHEN id NOT IN (SELECT id FROM gold_prev) THEN 'insert'
                WHEN id IN (SELECT id FROM gold_same) THEN 'unchanged' ELSE 'update' END AS change,
       is_active, updated_at
FROM gold
UNION ALL
SELECT id, 'deactivate' AS change, FALSE AS is_active, updated_at
FROM gold_prev WHERE id NOT IN (SELECT id FROM gold)""", "gold_prev", "gold", "gold_same")


def _snapshots(spark, sf_dir):
    """(first snapshot, second snapshot, time of the second load as a column)."""
    b = bronze(spark, sf_dir)
    seconds = F.unix_timestamp(F.col("ingested_at").cast("timestamp"))
    cut = b.select(F.floor((F.min(seconds) + F.max(seconds)) / 2).alias("cut_s"))
    load_at = b.select(F.max("ingested_at").alias("load_at"))
    labels = ad.active_flags(tables.labels(spark, sf_dir))
    first = med.gold_member_kb(med.silver_benefit_policy(b.where(seconds <= cut.scalar())),
                               labels.where(F.lit(False)))
    return first, med.gold_member_kb(med.silver_benefit_policy(b), labels), load_at.scalar()


@query("gold_merge", statement("SELECT * FROM gold_merge", "gold_merge"), ops=("C1",))
def q_gold_merge(spark, sf_dir):
    first, second, _ = _snapshots(spark, sf_dir)
    return med.merge_gold(first, second).select("id", "change", "is_active", "updated_at")


def _merged_buckets(spark, sf_dir):
    """The first load into an empty table, then the second one, which comes twice."""
    first, second, _ = _snapshots(spark, sf_dir)
    table = GoldBuckets(spark, scratch_path(spark, "gold_buckets", uuid.uuid4().hex), buckets=16)
    table.merge("1", first)
    table.merge("2", second)
    table.merge("2", second)
    return table


@query("gold_merge_buckets", statement("SELECT * FROM gold_merge", "gold_merge"), ops=("C1",))
def q_gold_merge_buckets(spark, sf_dir):
    table = _merged_buckets(spark, sf_dir)
    return table.read().join(table.changes("2"), "id", "left").select(
        "id", F.coalesce("change", F.lit("unchanged")).alias("change"), "is_active", "updated_at")


@query("gold_rewritten_rows", statement("""
SELECT change, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM gold_merge WHERE change <> 'unchanged' GROUP BY change""",
    "gold_merge"), ops=("C1",))
def q_gold_rewritten(spark, sf_dir):
    return _merged_buckets(spark, sf_dir).changes("2").groupBy("change").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


cte("gold_hist", """
WITH v AS (SELECT id, updated_at AS valid_from, is_active, lineage_sk FROM gold_prev
           UNION ALL
           SELECT id, CASE WHEN change = 'update' AND updated_at <= (SELECT p.updated_at FROM gold_prev p WHERE p.id = m.id)
                           THEN load_at ELSE updated_at END,
                  is_active, (SELECT g.lineage_sk FROM gold g WHERE g.id = m.id)
           FROM gold_merge m, load_times WHERE change IN ('insert', 'update')),
     e AS (SELECT v.*, (SELECT min(w.valid_from) FROM v w WHERE w.id = v.id AND w.valid_from > v.valid_from) AS next_from,
                  id IN (SELECT id FROM gold_merge WHERE change = 'deactivate') AS gone FROM v)
SELECT id, valid_from, CASE WHEN gone THEN load_at ELSE next_from END AS valid_to,
       NOT gone AND next_from IS NULL AS is_current, is_active, lineage_sk
FROM e, load_times""", "gold_prev", "gold", "gold_merge", "load_times")


def _gold_history(spark, sf_dir):
    first, second, load_at = _snapshots(spark, sf_dir)
    return med.scd2_merge(med.scd2_open(first), second, load_at).select(
        "id", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), "is_active", "lineage_sk")


@query("gold_scd2", statement("SELECT * FROM gold_hist", "gold_hist"), ops=("C1",))
def q_gold_scd2(spark, sf_dir):
    return _gold_history(spark, sf_dir)


@query("version_in_effect", statement("""
SELECT r.source_id, r.asked_at, h.valid_from, h.is_active, h.lineage_sk
FROM (SELECT source_id, ingested_at AS asked_at FROM raw_policy_feed
      UNION ALL SELECT source_id, load_at FROM raw_policy_feed, load_times) r
LEFT JOIN gold_hist h ON h.id = r.source_id AND h.valid_from <= r.asked_at
                     AND (h.valid_to IS NULL OR r.asked_at < h.valid_to)""",
    "raw_policy_feed", "load_times", "gold_hist"), ops=("C2",))
def q_version_in_effect(spark, sf_dir):
    # every landed row asks twice: for the version of its policy when it landed, and at the last load
    b = bronze(spark, sf_dir)
    last = b.select(F.max("ingested_at").alias("load_at")).scalar()
    asked = b.select(F.col("source_id").alias("id"), F.explode(F.array("ingested_at", last)).alias("asked_at"))
    out = med.version_in_effect(asked, _gold_history(spark, sf_dir), "id", "asked_at")
    return out.select(F.col("id").alias("source_id"), "asked_at", "valid_from", "is_active", "lineage_sk")


# -- JSON document source (S1, S2) -----------------------------------------------------------

@query("kb_category_counts", """
SELECT lang AS category, count(*) AS n_documents, sum(length(text)) AS n_chars
FROM documents GROUP BY lang""", ops=("S1",))
def q_kb_category_counts(spark, sf_dir):
    from ..sources.json_docs import read_documents
    path = scratch_path(spark, "kb_json", uuid.uuid4().hex)
    docs = tables.documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.substring("text", 1, 60).alias("title"), F.col("lang").alias("category"), "text")
    docs.write.mode("overwrite").json(path)          # one document per line: splittable
    kb = read_documents(spark, path, multiline=False)
    return kb.groupBy("category").agg(F.count(F.lit(1)).alias("n_documents"),
                                      F.sum(F.length("text")).alias("n_chars"))
