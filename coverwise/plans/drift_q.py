"""Drift queries: PSI by week, by event type, histogram, retrieval scores."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift, rank_sketch
from ..operators import qa
from ..operators import retrieval as rt
from ..sources import tables
from .catalog import query
from .retrieval_q import Ctx, sql_topk
from .qa_q import sql_rewrite
from .sqlkit import cte, statement

BINS = 10
# the reference window: the week starting on this Monday
REFERENCE_WEEK = datetime(2024, 1, 1)
_REF_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def sql_psi(name: str, ref: str, cur: str, by: list[str], period: list[str], bins: int = BINS) -> str:
    """Register a DuckDB PSI chain; the result CTE ``name`` has by, period, psi, severity, counts."""
    fr, idx = drift.quantile_plan(bins)
    frs = "[" + ", ".join(repr(f) for f in fr) + "]"
    cases = " ".join(
        f"WHEN {b} THEN [" + ", ".join(f"q[{i + 1}]" for i in ids) + "]" for b, ids in idx.items())
    byc = ", ".join(by)
    by_sel = f"{byc}, " if by else ""
    by_grp = f"GROUP BY {byc}" if by else ""
    same = "{0}.{2} IS NOT DISTINCT FROM {1}.{2}".format
    j_by = " AND ".join(same("x", "e", c) for c in by) or "TRUE"
    cte(f"{name}_edges", f"""
SELECT {by_sel}n_reference,
       list_sort(list_distinct(CASE greatest(2, least({bins}, n_reference // 5)) {cases} END)) AS edges
FROM (SELECT {by_sel}count(v) AS n_reference, quantile_cont(v, {frs}) AS q FROM {ref} {by_grp})""", ref)
    binx = "len(list_filter(list_slice(e.edges, 2, len(e.edges) - 1), lambda t: t <= x.v))"
    keys_c = by + period
    kc = ", ".join(f"x.{c}" for c in keys_c)
    kc_sel = f"{kc}, " if keys_c else ""
    cte(f"{name}_rh", f"""
SELECT {''.join(f'x.{c}, ' for c in by)}{binx} AS bin, count(*) AS n
FROM {ref} x JOIN {name}_edges e ON {j_by} WHERE x.v IS NOT NULL
GROUP BY ALL""", ref, f"{name}_edges")
    cte(f"{name}_ch", f"""
SELECT {kc_sel}{binx} AS bin, count(*) AS n
FROM {cur} x JOIN {name}_edges e ON {j_by} WHERE x.v IS NOT NULL
GROUP BY ALL""", cur, f"{name}_edges")
    t_keys = ", ".join(keys_c)
    j_rc = " AND ".join([same("rh", "t", c) for c in by] + ["rh.bin = t.bin"])
    j_cc = " AND ".join([same("ch", "t", c) for c in keys_c] + ["ch.bin = t.bin"])
    j_te = " AND ".join(same("t0", "e", c) for c in by) or "TRUE"
    cte(f"{name}_tot", f"""
SELECT {t_keys + ', ' if keys_c else ''}count(v) AS n_current FROM {cur} x {'GROUP BY ' + t_keys if keys_c else ''}""", cur)
    sel_keys = "".join(f"t.{c}, " for c in keys_c)
    grp = "".join(f"t.{c}, " for c in keys_c)
    cte(f"{name}_raw", f"""
SELECT {grp}t.n_reference, t.n_current, t.edges, sum(term) AS s
FROM (SELECT t.*, (greatest(coalesce(ch.n, 0) / t.n_current, 1e-4)
                   - greatest(coalesce(rh.n, 0) / t.n_reference, 1e-4))
                  * ln(greatest(coalesce(ch.n, 0) / t.n_current, 1e-4)
                       / greatest(coalesce(rh.n, 0) / t.n_reference, 1e-4)) AS term
      FROM (SELECT t0.*, coalesce(e.n_reference, 0) AS n_reference, e.edges,
                   unnest(range(0, greatest(coalesce(len(e.edges), 0) - 1, 1))) AS bin
            FROM {name}_tot t0 LEFT JOIN {name}_edges e ON {j_te}) t
      LEFT JOIN {name}_rh rh ON {j_rc}
      LEFT JOIN {name}_ch ch ON {j_cc}) t
GROUP BY {grp}t.n_reference, t.n_current, t.edges""",
        f"{name}_tot", f"{name}_edges", f"{name}_rh", f"{name}_ch")
    raw = ("CASE WHEN n_reference = 0 OR n_current = 0 OR edges IS NULL OR len(edges) < 2 "
           "THEN 0.0 ELSE s END")
    cte(name, f"""
SELECT {', '.join(keys_c) + ', ' if keys_c else ''}round_even({raw}, 4) AS psi,
       CASE WHEN {raw} < 0.10 THEN 'stable' WHEN {raw} < 0.25 THEN 'moderate'
            ELSE 'significant' END AS severity,
       n_reference, n_current
FROM {name}_raw""", f"{name}_raw")
    return name


cte("ev_weeks", "SELECT event_type, value AS v, date_trunc('week', ts) AS week_start FROM events")
cte("ev_ref", f"SELECT * FROM ev_weeks WHERE week_start = {_REF_SQL}", "ev_weeks")
cte("ev_cur", f"SELECT * FROM ev_weeks WHERE week_start > {_REF_SQL}", "ev_weeks")


def weeks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = tables.events(spark, sf_dir).select(
        "event_type", F.col("value").alias("v"), F.date_trunc("week", "ts").alias("week_start"))
    ref_ts = F.lit(REFERENCE_WEEK.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return e.where(F.col("week_start") == ref_ts), e.where(F.col("week_start") > ref_ts)


@query("psi_drift", statement(
    "SELECT psi, severity, n_reference, n_current FROM psi_all",
    sql_psi("psi_all", "ev_ref", "ev_cur", [], [])), ops=("M1", "M2"))
def q_psi_drift(spark, sf_dir):
    ref, cur = weeks(spark, sf_dir)
    return drift.psi(ref, cur, "v", bins=BINS)


@query("psi_weekly", statement(
    "SELECT week_start, psi, severity, n_reference, n_current FROM psi_wk",
    sql_psi("psi_wk", "ev_ref", "ev_cur", [], ["week_start"])), ops=("M3",))
def q_psi_weekly(spark, sf_dir):
    ref, cur = weeks(spark, sf_dir)
    return drift.psi(ref, cur, "v", period=["week_start"], bins=BINS)


@query("psi_by_event_type", statement(
    "SELECT event_type, week_start, psi, severity, n_reference, n_current FROM psi_et",
    sql_psi("psi_et", "ev_ref", "ev_cur", ["event_type"], ["week_start"])), ops=("M3",))
def q_psi_by_type(spark, sf_dir):
    ref, cur = weeks(spark, sf_dir)
    return drift.psi(ref, cur, "v", by=["event_type"], period=["week_start"], bins=BINS)


# reference per user: the first day only, so many users of later weeks have no reference
cte("us_ref", """
SELECT user_id, value AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01'""")
cte("us_cur", f"""
SELECT user_id, value AS v, date_trunc('week', ts) AS week_start FROM events
WHERE date_trunc('week', ts) > {_REF_SQL}""")


@query("psi_by_user", statement(
    "SELECT user_id, week_start, psi, severity, n_reference, n_current FROM psi_us",
    sql_psi("psi_us", "us_ref", "us_cur", ["user_id"], ["week_start"])), ops=("M3",))
def q_psi_by_user(spark, sf_dir):
    e = tables.events(spark, sf_dir).select(
        "user_id", F.col("value").alias("v"), F.date_trunc("week", "ts").alias("week_start"),
        F.to_date("ts").alias("day"))
    ref_day = F.lit(REFERENCE_WEEK.date())
    ref_ts = F.lit(REFERENCE_WEEK.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return drift.psi(e.where(F.col("day") == ref_day), e.where(F.col("week_start") > ref_ts),
                     "v", by=["user_id"], period=["week_start"], bins=BINS)


@query("psi_histogram", statement("""
SELECT x.week_start, len(list_filter(list_slice(e.edges, 2, len(e.edges) - 1), lambda t: t <= x.v)) AS bin,
       count(*) AS n
FROM ev_weeks x JOIN psi_all_edges e ON TRUE GROUP BY ALL""", "ev_weeks", "psi_all_edges"),
    ops=("A6",))
def q_psi_histogram(spark, sf_dir):
    ref, _ = weeks(spark, sf_dir)
    e = tables.events(spark, sf_dir).select(F.col("value").alias("v"),
                                            F.date_trunc("week", "ts").alias("week_start"))
    edges = drift.reference_edges(ref, "v", [], BINS)
    return drift.histogram(e, edges, "v", ["week_start"], [])


# retrieval scores: rank-1 score of every question (reference) vs of its rewrite (current)
_ps0 = sql_topk("ps0", "q_src", 1, True)
cte("ps_q1", f"SELECT q_id, {sql_rewrite('question')} AS question FROM q_src", "q_src")
_ps1 = sql_topk("ps1", "ps_q1", 1, True)
cte("ps_ref", f"SELECT score AS v FROM {_ps0}", _ps0)
cte("ps_cur", f"SELECT score AS v FROM {_ps1}", _ps1)


@query("psi_retrieval_scores", statement(
    "SELECT psi, severity, n_reference, n_current FROM psi_rs",
    sql_psi("psi_rs", "ps_ref", "ps_cur", [], [])), ops=("M4",))
def q_psi_scores(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    qs = ctx.questions
    idx = ctx.index_reused
    s0 = rt.tfidf_topk(qs, idx, 1, pad=True).select(F.col("score").alias("v"))
    q1 = qs.select("q_id", qa.rewrite(F.col("question")).alias("question"))
    s1 = rt.tfidf_topk(q1, idx, 1, pad=True).select(F.col("score").alias("v"))
    return drift.psi(s0, s1, "v", bins=BINS)


# sliding reference: every week against the four weeks before it, from daily sketches
REACH = 4
cte("sk_points", f"""
SELECT day, max(v) AS v, CAST(sum(c) AS BIGINT) AS w
FROM (SELECT day, v, c, sum(c) OVER (PARTITION BY day ORDER BY v) - c AS f, sum(c) OVER (PARTITION BY day) AS n
      FROM (SELECT CAST(ts AS DATE) AS day, CAST(value AS DOUBLE) AS v, count(*) AS c FROM events
            WHERE value IS NOT NULL GROUP BY ALL))
GROUP BY day, CAST(f * {rank_sketch.POINTS} AS BIGINT) // CAST(n AS BIGINT)""")
cte("sk_cur", "SELECT CAST(date_trunc('week', day) AS DATE) AS win, v, w FROM sk_points", "sk_points")
cte("sk_ref", f"SELECT CAST(win + 7 * i AS DATE) AS win, v, w FROM (SELECT *, CAST(unnest(range(1, {REACH + 1})) AS INTEGER) AS i FROM sk_cur)", "sk_cur")
cte("sk_cum", f"""
SELECT *, greatest(2, least({BINS}, n // 5)) AS b
FROM (SELECT win, v, CAST(sum(w) OVER (PARTITION BY win ORDER BY v) AS BIGINT) AS cum,
             CAST(sum(w) OVER (PARTITION BY win) AS BIGINT) AS n
      FROM (SELECT win, v, sum(w) AS w FROM sk_ref GROUP BY ALL))""", "sk_ref")
cte("sk_edges", f"""
SELECT win, any_value(n) AS n_reference, list_sort(list_distinct(list(edge))) AS edges
FROM (SELECT win, i, any_value(n) AS n, min(v) FILTER (WHERE cum > ((n - 1) * least(i, b)) // b) AS edge
      FROM sk_cum, range(0, {BINS + 1}) t(i) GROUP BY win, i)
GROUP BY win""", "sk_cum")
_sk_bin = "len(list_filter(list_slice(e.edges, 2, len(e.edges) - 1), lambda t: t <= x.v))"
cte("sk_hist", f"""
SELECT win, bin, sum(r) AS r, sum(c) AS c
FROM (SELECT win, {_sk_bin} AS bin, w AS r, 0 AS c FROM sk_ref x JOIN sk_edges e USING (win)
      UNION ALL SELECT win, {_sk_bin}, 0, w FROM sk_cur x JOIN sk_edges e USING (win))
GROUP BY ALL""", "sk_ref", "sk_cur", "sk_edges")
cte("sk_psi", """
SELECT t.win, t.n_current, coalesce(e.n_reference, 0) AS n_reference,
       CASE WHEN e.edges IS NULL OR len(e.edges) < 2 THEN 0.0 ELSE
         (SELECT sum((greatest(coalesce(h.c, 0) / t.n_current, 1e-4) - greatest(coalesce(h.r, 0) / e.n_reference, 1e-4))
                     * ln(greatest(coalesce(h.c, 0) / t.n_current, 1e-4) / greatest(coalesce(h.r, 0) / e.n_reference, 1e-4)))
          FROM sk_hist h WHERE h.win = t.win) END AS s
FROM (SELECT win, CAST(sum(w) AS BIGINT) AS n_current FROM sk_cur GROUP BY win) t LEFT JOIN sk_edges e ON e.win = t.win""",
    "sk_cur", "sk_edges", "sk_hist")


def daily_points(spark, sf_dir) -> DataFrame:
    e = tables.events(spark, sf_dir).select(F.col("value").alias("v"), F.to_date("ts").alias("day"))
    return rank_sketch.day_sketches(e, "v", ["day"])


@query("daily_rank_sketch", statement("SELECT day, v, w FROM sk_points", "sk_points"), ops=("M1", "T3"))
def q_daily_rank_sketch(spark, sf_dir):
    return daily_points(spark, sf_dir)


@query("psi_sliding", statement("""
SELECT win AS week_start, round_even(s, 4) AS psi,
       CASE WHEN s < 0.10 THEN 'stable' WHEN s < 0.25 THEN 'moderate' ELSE 'significant' END AS severity,
       n_reference, n_current FROM sk_psi""", "sk_psi"), ops=("M1", "M3", "T3"))
def q_psi_sliding(spark, sf_dir):
    p = daily_points(spark, sf_dir).withColumn("week", F.date_trunc("week", "day"))
    return rank_sketch.psi_sliding(p, "week", REACH, BINS).withColumnRenamed("window", "week_start")
