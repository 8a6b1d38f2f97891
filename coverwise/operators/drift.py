"""Population stability index over DataFrames.

Semantics (as in the reference): the effective bin count is
max(2, min(bins, n_ref div 5)); edges are the distinct linear-interpolated
quantiles of the *reference*; the outer edges are opened to ±inf; bins are
half-open [e_i, e_i+1); shares are floored at 1e-4 without renormalising;
PSI = Σ (cur - ref) · ln(cur / ref). An empty side or fewer than two distinct
edges gives 0 ("stable").

Plan shape: the reference quantiles are exact order statistics found
without gathering any group into one task (``exact_quantiles``): the reference
is range-sorted, every row gets its global rank from per-partition offsets,
and only the few ranks the quantiles need are fetched by an equi-join. Because
the bin count depends on the data, every quantile any bin count 2..bins can
need (a constant list) is computed and the edges are picked afterwards. Each row then gets
its bin by counting interior edges <= value (a projection), and both sides
are histogrammed with a partial ``count`` per (group, bin). A global
reference (no grouping keys) is attached as a scalar subquery, never by a
join; grouped references join on their keys (one small row per group,
broadcast by AQE only when measured small).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share floor and severity bands of the reference.
SHARE_FLOOR = 1e-4
MODERATE, SIGNIFICANT = 0.10, 0.25


def quantile_plan(bins: int) -> tuple[list[float], dict[int, list[int]]]:
    """All fractions i/b for b in 2..bins, and for each b the indices of its b+1 fractions."""
    fr: list[float] = []
    idx: dict[int, list[int]] = {}
    for b in range(2, bins + 1):
        idx[b] = []
        for i in range(b + 1):
            f = i / b
            if f not in fr:
                fr.append(f)
            idx[b].append(fr.index(f))
    return fr, idx


def severity(psi: Column) -> Column:
    return (F.when(psi < MODERATE, F.lit("stable"))
             .when(psi < SIGNIFICANT, F.lit("moderate"))
             .otherwise(F.lit("significant")))


def _attach(left: DataFrame, right: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Left join of per-group ``cols`` on ``by``, a NULL key being a group like any other.

    Without ``by`` the right side is one row, attached as a scalar subquery.
    """
    if not by:
        row = right.select(F.struct(*cols).alias("_s")).scalar()
        return left.withColumn("_s", row).select("*", *[F.col(f"_s.{c}") for c in cols]).drop("_s")
    r = right.select(*[F.col(c).alias(f"_by_{c}") for c in by], *cols)
    cond = [left[c].eqNullSafe(r[f"_by_{c}"]) for c in by]
    return left.join(r, cond, "left").drop(*[f"_by_{c}" for c in by])


def ranked_values(df: DataFrame, value_col: str, by: list[str]) -> DataFrame:
    """(by..., v, _first, _end): the distinct non-NULL values in order of (by, v), each with its
    range of ranks ``_first <= rank < _end`` over all rows; a group's ranks follow each other.

    Counted, range sorted and written once, so no group is gathered in one task.
    """
    from ..session import materialize
    x = df.select(*by, F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    srt = (x.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("_c")).orderBy(*by, "v")
           .withColumn("_mid", F.monotonically_increasing_id()))
    srt = materialize(srt.select(*by, "v", "_c", F.shiftright(F.col("_mid"), 33).alias("_part"), "_mid"),
                      "sorted")
    # one row per non-empty partition: its first global rank
    parts = srt.groupBy("_part").agg(F.sum("_c").alias("_pc"))
    offsets = parts.select("_part", (F.sum("_pc").over(Window.orderBy("_part")) - F.col("_pc")).alias("_off"))
    running = F.sum("_c").over(Window.partitionBy("_part").orderBy("_mid")
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return srt.withColumn("_run", running).join(offsets, "_part").select(
        *by, "v", (F.col("_off") + F.col("_run") - F.col("_c")).alias("_first"),
        (F.col("_off") + F.col("_run")).alias("_end"))


def exact_quantiles(df: DataFrame, value_col: str, by: list[str], fractions: list[float]) -> DataFrame:
    """(by..., n, q array<double>): exact linear-interpolated quantiles per group.

    For group size n and fraction f, position h = (n - 1) * f and the value is
    x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h) over the sorted group.
    Rows are first counted per distinct (group, value), so a value held by any
    share of the rows is one row from then on. The distinct values are range
    sorted (a group larger than a partition is split across several) and
    written once to the shared checkpoint folder; a value's rank range is its
    partition's offset plus the running count inside the partition, and the
    2 * len(fractions) ranks wanted per group are looked up in those ranges.
    """
    ranked = ranked_values(df, value_col, by)
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    groups = ranked.groupBy(*by).agg((F.max("_end") - F.min("_first")).alias("n"),
                                     F.min("_first").alias("_start"))
    need = groups.select(*by, "n", "_start", F.transform(
        fr, lambda f, i: F.struct(i.alias("i"), ((F.col("n") - 1).cast("double") * f).alias("h"))).alias("_want"))

    def holds(rank: Column) -> Column:
        r = F.col("_start") + rank.cast("long")
        return (r >= F.col("_first")) & (r < F.col("_end"))

    hit = _attach(ranked, need, by, ["n", "_start", "_want"]).withColumn(
        "_want", F.filter("_want", lambda w: holds(F.floor(w["h"])) | holds(F.ceil(w["h"]))))
    w = hit.withColumn("_w", F.explode("_want"))
    both = w.groupBy(*by, "n", F.col("_w.i").alias("_i")).agg(
        F.max("_w.h").alias("_h"),
        F.max(F.when(holds(F.floor("_w.h")), F.col("v"))).alias("_vlo"),
        F.max(F.when(holds(F.ceil("_w.h")), F.col("v"))).alias("_vhi"))
    q = both.select(*by, "n", "_i",
                    (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.floor("_h")))
                    .alias("_q"))
    return q.groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.struct("_i", "_q"))).alias("_qs")) \
        .select(*by, "n", F.transform("_qs", lambda e: e["_q"]).alias("q"))


def reference_edges(reference: DataFrame, value_col: str, by: list[str], bins: int = 10) -> DataFrame:
    """(by..., n_reference, edges): distinct reference quantile edges per group."""
    fr, idx = quantile_plan(bins)
    agg = exact_quantiles(reference, value_col, by, fr).select(
        *by, F.col("n").alias("n_reference"), F.col("q").alias("_q"))
    eff = F.greatest(F.lit(2), F.least(F.lit(bins), (F.col("n_reference") / 5).cast("long")))
    pick = None
    for b, ids in idx.items():
        arr = F.array(*[F.col("_q")[i] for i in ids])
        pick = F.when(eff == b, arr) if pick is None else pick.when(eff == b, arr)
    return agg.select(*by, "n_reference", F.array_distinct(pick).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin index of ``value``: number of interior edges <= value (outer edges are ±inf)."""
    interior = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(interior, lambda e: e <= value))


def _binned(df: DataFrame, edges: DataFrame, value_col: str, keys: list[str], by: list[str]) -> DataFrame:
    """(keys..., bin, n): NULL values are counted under a NULL bin; a group without edges has bin 0."""
    v = F.col(value_col)
    b = F.when(v.isNotNull(), F.when(F.col("edges").isNull(), F.lit(0)).otherwise(bin_of(v, F.col("edges"))))
    return (_attach(df, edges, by, ["edges"]).select(*keys, b.alias("bin"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, edges: DataFrame, value_col: str, keys: list[str],
              by: list[str]) -> DataFrame:
    """(keys..., bin, n) with bins from the reference ``edges`` of each ``by`` group."""
    return _binned(df, edges, value_col, keys, by).where(F.col("bin").isNotNull())


def _counts_map(hist: DataFrame, keys: list[str], name: str) -> DataFrame:
    # at most `bins` entries per group
    known = F.col("bin").isNotNull()
    return hist.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct("bin", "n")))).alias(name),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0).cast("long")).alias(f"{name}_total"))


def psi(reference: DataFrame, current: DataFrame, value_col: str, by: list[str] | None = None,
        period: list[str] | None = None, bins: int = 10) -> DataFrame:
    """PSI of ``current`` (grouped by ``by + period``) against ``reference`` (grouped by ``by``).

    Returns (by..., period..., psi, severity, n_reference, n_current): one row for
    every key of ``current``, also NULL ones. A key with no reference values
    (n_reference 0) or no current ones (n_current 0) has PSI 0.0, "stable".
    """
    by, period = by or [], period or []
    edges = reference_edges(reference, value_col, by, bins)
    ref_hist = _counts_map(_binned(reference, edges, value_col, by, by), by, "rc")
    cur_hist = _counts_map(_binned(current, edges, value_col, by + period, by), by + period, "cc")
    j = _attach(_attach(cur_hist, edges, by, ["n_reference", "edges"]), ref_hist, by, ["rc", "rc_total"])
    m = F.size("edges") - 1
    n_ref = F.coalesce(F.col("n_reference"), F.lit(0))
    n_cur = F.coalesce(F.col("cc_total"), F.lit(0))

    def share(counts: str, total: Column, i: Column) -> Column:
        c = F.coalesce(F.element_at(F.col(counts), i), F.lit(0))
        return F.greatest(c / total, F.lit(SHARE_FLOOR))

    terms = F.aggregate(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), F.lit(0.0),
                        lambda acc, i: acc + (share("cc", n_cur, i) - share("rc", n_ref, i))
                        * F.log(share("cc", n_cur, i) / share("rc", n_ref, i)))
    value = F.when((n_ref == 0) | (n_cur == 0) | F.col("edges").isNull() | (F.size("edges") < 2),
                   F.lit(0.0)).otherwise(terms)
    return j.select(*by, *period, value.alias("psi_raw"), n_ref.alias("n_reference"),
                    n_cur.alias("n_current")).select(
        *by, *period, F.bround("psi_raw", 4).alias("psi"), severity(F.col("psi_raw")).alias("severity"),
        "n_reference", "n_current")
