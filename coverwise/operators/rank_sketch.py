"""Mergeable rank sketches per day, and drift against a reference window that slides.

A day's sketch is at most ``points`` rows (value, weight). The day's sorted rows are cut into
``points`` equal ranges of ranks; the distinct values whose *first* rank lies in a range become
one point at their largest value, weighing all their rows. Counting the weights at or below any
x then misses fewer than n / points of the day's n rows (the smaller values of one range; a tied
value is never split, however many rows hold it). Errors of days add up as their rows do: over
any set of days with N rows, a rank read from the union of their points is less than
N / points too small, and never too large. A day of at most ``points`` rows is exact.

Merging is a union, so windows of any days are formed on demand and the raw rows are read once,
when their day is sketched. ``drift.psi`` stays the exact way.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import drift

POINTS = 128


def day_sketches(df: DataFrame, value_col: str, keys: list[str], points: int = POINTS) -> DataFrame:
    """(keys..., v, w): the points of each key (a day, or a day of a group). NULL values are left out,
    a NULL key is a key; an empty table has no points."""
    ranked = drift.ranked_values(df, value_col, keys)
    groups = ranked.groupBy(*keys).agg((F.max("_end") - F.min("_first")).alias("_n"), F.min("_first").alias("_start"))
    cell = F.expr(f"((_first - _start) * {int(points)}) div _n")
    return (drift._attach(ranked, groups, keys, ["_n", "_start"])
            .groupBy(*keys, cell.alias("_cell")).agg(F.max("v").alias("v"), F.sum(F.col("_end") - F.col("_first")).alias("w"))
            .drop("_cell"))


def window_edges(points: DataFrame, window: str, bins: int = 10) -> DataFrame:
    """(window, n_reference, edges): reference edges of each window from the union of its points.

    Edge i of b is the first point whose summed weight passes rank (N - 1) * i div b, with
    b = max(2, min(bins, N div 5)) as in the exact form, which interpolates between two
    values instead. A window holds at most (days * points) rows."""
    order = Window.partitionBy(window).orderBy("v")
    p = points.groupBy(window, "v").agg(F.sum("w").alias("w")).select(
        window, "v", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
        F.sum("w").over(Window.partitionBy(window)).alias("_n"))
    p = p.withColumn("_b", F.greatest(F.lit(2), F.least(F.lit(bins), F.expr("_n div 5"))))
    at = [F.min(F.when(F.col("_cum") > F.expr(f"((_n - 1) * least({i}, _b)) div _b"), F.col("v"))) for i in range(bins + 1)]
    return p.groupBy(window).agg(F.max("_n").alias("n_reference"), F.array_distinct(F.array(*at)).alias("edges"))


def sliding_windows(points: DataFrame, period: str, reach: int) -> DataFrame:
    """(window, side, v, w): each point as current in its own period and as reference in the ``reach``
    periods after it, weeks being dates or timestamps. Periods without rows make no window."""
    later = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.struct(
        F.date_add(F.col(period).cast("date"), i * 7).alias("window"), F.lit("ref").alias("side")))
    own = F.array(F.struct(F.col(period).cast("date").alias("window"), F.lit("cur").alias("side")))
    return points.select(F.explode(F.concat(own, later)).alias("_x"), "v", "w").select("_x.*", "v", "w")


def psi_sliding(points: DataFrame, period: str, reach: int, bins: int = 10) -> DataFrame:
    """PSI of every week against the ``reach`` weeks before it, from sketches alone.

    ``points`` (period, v, w) may hold many sketches a week. Returns (window, psi, severity, n_reference, n_current) for each
    week with current values; one without any reference has n_reference 0 and PSI 0.0, "stable".
    Every share is within 1 / points on either side of its two edges of the exact share for the same edges."""
    from ..session import materialize
    sides = materialize(sliding_windows(points, period, reach), "sketch_windows")
    edges = window_edges(sides.where("side = 'ref'"), "window", bins)
    binned = sides.join(edges, "window", "left").withColumn("_bin", F.when(
        F.col("edges").isNull(), F.lit(0)).otherwise(drift.bin_of(F.col("v"), F.col("edges"))))
    # a constant number of conditional sums, so no list of bins is gathered
    sums = [F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("_bin") == i), F.col("w"))), F.lit(0)).alias(f"_{s}{i}")
            for s in ("ref", "cur") for i in range(bins)]
    n = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("w"))), F.lit(0)).alias(name)
         for s, name in (("ref", "n_reference"), ("cur", "n_current"))]
    rows = binned.groupBy("window").agg(*sums, *n, F.coalesce(F.size(F.first("edges")) - 1, F.lit(0)).alias("_m")) \
        .where("n_current > 0")

    def share(side, i, total):
        return F.greatest(F.col(f"_{side}{i}") / F.col(total), F.lit(drift.SHARE_FLOOR))

    raw = F.lit(0.0)
    for i in range(bins):
        c, r = share("cur", i, "n_current"), share("ref", i, "n_reference")
        raw = raw + F.when(F.col("_m") > i, (c - r) * F.log(c / r)).otherwise(F.lit(0.0))
    value = F.when((F.col("n_reference") == 0) | (F.col("_m") < 1), F.lit(0.0)).otherwise(raw)
    return rows.select("window", value.alias("_psi"), "n_reference", "n_current").select(
        "window", F.bround("_psi", 4).alias("psi"), drift.severity(F.col("_psi")).alias("severity"), "n_reference", "n_current")
