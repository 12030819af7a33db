"""Panels: (date, node, price) rows, coverage, splicing, returns, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.sources.tables import valid_price


def clean_prices(prices: DataFrame) -> DataFrame:
    """``date, node, price``: valid prices only, one a cell (the smallest of several, so the choice doesn't hang on row order)."""
    return prices.where(valid_price(F.col("price")) & F.col("date").isNotNull() & F.col("node").isNotNull()).groupBy("date", "node").agg(F.min("price").alias("price"))


def calendar(panel: DataFrame) -> DataFrame:
    """``date, t``: the distinct dates numbered from 0. One row a date, so one task orders it."""
    return panel.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))


def adjusted_close(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``price``, the first of the adjusted closes in ``columns`` that is neither null nor NaN; null if none is. A raw close is never taken in their place."""
    return rows.withColumn("price", F.coalesce(*(F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns)))


def coverage(panel: DataFrame, threshold: float, sectors: DataFrame | None = None) -> DataFrame:
    """``node, coverage, sector, included, n_valid_days``: the share of all dates on which a node has a price."""
    total = panel.agg(F.countDistinct("date").alias("dates"))
    share = panel.groupBy("node").agg(F.countDistinct("date").alias("n")).join(F.broadcast(total))  # one row
    rows = share.select("node", (F.col("n") / F.col("dates")).alias("coverage"), F.col("n").alias("n_valid_days"))
    if sectors is None:
        rows = rows.withColumn("sector", F.lit("Other"))
    else:
        rows = rows.join(sectors.groupBy("node").agg(F.min("sector").alias("sector")), "node", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    return rows.select("node", "coverage", "sector", (F.col("coverage") >= threshold).alias("included"), "n_valid_days")


def filter_by_coverage(panel: DataFrame, threshold: float) -> DataFrame:
    """The rows of nodes with coverage of at least ``threshold``."""
    return panel.join(coverage(panel, threshold).where("included").select("node"), "node", "left_semi")


def splice(segments: DataFrame) -> DataFrame:
    """``date, node, price`` chained from ``node, seg_no, date, price``.

    An earlier segment is scaled so that its last price meets the first price of the next, from the last segment backwards; on a date
    in two segments the earlier one holds. A node with a segment without valid prices is left out whole.
    """
    ok = F.coalesce(valid_price(F.col("price")), F.lit(False))
    ends = segments.groupBy("node", "seg_no").agg(
        F.min_by(F.when(ok, F.col("price")), F.when(ok, F.col("date"))).alias("first"), F.max_by(F.when(ok, F.col("price")), F.when(ok, F.col("date"))).alias("last")
    )
    w = Window.partitionBy("node").orderBy("seg_no")
    step = ends.withColumn("ratio", F.lead("first").over(w) / F.col("last")).withColumn("whole", F.min(F.col("first").isNotNull()).over(Window.partitionBy("node")))
    after = Window.partitionBy("node").orderBy(F.desc("seg_no"))
    factors = step.where("whole").select("node", "seg_no", F.exp(F.sum(F.ln(F.coalesce("ratio", F.lit(1.0)))).over(after)).alias("factor"))
    scaled = segments.where(ok).join(factors, ["node", "seg_no"]).select("node", "date", "seg_no", (F.col("price") * F.col("factor")).alias("price"))
    return scaled.groupBy("node", "date").agg(F.min_by("price", "seg_no").alias("price")).select("date", "node", "price")


def transition_dates(segments: DataFrame) -> DataFrame:
    """``node, date``: the first date of every segment of a node but its first."""
    starts = segments.groupBy("node", "seg_no").agg(F.min("date").alias("date"))
    return starts.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("seg_no"))).where("k > 1").select("node", "date")


def drop_transitions(returns: DataFrame, transitions: DataFrame) -> DataFrame:
    """Returns without those of the transition dates."""
    return returns.join(transitions, ["node", "date"], "left_anti")


def log_returns(panel: DataFrame) -> DataFrame:
    """``date, t, node, r``: log returns between consecutive dates of the calendar of all nodes; a gap gives no return on either side of it.

    ``t`` numbers the dates with a return of any node from 0.
    """
    timed = panel.join(calendar(panel), "date")
    w = Window.partitionBy("node").orderBy("t")
    moved = timed.select("date", "t", "node", (F.ln("price") - F.lag(F.ln("price")).over(w)).alias("r"), (F.col("t") - F.lag("t").over(w)).alias("step")).where("step = 1")
    kept = moved.select("date", "node", "r")
    return kept.join(calendar(kept), "date").select("date", "t", "node", "r")


def descriptive_stats(returns: DataFrame, least: int = 30) -> DataFrame:
    """Count, mean, deviation, bias-corrected skewness and excess kurtosis and the Jarque-Bera test of nodes with at least ``least`` returns."""
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    m = returns.groupBy("node").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"), F.var_pop("r").alias("v"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2")
    )
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    rows = m.where((n >= least) & (F.col("v") > 0)).select(
        "node", "n", "mean_r", "std_r",
        (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        (((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("excess_kurtosis"),
        jb.alias("jb_stat"), F.exp(-jb / 2).alias("jb_pval"),
    )
    return rows.withColumn("normal_5pct", F.col("jb_pval") >= 0.05)
