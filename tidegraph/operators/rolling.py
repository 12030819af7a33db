"""Rolling windows over the calendar: distances, trees, hubs and their series for every window end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.distance import from_correlation, pair_panel, spearman, symbolic
from tidegraph.operators.graph import betweenness, branches, degrees, finite, hubs, spanning_trees, tree_metrics
from tidegraph.operators.symbols import symbolize, thresholds
from tidegraph.plans.runtime import cut_lineage


def window_ends(returns: DataFrame, window: int) -> DataFrame:
    """``t_end, date``: every date from the ``window``-th on. One row a date."""
    return returns.groupBy("t").agg(F.first("date").alias("date")).where(F.col("t") >= window - 1).select(F.col("t").alias("t_end"), "date")


def _window_sums(pairs: DataFrame, sums: dict[str, Column], window: int, last: DataFrame) -> DataFrame:
    """Sums of each pair over every window: running sums on the full calendar, less those of ``window`` dates before.

    A pair's rows are made dense over the calendar first, so a window is a fixed number of rows back and each step costs the same however wide the window.
    """
    have = pairs.groupBy("i", "j", "t").agg(*(F.sum(e).alias(k) for k, e in sums.items()), F.count("*").alias("n"))
    grid = pairs.select("i", "j").distinct().join(F.broadcast(last)).select("i", "j", F.explode(F.sequence(F.lit(0), F.col("last_t"))).alias("t"))  # one row
    w = Window.partitionBy("i", "j").orderBy("t")
    dense = grid.join(have, ["i", "j", "t"], "left")
    running = dense.select("i", "j", "t", *(F.sum(F.coalesce(c, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in (*sums, "n")))
    cut = running.select("i", "j", F.col("t").alias("t_end"), *((F.col(c) - F.coalesce(F.lag(c, window).over(w), F.lit(0))).alias(c) for c in (*sums, "n")))
    return cut.where(F.col("t_end") >= window - 1)


def rolling_mantegna(returns: DataFrame, window: int, min_common: int) -> DataFrame:
    """``t_end, i, j, n_common, w`` of every window; values are centred by pair first, so the sums don't cancel."""
    pairs = pair_panel(returns, "r")
    w = Window.partitionBy("i", "j")
    centred = pairs.select("i", "j", "t", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    s = _window_sums(centred, {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}, window, returns.agg(F.max("t").alias("last_t")))
    s = s.where(n > 0)
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    rho = F.when((vx > 1e-15) & (vy > 1e-15), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    return s.select("t_end", "i", "j", n.alias("n_common"), from_correlation(rho, n, min_common).alias("w"))


def rolling_symbolic(symbols: DataFrame, window: int, min_common: int) -> DataFrame:
    """The same from symbols with fixed thresholds."""
    pairs = pair_panel(symbols, "symbol")
    s = _window_sums(pairs, {"off": F.when(F.col("x") != F.col("y"), 1).otherwise(0)}, window, symbols.agg(F.max("t").alias("last_t")))
    n = F.col("n")
    return s.where(n > 0).select("t_end", "i", "j", n.alias("n_common"), F.when(n >= min_common, F.sqrt(F.col("off") / n)).alias("w"))


def window_rows(returns: DataFrame, window: int) -> DataFrame:
    """Returns with ``t_end`` of every window that holds them (each return ``window`` times), for statistics that need whole windows."""
    last = returns.agg(F.max("t").alias("last_t"))
    ends = F.sequence(F.greatest(F.col("t"), F.lit(window - 1)), F.least(F.col("t") + window - 1, F.col("last_t")))
    joined = returns.join(F.broadcast(last)).where(F.col("last_t") >= window - 1)  # one row
    return joined.select(F.explode(ends).alias("t_end"), "t", "node", "r")


def rolling_spearman(returns: DataFrame, window: int, min_common: int) -> DataFrame:
    """``t_end, i, j, n_common, w`` of every window by ranks, which hang on the whole window and can't be kept as running sums."""
    return spearman(window_rows(returns, window), min_common, ("t_end",), window)


def rolling_symbolic_inwindow(returns: DataFrame, window: int, quantiles: tuple[float, float], least: int, min_common: int) -> DataFrame:
    """``t_end, i, j, n_common, w`` of every window from symbols whose thresholds are taken anew in it; nodes with less than ``least`` returns in it drop out of it."""
    rows, by = window_rows(returns, window), ("t_end",)
    return symbolic(symbolize(rows, thresholds(rows, quantiles, least, by), by), min_common, by=by)


def _status(edges: DataFrame, trees: DataFrame, ends: DataFrame, universe: int, min_peers: int) -> DataFrame:
    """``t_end, date, status, mean_w`` of every window from its distances and its tree."""
    peers = finite(edges).select("t_end", F.explode(F.array("i", "j")).alias("node")).groupBy("t_end", "node").agg(F.count("*").alias("peers"))
    met = peers.groupBy("t_end").agg(F.count_if(F.col("peers") >= min_peers).alias("met"))
    grown = trees.groupBy("t_end").agg(F.count("*").alias("n_edges"), F.avg("w").alias("mean_w"))
    status = F.when(F.coalesce("met", F.lit(0)) < universe, "isolated").when(F.col("n_edges") != universe - 1, "disconnected").otherwise("ok")
    return ends.join(met, "t_end", "left").join(grown, "t_end", "left").select("t_end", "date", status.alias("status"), "mean_w")


def window_status(edges: DataFrame, ends: DataFrame, universe: int, min_peers: int) -> DataFrame:
    """``t_end, date, status``: ``ok``, ``isolated`` (a node with too few distances, or no edge at all) or ``disconnected``."""
    return _status(edges, spanning_trees(edges, ("t_end",)), ends, universe, min_peers).drop("mean_w")


def rolling_ntl(edges: DataFrame, ends: DataFrame, universe: int, min_peers: int) -> DataFrame:
    """``t_end, date, ntl, status`` of every window end, ``ntl`` (mean weight of the tree) null where the tree doesn't span the universe."""
    rows = _status(edges, spanning_trees(edges, ("t_end",)), ends, universe, min_peers)
    return rows.select("t_end", "date", F.when(F.col("status") == "ok", F.col("mean_w")).alias("ntl"), "status")


def valid_trees(edges: DataFrame, ends: DataFrame, universe: int, min_peers: int) -> DataFrame:
    """The trees of the windows whose status is ok, written once for what follows."""
    trees = cut_lineage(spanning_trees(edges, ("t_end",)))
    ok = _status(edges, trees, ends, universe, min_peers).where("status = 'ok'").select("t_end")
    return trees.join(ok, "t_end", "left_semi")


def rolling_topology(trees: DataFrame) -> DataFrame:
    """Tree metrics of every valid window."""
    return tree_metrics(trees, branches(trees, ("t_end",)), ("t_end",))


def hub_stability(trees: DataFrame) -> DataFrame:
    """``t_end, hub, hub_degree, tied, is_dominant``: the hub of every valid window; the dominant one is the most frequent, ties by name."""
    found = hubs(degrees(trees, ("t_end",)), betweenness(branches(trees, ("t_end",)), ("t_end",)), ("t_end",))
    counts = found.groupBy("hub").agg(F.count("*").alias("k"))
    best = counts.agg(F.min_by("hub", F.struct(-F.col("k"), F.col("hub"))).alias("best"))
    return found.join(F.broadcast(best)).select("t_end", "hub", "hub_degree", "tied", (F.col("hub") == F.col("best")).alias("is_dominant"))  # one row


def hub_summary(stability: DataFrame, top: int = 5) -> DataFrame:
    """``rank, hub, windows, pct``: the most frequent hubs."""
    counts = stability.groupBy("hub").agg(F.count("*").alias("windows"))
    w = Window.orderBy(F.desc("windows"), "hub")  # one row a hub
    ranked = counts.select(F.row_number().over(w).alias("rank"), "hub", "windows", (100 * F.col("windows") / F.sum("windows").over(Window.partitionBy())).alias("pct"))
    return ranked.where(F.col("rank") <= top)


def diagnostics(status: DataFrame) -> DataFrame:
    """Window counts by status."""
    return status.agg(
        F.count("*").alias("total_windows"), F.count_if(F.col("status") == "ok").alias("ok_windows"), F.count_if(F.col("status") != "ok").alias("null_windows"),
        F.count_if(F.col("status") == "isolated").alias("null_isolated"), F.count_if(F.col("status") == "disconnected").alias("null_disconnected"),
    )


def seasonality(series: DataFrame) -> DataFrame:
    """``cv_max``: the largest coefficient of variation of a calendar month's values; 0 if none. Below 0.2 there is no seasonality."""
    by_month = series.where(F.col("ntl").isNotNull()).groupBy(F.month("date").alias("month")).agg((F.stddev_samp("ntl") / F.avg("ntl")).alias("cv"))
    return by_month.agg(F.coalesce(F.max("cv"), F.lit(0.0)).alias("cv_max")).withColumn("seasonal", F.col("cv_max") >= 0.2)


def rolling_band(series: DataFrame, width: int, k: float) -> DataFrame:
    """``t_end, date, ntl, low, high``: mean and deviation of the last ``width`` valid values as a deterministic band, null while there are fewer."""
    w = Window.orderBy("t_end").rowsBetween(-(width - 1), 0)  # one row a date
    rows = series.where(F.col("ntl").isNotNull())
    full = F.count("*").over(w) == width
    mid, dev = F.avg("ntl").over(w), F.stddev_pop("ntl").over(w)
    return rows.select("t_end", "date", "ntl", F.when(full, mid - k * dev).alias("low"), F.when(full, mid + k * dev).alias("high"))


def episodes(banded: DataFrame) -> DataFrame:
    """``start_t, end_t, duration, direction, ntl_mean, magnitude_mean, magnitude_max`` of runs of values outside their band.

    Runs are of neighbours in the series without nulls; the direction is that of the first value, and a change of side doesn't end a run.
    """
    v, lo, hi = F.col("ntl"), F.col("low"), F.col("high")
    w = Window.orderBy("t_end").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    rows = banded.where(v.isNotNull()).withColumn("out", F.coalesce((v > hi) | (v < lo), F.lit(False))).withColumn("run", F.count_if(~F.col("out")).over(w)).where("out")
    size = F.when(v > hi, v - hi).otherwise(lo - v)
    return rows.groupBy("run").agg(
        F.min("t_end").alias("start_t"), F.max("t_end").alias("end_t"), F.count("*").alias("duration"),
        F.min_by(F.when(v > hi, "fragmentation").otherwise("integration"), "t_end").alias("direction"),
        F.avg(v).alias("ntl_mean"), F.avg(size).alias("magnitude_mean"), F.max(size).alias("magnitude_max"),
    ).drop("run")


def banded_series(series: DataFrame, band: DataFrame) -> DataFrame:
    """``Date, NTL, CI_low, CI_high``, as it is exported: the series (``t_end, date, ntl``) with its band (``t, low, high``); windows without a value are left out."""
    joined = series.where(F.col("ntl").isNotNull()).join(band.select(F.col("t").alias("t_end"), "low", "high"), "t_end", "left")
    return joined.select(F.col("date").cast("string").alias("Date"), F.col("ntl").alias("NTL"), F.col("low").alias("CI_low"), F.col("high").alias("CI_high"))
