"""Distances between all pairs of nodes, with pairwise deletion of missing dates.

The result is the upper triangle: ``by, i, j, n_common, w``, i < j, w null where fewer than ``min_common`` dates are common or a value
has no variance. Each pair's sums are partially aggregated on the map side, so what is shuffled is pairs, not dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PANEL_VALUES = 4_000_000  #: values (nodes by dates) of a replica's panel that one group may hold


def pair_panel(panel: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, t, i, j, x, y``: the values of each pair of nodes on their common dates."""
    left = panel.select(*by, "t", F.col("node").alias("i"), F.col(value).alias("x"))
    right = panel.select(*by, "t", F.col("node").alias("j"), F.col(value).alias("y"))
    return left.join(right, [*by, "t"]).where("i < j")


def from_correlation(rho: Column, n: Column, min_common: int) -> Column:
    """sqrt(2(1 - rho)) with rho clipped to [-1, 1]; null below ``min_common``."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))
    return F.when((n >= min_common) & rho.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - clipped))))


def _pearson(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    sums = pairs.groupBy(*by, "i", "j").agg(F.count("*").alias("n_common"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return sums.withColumn("rho", F.try_divide(F.col("c"), F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0))))


def correlations(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, i, j, n_common, rho`` of all pairs."""
    return _pearson(pair_panel(returns, "r", by), by).select(*by, "i", "j", "n_common", "rho")


def mantegna(returns: DataFrame, min_common: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Distance from Pearson's correlation."""
    return correlations(returns, by).select(*by, "i", "j", "n_common", from_correlation(F.col("rho"), F.col("n_common"), min_common).alias("w"))


def spearman(returns: DataFrame, min_common: int, by: tuple[str, ...] = (), dates: int | None = None) -> DataFrame:
    """Distance from Spearman's correlation; ranks (ties share their mean) are taken within the common dates of each pair.

    ``dates``, if given, is the number of dates of every group of ``by``. Nodes with a value on all of them keep their dates in any pair of such nodes, so they
    are ranked once a group, not once a pair; only pairs with gaps are ranked by pair.
    """
    tied = lambda c, *keys: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    if dates is None:
        ranked = pair_panel(returns, "r", by).select(*by, "i", "j", tied("x", *by, "i", "j").alias("x"), tied("y", *by, "i", "j").alias("y"))
    else:
        whole = F.count("*").over(Window.partitionBy(*by, "node")) == dates
        marked = returns.select(*by, "t", "node", F.struct("r", tied("r", *by, "node").alias("rank"), whole.alias("whole")).alias("v"))
        pairs = pair_panel(marked, "v", by)
        both = F.col("x.whole") & F.col("y.whole")
        gaps = pairs.where(~both).select(*by, "i", "j", F.col("x.r").alias("x"), F.col("y.r").alias("y"))
        ranked = gaps.select(*by, "i", "j", tied("x", *by, "i", "j").alias("x"), tied("y", *by, "i", "j").alias("y"))
        ranked = ranked.unionByName(pairs.where(both).select(*by, "i", "j", F.col("x.rank").alias("x"), F.col("y.rank").alias("y")))
    return _pearson(ranked, by).select(*by, "i", "j", "n_common", from_correlation(F.col("rho"), F.col("n_common"), min_common).alias("w"))


def symbolic(symbols: DataFrame, min_common: int, ordinal: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Distance from the share of common dates with equal symbols, or from the mean step between symbols (``ordinal``)."""
    off = F.sum(F.abs(F.col("x") - F.col("y"))) / 2 if ordinal else F.count_if(F.col("x") != F.col("y"))
    sums = pair_panel(symbols, "symbol", by).groupBy(*by, "i", "j").agg(F.count("*").alias("n_common"), off.alias("off"))
    return sums.select(*by, "i", "j", "n_common", F.when(F.col("n_common") >= min_common, F.sqrt(F.col("off") / F.col("n_common"))).alias("w"))


def replica_distances(panel: DataFrame, method: str, min_common: int, n_values: int) -> DataFrame:
    """``rep, i, j, n_common, w`` of replica panels ``rep, t, node`` and ``r`` (mantegna, spearman) or ``symbol`` (symbolic).

    A replica is a group of its own, in which the sums over common dates are products of the compact panel with itself, so only its values are shuffled, not those of every pair. That holds
    for panels of ``n_values`` up to ``PANEL_VALUES``; larger ones go by the joins above and give the same.
    """
    by = ("rep",)
    if n_values > PANEL_VALUES:
        return symbolic(panel, min_common, by=by) if method == "symbolic" else (mantegna if method == "mantegna" else spearman)(panel, min_common, by)
    value = "symbol" if method == "symbolic" else "r"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="t", columns="node", values=value)
        n, off = _compact(wide.to_numpy(float), method)
        i, j = np.triu_indices(wide.shape[1], 1)
        seen = n[i, j] > 0
        i, j = i[seen], j[seen]
        names, common = wide.columns.to_numpy(), n[i, j].astype(int)
        w = np.where(common >= min_common, off[i, j], np.nan)
        return pd.DataFrame({"rep": rows["rep"].iloc[0], "i": names[i], "j": names[j], "n_common": common, "w": w})

    found = panel.select("rep", "t", "node", value).groupBy("rep").applyInPandas(run, "rep int, i string, j string, n_common bigint, w double")
    return found.withColumn("w", F.nanvl("w", F.lit(None).cast("double")))


def _compact(x: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Common dates and distances (NaN without variance) of all pairs of columns of a panel with gaps (NaN)."""
    have = ~np.isnan(x)
    m = have.astype(float)
    n = m.T @ m
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "symbolic":
            same = sum((x == s).astype(float).T @ (x == s).astype(float) for s in np.unique(x[have]))
            return n, np.sqrt((n - same) / n)
        if method == "spearman":
            rho = _ranked(x, have)
        else:
            centred = np.where(have, x - np.nanmean(np.where(have, x, np.nan), axis=0), 0.0) if have.any() else np.zeros_like(x)
            rho = _moments(n, centred.T @ m, (centred**2).T @ m, centred.T @ centred)
        return n, np.sqrt(np.maximum(0, 2 * (1 - np.clip(rho, -1, 1))))


def _moments(n: np.ndarray, s: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Correlations from the sums over common dates: of each column beside another, of its squares, and of products."""
    v = q / n - (s / n) ** 2
    v = np.where(v > 1e-12 * q / n, v, 0.0)
    scale = np.sqrt(v * v.T)
    return np.where(scale > 0, (p / n - s * s.T / n**2) / scale, np.nan)


def _ranked(x: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Rank correlations: columns without gaps are ranked once, others anew for each pair."""
    k = x.shape[1]
    rho = np.full((k, k), np.nan)
    whole = np.flatnonzero(have.all(axis=0))
    if len(whole):
        r = pd.DataFrame(x[:, whole]).rank().to_numpy()
        r = r - r.mean(axis=0)
        scale = np.sqrt((r**2).sum(axis=0))
        scale = np.where(scale > 0, scale, np.nan)
        rho[np.ix_(whole, whole)] = (r.T @ r) / np.outer(scale, scale)
    gaps = np.ones((k, k), bool)
    gaps[np.ix_(whole, whole)] = False
    for a, b in zip(*np.nonzero(np.triu(gaps, 1)), strict=True):
        both = have[:, a] & have[:, b]
        if both.any():
            ra, rb = (pd.Series(x[both, c]).rank().to_numpy() for c in (a, b))
            ra, rb = ra - ra.mean(), rb - rb.mean()
            scale = np.sqrt((ra @ ra) * (rb @ rb))
            rho[a, b] = rho[b, a] = ra @ rb / scale if scale > 0 else np.nan
    return rho
