"""Symbols: each return as one of three quantile regimes of its node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholds(returns: DataFrame, quantiles: tuple[float, float], least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node, a, b``: interpolated quantiles of the returns of nodes with at least ``least`` of them."""
    rows = returns.groupBy(*by, "node").agg(F.count("r").alias("n"), F.percentile("r", F.array(*map(F.lit, quantiles))).alias("q"))
    return rows.where(F.col("n") >= least).select(*by, "node", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))


def symbolize(returns: DataFrame, limits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Returns with ``symbol``: 1 below a, 2 from a to b, 3 above b; nodes without thresholds drop out."""
    symbol = F.when(F.col("r") < F.col("a"), 1).when(F.col("r") <= F.col("b"), 2).otherwise(3)
    return returns.join(limits, [*by, "node"]).withColumn("symbol", symbol).drop("a", "b")
