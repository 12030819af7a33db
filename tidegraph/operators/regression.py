"""Matrix regression with node permutations.

Variables are columns of an edge list (``i, j, y, x1, ...``). A replica relabels the nodes; Spark joins the relabelled edges and sums up the cross products of each replica, and only these
few sums are solved in numpy, row by row of an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.resample import replicas


def grams(rows: DataFrame, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, gram``: the cross products of 1 and ``names``, row by row, summed over each group."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    return rows.groupBy(*map(F.col, by)).agg(F.array(*(F.sum(a * b) for a in cols for b in cols)).alias("gram"))


def solve(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients and t values (the constant first) and R² of the last variable on the others, from one matrix of cross products; NaN where singular."""
    k = len(gram) - 1
    a, b, yy, n = gram[:k, :k], gram[:k, k], gram[k, k], gram[0, 0]
    try:
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.full(k, np.nan), np.full(k, np.nan), np.nan
    beta = inverse @ b
    rss = max(0.0, float(yy - beta @ b))
    total = float(yy - gram[0, k] ** 2 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / np.sqrt(rss / (n - k) * np.diag(inverse))
    return beta, t, 1 - rss / total if total > 0 else np.nan


def coefficients(edges: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, t values and R² of ``y`` on ``xs`` over all edges."""
    row = grams(edges, [*xs, y]).first()
    k = len(xs) + 2
    return solve(np.array(row["gram"], float).reshape(k, k))


def vif(edges: DataFrame, x: str, others: list[str]) -> float:
    """1 / (1 - R²) of a predictor on the others; infinite from R² of 0.9999 on, 1 without others."""
    if not others:
        return 1.0
    r2 = coefficients(edges, x, others)[2]
    return float("inf") if r2 >= 0.9999 else 1 / (1 - r2)


def relabelled(edges: DataFrame, value: str, n: int, seed: int = 42) -> DataFrame:
    """``rep, i, j, value``: the matrix of ``value`` with its nodes permuted in each of ``n`` replicas."""
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("place", F.row_number().over(Window.orderBy("node")))  # one row a node
    many = replicas(nodes, n)
    drawn = many.select("rep", "node", F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", "node"), "node")).alias("place"))
    # the node at a place takes the matrix row of the node drawn for it
    table = many.select("rep", F.col("node").alias("to"), "place").join(drawn.withColumnRenamed("node", "from"), ["rep", "place"]).select("rep", "from", "to")
    a, b = table.select("rep", F.col("from").alias("i"), F.col("to").alias("a")), table.select("rep", F.col("from").alias("j"), F.col("to").alias("b"))
    moved = replicas(edges.select("i", "j", value), n).join(a, ["rep", "i"]).join(b, ["rep", "j"])
    return moved.select("rep", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), value)


def _t_of(k: int, which: int):
    @F.pandas_udf("double")
    def t(gram: pd.Series) -> pd.Series:
        return pd.Series([solve(np.array(g, float).reshape(k, k))[1][which] for g in gram])

    return t


def _residuals(edges: DataFrame, y: str, xs: list[str], name: str) -> DataFrame:
    beta = coefficients(edges, y, xs)[0]
    fit = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:], strict=True):
        fit = fit + F.lit(float(b)) * F.col(x)
    return edges.withColumn(name, F.col(y) - fit)


def _exceeding(t: DataFrame, observed: float) -> float:
    row = t.agg(F.count_if(F.abs("t") >= abs(observed) - 1e-12).alias("k"), F.count("t").alias("n")).first()
    return (row["k"] + 1) / (row["n"] + 1)


def mrqap_dsp(edges: DataFrame, y: str, xs: list[str], n: int, seed: int = 42) -> DataFrame:
    """``predictor, beta, t_obs, vif, p``: double semi-partialling. The part of a predictor that the others don't explain is relabelled and takes its place."""
    beta, t, _ = coefficients(edges, y, xs)
    out = []
    for k, x in enumerate(xs):
        others = [o for o in xs if o != x]
        rest = _residuals(edges, x, others, "_e")
        moved = relabelled(rest, "_e", n, seed + k).withColumnRenamed("_e", "_p")
        joined = moved.join(edges.select("i", "j", y, *others), ["i", "j"])
        sums = grams(joined, [*others, "_p", y], ("rep",))
        size = len(xs) + 2
        p = _exceeding(sums.select(_t_of(size, size - 2)("gram").alias("t")), t[k + 1])
        out.append((x, float(beta[k + 1]), float(t[k + 1]), vif(edges, x, others), p))
    return edges.sparkSession.createDataFrame(out, "predictor string, beta double, t_obs double, vif double, p double")


def mrqap_freedman_lane(edges: DataFrame, y: str, xs: list[str], n: int, seed: int = 42) -> DataFrame:
    """``predictor, beta, t_obs, p``: the residuals of the model without a predictor are relabelled and added to its fit."""
    beta, t, _ = coefficients(edges, y, xs)
    out = []
    for k, x in enumerate(xs):
        others = [o for o in xs if o != x]
        rest = _residuals(edges, y, others, "_e").withColumn("_fit", F.col(y) - F.col("_e"))
        moved = relabelled(rest, "_e", n, seed + 100 + k).withColumnRenamed("_e", "_p")
        joined = moved.join(rest.select("i", "j", "_fit", *xs), ["i", "j"]).withColumn("_y", F.col("_fit") + F.col("_p"))
        sums = grams(joined, [*others, x, "_y"], ("rep",))
        size = len(xs) + 2
        p = _exceeding(sums.select(_t_of(size, size - 2)("gram").alias("t")), t[k + 1])
        out.append((x, float(beta[k + 1]), float(t[k + 1]), p))
    return edges.sparkSession.createDataFrame(out, "predictor string, beta double, t_obs double, p double")


def residual_analysis(edges: DataFrame, y: str, xs: list[str], same: str, n: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``r2, mean_diff, p, n_perm, verdict``: whether the part of ``y`` that ``xs`` leave differs between pairs of the same group (``same`` is 1) and others."""
    r2 = coefficients(edges, y, xs)[2]
    rest = _residuals(edges, y, xs, "_e")
    diff = F.avg(F.when(F.col(same) == 1, F.col("_e"))) - F.avg(F.when(F.col(same) == 0, F.col("_e")))
    observed = rest.agg(diff.alias("d")).first()["d"]
    moved = relabelled(edges, same, n, seed).join(rest.select("i", "j", "_e"), ["i", "j"]).groupBy("rep").agg(diff.alias("t"))
    p = _exceeding(moved, observed) if observed is not None else None
    verdict = "no groups" if observed is None else "group structure left" if p < alpha else "no group structure left"
    return edges.sparkSession.createDataFrame([(float(r2), observed, p, n, verdict)], "r2 double, mean_diff double, p double, n_perm int, verdict string")
