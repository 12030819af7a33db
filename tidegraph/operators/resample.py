"""Resampling: null panels, bootstraps, perturbation, and tests against them.

A replica is a column, not a loop: ``rep`` numbers the replicas and all of them go through the same distance and tree operators in one plan. Random numbers
are hashes of (seed, replica, item), so results don't hang on partitioning and a lost task gives the same numbers again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.graph import degrees, spanning_trees


def uniform(*keys) -> Column:
    """A uniform number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), 11) * F.lit(2.0**-53)


def normal(*keys) -> Column:
    """A standard normal number from two hashes of the keys (Box-Muller)."""
    return F.sqrt(-2 * F.ln(1 - uniform(*keys, "a"))) * F.cos(2 * np.pi * uniform(*keys, "b"))


def replicas(df: DataFrame, n: int, first: int = 1) -> DataFrame:
    """Every row with ``n`` numbers ``rep`` from ``first`` on; ``df`` is an aggregate (nodes by dates), not raw data."""
    return df.select(F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("rep"), "*")


def null_panel(returns: DataFrame, n: int, kind: str, seed: int = 42, first: int = 1) -> DataFrame:
    """``rep, t, node, r`` with the dependence between nodes broken; each node keeps its own values and dates.

    ``permutation`` shuffles a node's values over its dates, ``circular_shift`` rolls them by a number of places from 0 (if there are more than 2), ``phase`` keeps the
    spectrum and draws the phases anew (if there are more than 10).
    """
    base = returns.select("t", "node", "r")
    if kind == "phase":
        return replicas(base, n, first).groupBy("rep", "node").applyInPandas(_phases(seed), "rep int, t int, node string, r double")
    # a node's values are one array, as long as the calendar; each replica is spread over the tasks with its nodes
    lists = base.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "r"))).alias("v"))
    width = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = replicas(lists, n, first).repartition(width, "rep")
    size = F.size("v")
    if kind == "permutation":
        mixed = F.sort_array(F.transform("v", lambda x: F.struct(F.xxhash64(F.lit(seed), "rep", "node", x["t"]).alias("h"), x["t"].alias("t"), x["r"].alias("r"))))
    elif kind == "circular_shift":
        shift = F.when(size > 2, F.floor(uniform(seed, F.col("rep"), F.col("node")) * size)).otherwise(0).cast("int")
        mixed = F.concat(F.slice("v", size - shift + 1, shift), F.slice("v", F.lit(1), size - shift))
    else:
        raise ValueError(kind)
    moved = F.zip_with("v", mixed, lambda a, b: F.struct(a["t"].alias("t"), b["r"].alias("r")))
    return drawn.select("rep", "node", F.inline(moved)).select("rep", "t", "node", "r")


def _phases(seed: int):
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        n = len(rows)
        if n > 10:
            key = pd.util.hash_pandas_object(rows["node"].iloc[:1], index=False).iloc[0]
            rng = np.random.default_rng([seed, int(rows["rep"].iloc[0]), int(key)])
            spectrum = np.fft.rfft(rows["r"].to_numpy())
            angle = rng.uniform(0, 2 * np.pi, len(spectrum))
            angle[0] = 0
            if n % 2 == 0:
                angle[-1] = 0
            rows = rows.assign(r=np.fft.irfft(spectrum * np.exp(1j * angle), n))
        return rows[["rep", "t", "node", "r"]]

    return draw


def block_length(n: int) -> int:
    """Rows in a block: the cube root of n rounded, at least 5, at most half of n."""
    return max(1, min(max(5, round(n ** (1 / 3))), n // 2))


def block_dates(n_dates: int, n: int, spark, seed: int = 42, first: int = 1, size: int | None = None) -> DataFrame:
    """``rep, t, src``: for each place of a resampled calendar the date that a moving block (of ``size``, or ``block_length``) puts there."""
    size = size or block_length(n_dates)
    blocks = -(-n_dates // size)
    rows = spark.range(n).select((F.col("id") + first).cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    start = F.floor(uniform(seed, F.col("rep"), F.col("block")) * (n_dates - size + 1)).cast("int")
    placed = rows.select("rep", "block", start.alias("start")).select("rep", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"), "block", "start")
    return placed.select("rep", (F.col("block") * size + F.col("k")).alias("t"), (F.col("start") + F.col("k")).alias("src")).where(F.col("t") < n_dates)


def bootstrap_panel(returns: DataFrame, n: int, seed: int = 42, first: int = 1) -> DataFrame:
    """``rep, t, node, r``: blocks of dates drawn jointly for all nodes."""
    n_dates = returns.agg(F.max("t") + 1).first()[0] or 0
    drawn = block_dates(n_dates, n, returns.sparkSession, seed, first)
    return drawn.join(returns.select(F.col("t").alias("src"), "node", "r"), "src").select("rep", "t", "node", "r")


def ranked_weights(trees: DataFrame, n_nodes: int) -> DataFrame:
    """``rep, rank, w`` of the replicas whose tree spans all nodes."""
    whole = Window.partitionBy("rep")
    return trees.withColumn("k", F.count("*").over(whole)).where(F.col("k") == n_nodes - 1).select("rep", F.col("step").alias("rank"), "w")


def adjusted(tests: DataFrame, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``tests`` with ``p_bh`` and ``p_holm``, within ``by``; ranks by p, ties in any order (they get equal results)."""
    key = Window.partitionBy(*by)
    known = tests.withColumn("_m", F.count(p).over(key)).withColumn("_k", F.row_number().over(key.orderBy(F.col(p).asc_nulls_last())))
    up = key.orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = key.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(up))
    holm = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col(p))).over(down)
    return known.withColumn("p_bh", F.when(F.col(p).isNotNull(), bh)).withColumn("p_holm", F.when(F.col(p).isNotNull(), holm)).drop("_m", "_k")


def order_statistic_test(observed: DataFrame, null_weights: DataFrame, ci: tuple[float, float] = (0.025, 0.975), alpha: float = 0.05) -> DataFrame:
    """One row a rank of the sorted tree edges: the observed weight against its null distribution.

    ``observed``: ``rank, w``; ``null_weights``: ``rep, rank, w``. Columns: observed, ci_low, ci_high, null_mean, null_std, z (null without spread), p_two, p_one (the observed one is
    smaller), both adjusted, flags (``sig_raw``: outside the interval), replicas.
    """
    joined = null_weights.select("rank", F.col("w").alias("v")).join(observed.select("rank", F.col("w").alias("observed")), "rank")
    n, o, v = F.count("*"), F.col("observed"), F.col("v")
    s = joined.groupBy("rank").agg(
        F.first(o).alias("observed"), F.percentile("v", F.array(F.lit(ci[0]), F.lit(ci[1]))).alias("q"), F.avg(v).alias("null_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("null_std"),
        ((F.count_if(v <= o) + 1) / (n + 1)).alias("p_one"), ((F.count_if(v >= o) + 1) / (n + 1)).alias("p_ge"), n.alias("replicas"),
    )
    rows = s.select(
        "rank", "observed", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "null_mean", "null_std", F.when(F.col("null_std") > 1e-12, (o - F.col("null_mean")) / F.col("null_std")).alias("z"),
        F.least(F.lit(1.0), 2 * F.least("p_one", "p_ge")).alias("p_two"), "p_one", "replicas",
    )
    two = adjusted(rows, "p_two").withColumnRenamed("p_bh", "p_two_bh").drop("p_holm")
    both = adjusted(two, "p_one").withColumnRenamed("p_bh", "p_one_bh").drop("p_holm")
    outside = (F.col("observed") < F.col("ci_low")) | (F.col("observed") > F.col("ci_high"))
    return both.withColumns({"sig_raw": outside, "sig_bh": F.col("p_two_bh") < alpha, "sig_bh_one": F.col("p_one_bh") < alpha})


def null_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n_ranks, sig_a, sig_b, agreement_pct`` of two tests of the same ranks."""
    joined = a.select("rank", F.col("sig_bh").alias("x")).join(b.select("rank", F.col("sig_bh").alias("y")), "rank")
    return joined.agg(F.count("*").alias("n_ranks"), F.count_if("x").alias("sig_a"), F.count_if("y").alias("sig_b"), (100 * F.avg((F.col("x") == F.col("y")).cast("int"))).alias("agreement_pct"))


def expected_jaccard(trees: DataFrame, most: int = 100) -> DataFrame:
    """``pairs, jaccard``: mean edge overlap of successive null trees, of at most ``most`` pairs (a parameter of the statistic)."""
    edges = trees.select("rep", "i", "j")
    size = edges.groupBy("rep").agg(F.count("*").alias("k"))
    shared = edges.join(edges.withColumn("rep", F.col("rep") - 1), ["rep", "i", "j"]).groupBy("rep").agg(F.count("*").alias("shared"))
    pairs = size.join(size.select((F.col("rep") - 1).alias("rep"), F.col("k").alias("k2")), "rep").join(shared, "rep", "left").where(F.col("rep") <= most)
    s = F.coalesce("shared", F.lit(0))
    return pairs.agg(F.count("*").alias("pairs"), F.avg(s / (F.col("k") + F.col("k2") - s)).alias("jaccard"))


def tree_shape(degree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, n_nodes, max_degree, entropy`` (bits) of degrees ``by, node, degree``."""
    counts = degree.groupBy(*by, "degree").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(*by))
    rows = counts.withColumn("p", p)
    return rows.groupBy(*map(F.col, by)).agg(F.sum("k").alias("n_nodes"), F.max("degree").alias("max_degree"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def random_tree_degrees(spark, n_nodes: int, n: int, seed: int = 42) -> DataFrame:
    """``rep, node, degree`` of uniform labelled trees: 1 and the count of a node in a random Prüfer sequence; 1 each for two nodes or one."""
    nodes = spark.range(n).select((F.col("id") + 1).cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1))).alias("node"))
    if n_nodes <= 2:
        return nodes.withColumn("degree", F.lit(1).cast("long"))
    drawn = spark.range(n).select((F.col("id") + 1).cast("int").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(n_nodes - 2))).alias("k"))
    counts = drawn.select("rep", F.floor(uniform(seed, F.col("rep"), F.col("k")) * n_nodes).cast("int").alias("node")).groupBy("rep", "node").agg(F.count("*").alias("c"))
    return nodes.join(counts, ["rep", "node"], "left").select("rep", "node", (1 + F.coalesce("c", F.lit(0))).alias("degree"))


_DEGREE_TEST = (
    "n_nodes long, max_degree long, degree_entropy double, null_model string, n_null long, null_max_degree_mean double, p_max_degree double, p_entropy double, "
    "p_max_degree_holm double, p_entropy_holm double"
)


def degree_test(tree: DataFrame, null_trees: DataFrame, n_random: int, seed: int = 42) -> DataFrame:
    """Observed largest degree (large is rare) and degree entropy (small is rare) against null trees and uniform labelled trees.

    ``null_model, n_null, null_max_degree_mean, p_max_degree, p_entropy`` and both adjusted by Holm, with the observed values; one row a null model.
    """
    seen = tree_shape(degrees(tree)).first()
    if seen is None or seen["n_nodes"] is None:  # a tree without edges has no shape to test
        return tree.sparkSession.createDataFrame([], _DEGREE_TEST)
    n = seen["n_nodes"]
    real = tree_shape(degrees(null_trees, ("rep",)), ("rep",)).where(F.col("n_nodes") == n).withColumn("null_model", F.lit("null_panel"))
    uniform_trees = tree_shape(random_tree_degrees(tree.sparkSession, n, n_random, seed), ("rep",)).withColumn("null_model", F.lit("uniform_tree"))
    k = F.count("*")
    s = real.unionByName(uniform_trees).groupBy("null_model").agg(
        k.alias("n_null"), F.avg("max_degree").alias("null_max_degree_mean"), ((F.count_if(F.col("max_degree") >= seen["max_degree"]) + 1) / (k + 1)).alias("p_max_degree"),
        ((F.count_if(F.col("entropy") <= seen["entropy"] + 1e-12) + 1) / (k + 1)).alias("p_entropy"),
    )
    lo, hi = F.least("p_max_degree", "p_entropy"), F.greatest("p_max_degree", "p_entropy")
    first = F.least(F.lit(1.0), 2 * lo)
    holm = lambda p: F.when(F.col(p) == lo, first).otherwise(F.greatest(first, hi))
    return s.select(F.lit(n).alias("n_nodes"), F.lit(seen["max_degree"]).alias("max_degree"), F.lit(seen["entropy"]).alias("degree_entropy"), "*", holm("p_max_degree").alias("p_max_degree_holm"), holm("p_entropy").alias("p_entropy_holm"))


def edge_support(tree: DataFrame, trees: DataFrame, n_nodes: int) -> DataFrame:
    """``i, j, w, support, n_valid``: the share of replica trees (that span all nodes) which hold each observed edge."""
    whole = trees.withColumn("k", F.count("*").over(Window.partitionBy("rep"))).where(F.col("k") == n_nodes - 1)
    valid = whole.agg(F.countDistinct("rep").alias("n_valid"))
    hits = whole.groupBy("i", "j").agg(F.count("*").alias("hits"))
    joined = tree.select("i", "j", "w").join(hits, ["i", "j"], "left").join(F.broadcast(valid))  # one row
    return joined.select("i", "j", "w", F.try_divide(F.coalesce("hits", F.lit(0)), "n_valid").alias("support"), "n_valid")


def perturbed(edges: DataFrame, ks: tuple[int, ...], n: int, seed: int = 42) -> DataFrame:
    """``k, rep, i, j, w``: in each replica k edges drawn at random get noise of a tenth of their weight (0.01 where it is about nought), at least 0.001 in the end."""
    cells = replicas(edges.select("i", "j", "w"), n).select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "*")
    place = F.row_number().over(Window.partitionBy("k", "rep").orderBy(F.xxhash64(F.lit(seed), "k", "rep", "i", "j"), "i", "j"))
    sd = F.when(F.abs("w") < 1e-9, 0.01).otherwise(0.1 * F.col("w"))
    noisy = F.greatest(F.lit(0.001), F.col("w") + sd * normal(seed, F.col("k"), F.col("rep"), F.col("i"), F.col("j")))
    return cells.withColumn("place", place).select("k", "rep", "i", "j", F.when(F.col("place") <= F.col("k"), noisy).otherwise(F.col("w")).alias("w"))


def perturbation_robustness(edges: DataFrame, ks: tuple[int, ...], n: int, seed: int = 42) -> DataFrame:
    """``k_perturbed, n_replicas`` and mean, deviation (population), least, quartiles of the overlap of perturbed trees with the first one; a k above the number of edges is left out."""
    n_edges = edges.count()
    ks = tuple(k for k in ks if k <= n_edges) or (0,)
    tree = spanning_trees(edges).select("i", "j", F.lit(1).alias("hit"))
    size = tree.count()
    trees = spanning_trees(perturbed(edges, ks, n, seed), ("k", "rep"))
    shared = trees.join(tree, ["i", "j"], "left").groupBy("k", "rep").agg(F.count("hit").alias("s"), F.count("*").alias("m"))
    j = shared.where("k > 0").select("k", (F.col("s") / (F.col("m") + size - F.col("s"))).alias("x"))
    return j.groupBy(F.col("k").alias("k_perturbed")).agg(
        F.count("*").alias("n_replicas"), F.avg("x").alias("jaccard_mean"), F.stddev_pop("x").alias("jaccard_std"), F.min("x").alias("jaccard_min"),
        F.percentile("x", 0.25).alias("jaccard_q25"), F.percentile("x", 0.5).alias("jaccard_median"), F.percentile("x", 0.75).alias("jaccard_q75"),
    )
