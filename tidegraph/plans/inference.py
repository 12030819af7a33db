"""Queries of the resampling and testing operators. What hangs on random numbers has no SQL; tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators import distance, graph, regression, resample, rolling, symbols, timeseries
from tidegraph.plans import network as net
from tidegraph.plans.runtime import cut_lineage

MRQAP_MIN_COMMON = 60

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _observed(returns: DataFrame, method: str = "mantegna") -> DataFrame:
    return cut_lineage(graph.spanning_trees(net.backbone(net.distances(returns, method))))


def _of_tree(returns: DataFrame, tree: DataFrame) -> DataFrame:
    """The returns of the nodes of a tree: replicas are drawn over the observed universe."""
    return cut_lineage(returns.join(graph.degrees(tree).select("node"), "node", "left_semi"))


def _edges(returns: DataFrame, panel: DataFrame, method: str) -> DataFrame:
    """Distances of replica panels of returns. Symbols keep the thresholds of the observed returns."""
    n_values = returns.count()
    if method == "symbolic":
        panel = symbols.symbolize(panel, symbols.thresholds(returns, net.C.quantiles, net.C.min_symbol_obs)).select("rep", "t", "node", "symbol")
    return distance.replica_distances(panel, method, net.C.min_common, n_values)


def _spanning(returns: DataFrame, draw: Callable[[int, int], DataFrame], method: str, n: int = net.C.replicas) -> DataFrame:
    """``rep, step, i, j, w``: ``n`` trees of replicas that span all nodes. Where some don't, more are drawn, at most ``attempts`` times as many as asked for; too few valid ones are an error."""
    nodes = returns.select("node").distinct().count()
    parts, drawn, valid = [], 0, 0
    while valid < n and drawn < net.C.attempts * n:
        more = min(n - valid, net.C.attempts * n - drawn)
        edges = graph.drop_isolated(_edges(returns, draw(more, drawn + 1), method), net.C.min_peers, ("rep",))
        trees = graph.spanning_trees(edges, ("rep",)).select("rep", "step", "i", "j", "w", "n_nodes", F.count("*").over(Window.partitionBy("rep")).alias("k"))
        parts.append(cut_lineage(trees.where((F.col("k") == nodes - 1) & (F.col("n_nodes") == nodes)).select("rep", "step", "i", "j", "w")))
        valid += parts[-1].select("rep").distinct().count()
        drawn += more
    if drawn and nodes > 1 and valid < max(min(30, n), 0.6 * n):
        raise ValueError(f"only {valid} of {drawn} replicas have a tree of all nodes")
    return reduce(DataFrame.unionByName, parts)


def _null_trees(returns: DataFrame, kind: str, method: str = "mantegna") -> DataFrame:
    """Trees of null panels, keyed by ``rep``."""
    return _spanning(returns, lambda n, first: resample.null_panel(returns, n, kind, first=first), method)


def _test_of(returns: DataFrame, tree: DataFrame, kind: str, method: str) -> DataFrame:
    weights = _null_trees(_of_tree(returns, tree), kind, method).select("rep", F.col("step").alias("rank"), "w")
    return resample.order_statistic_test(tree.select(F.col("step").alias("rank"), "w"), weights, net.C.link_ci)


def _test(spark, sf_dir, kind: str) -> DataFrame:
    returns = net.brand_returns(spark, sf_dir)
    return _test_of(returns, _observed(returns), kind, "mantegna")


@query()
def mc_edge_test_permutation(spark, sf_dir):
    return _test(spark, sf_dir, "permutation")


@query()
def mc_edge_test_circular_shift(spark, sf_dir):
    return _test(spark, sf_dir, "circular_shift")


@query()
def mc_edge_test_phase(spark, sf_dir):
    return _test(spark, sf_dir, "phase")


NULLS = ("permutation", "circular_shift")


def _tests(spark, sf_dir) -> DataFrame:
    """The order statistic test of every method against both nulls: ``method, null_model, rank, ...``."""
    returns = net.brand_returns(spark, sf_dir)
    trees = {m: _observed(returns, m) for m in net.METHODS}
    return reduce(DataFrame.unionByName, [net._keyed(cut_lineage(_test_of(returns, tree, kind, m)), method=m, null_model=kind) for m, tree in trees.items() for kind in NULLS])


@query()
def mc_edge_test_runs(spark, sf_dir):
    return _tests(spark, sf_dir)


@query()
def null_model_agreement(spark, sf_dir):
    returns = net.brand_returns(spark, sf_dir)
    tree = _observed(returns)
    return resample.null_agreement(*(cut_lineage(_test_of(returns, tree, kind, "mantegna")) for kind in NULLS))


@query()
def null_model_agreement_runs(spark, sf_dir):
    rows = cut_lineage(_tests(spark, sf_dir))
    of = lambda m, kind: rows.where((F.col("method") == m) & (F.col("null_model") == kind))
    return reduce(DataFrame.unionByName, [net._keyed(resample.null_agreement(*(of(m, kind) for kind in NULLS)), method=m) for m in net.METHODS])


@query()
def jaccard_expected(spark, sf_dir):
    return resample.expected_jaccard(_null_trees(net.brand_returns(spark, sf_dir), "permutation"))


@query()
def degree_distribution_test(spark, sf_dir):
    returns = net.brand_returns(spark, sf_dir)
    tree = _observed(returns)
    return resample.degree_test(tree, _null_trees(_of_tree(returns, tree), "permutation"), net.C.random_trees)


@query()
def degree_distribution_test_runs(spark, sf_dir):
    returns = net.brand_returns(spark, sf_dir)
    trees = {m: _observed(returns, m) for m in net.METHODS}
    runs = [(m, kind, resample.degree_test(tree, _null_trees(_of_tree(returns, tree), kind, m), net.C.random_trees)) for m, tree in trees.items() for kind in NULLS]
    return reduce(DataFrame.unionByName, [net._keyed(rows, method=m, null_panel=kind) for m, kind, rows in runs])


def _support(returns: DataFrame, method: str) -> DataFrame:
    """Bootstrap replicas of the method's tree; those that don't span the nodes are not replaced, ``n_valid`` tells how many do."""
    tree = _observed(returns, method)
    kept = _of_tree(returns, tree)
    trees = cut_lineage(graph.spanning_trees(_edges(kept, resample.bootstrap_panel(kept, net.C.replicas), method), ("rep",)))
    return resample.edge_support(tree, trees, net._universe(kept))


@query()
def edge_bootstrap_support(spark, sf_dir):
    return _support(net.brand_returns(spark, sf_dir), "mantegna")


@query()
def edge_bootstrap_support_runs(spark, sf_dir):
    returns = net.brand_returns(spark, sf_dir)
    return reduce(DataFrame.unionByName, [net._keyed(_support(returns, m), method=m) for m in net.METHODS])


@query()
def edge_perturbation(spark, sf_dir):
    edges = cut_lineage(net.backbone(distance.mantegna(net.brand_returns(spark, sf_dir), net.C.min_common)).select("i", "j", "w"))
    return resample.perturbation_robustness(edges, net.C.perturbed, net.C.perturbation_replicas)


_STATS = net.SQL["descriptive_stats"]


@query(
    f"""WITH s AS ({_STATS}), k AS (SELECT node, jb_pval AS p, row_number() OVER (ORDER BY jb_pval, node) AS r, count(*) OVER () AS m FROM s)
SELECT node, p, round(least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh,
 round(max(least(1, (m - r + 1) * p)) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM k"""
)
def multiple_testing(spark, sf_dir):
    rows = net.QUERIES["descriptive_stats"](spark, sf_dir).select("node", F.col("jb_pval").alias("p"))
    return net._r(resample.adjusted(rows, "p"), "p_bh", "p_holm")


def _ntl(spark, sf_dir) -> DataFrame:
    edges, ends, n = net._rolling(spark, sf_dir, "mantegna")
    series = rolling.rolling_ntl(edges, ends, n, net.C.min_peers)
    return cut_lineage(series.select(F.lit("mantegna").alias("method"), F.col("t_end").alias("t"), F.col("ntl").alias("value")))


@query()
def stationarity(spark, sf_dir):
    return timeseries.stationarity(_ntl(spark, sf_dir), "method")


@query()
def ntl_band(spark, sf_dir):
    series = _ntl(spark, sf_dir)
    said = timeseries.stationarity(series, "method").first()
    kept = series.where(F.col("value").isNotNull())
    if said is None or said["n_obs"] < 20:  # no band for so short a series
        return kept.select("t", "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("too short").alias("scheme"))
    return timeseries.bootstrap_band(series.select("t", "value"), said["conclusion"], net.C.band_replicas, net.C.band_ci)


@query()
def ntl_export(spark, sf_dir):
    edges, ends, n = net._rolling(spark, sf_dir, "mantegna")
    return rolling.banded_series(rolling.rolling_ntl(edges, ends, n, net.C.min_peers), ntl_band(spark, sf_dir))


@query()
def ntl_band_episodes(spark, sf_dir):
    band = ntl_band(spark, sf_dir).select(F.col("t").alias("t_end"), F.col("value").alias("ntl"), "low", "high")
    return rolling.episodes(band)


def _ntl_runs(spark, sf_dir) -> DataFrame:
    return net.ntl_runs(spark, sf_dir).select("method", "window", F.col("t_end").alias("t"), F.col("ntl").alias("value"))


def _stationarity_runs(series: DataFrame) -> DataFrame:
    key = F.concat_ws("@", "method", "window")
    parts = F.split("run", "@")
    return timeseries.stationarity(series.select(key.alias("run"), "t", "value"), "run").select(parts[0].alias("method"), parts[1].cast("int").alias("window"), "*").drop("run")


@query()
def stationarity_runs(spark, sf_dir):
    return _stationarity_runs(_ntl_runs(spark, sf_dir))


def _bands(spark, sf_dir) -> DataFrame:
    """``method, window, t, value, low, high, scheme`` of all runs; a series of less than 20 values has no band."""
    series = _ntl_runs(spark, sf_dir)
    said = {(r["method"], r["window"]): r["conclusion"] for r in _stationarity_runs(series).collect() if r["n_obs"] >= 20}  # a row a run
    parts = []
    for m in net.SPECS:
        for w in net.C.windows:
            one = series.where((F.col("method") == m) & (F.col("window") == w) & F.col("value").isNotNull()).select("t", "value")
            none = F.lit(None).cast("double")
            rows = timeseries.bootstrap_band(one, said[m, w], net.C.band_replicas, net.C.band_ci) if (m, w) in said else one.select("t", "value", none.alias("low"), none.alias("high"), F.lit("too short").alias("scheme"))
            parts.append(net._keyed(rows, method=m, window=w))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


@query()
def ntl_band_runs(spark, sf_dir):
    return _bands(spark, sf_dir)


@query()
def ntl_band_episodes_runs(spark, sf_dir):
    bands = _bands(spark, sf_dir).select("method", "window", F.col("t").alias("t_end"), F.col("value").alias("ntl"), "low", "high")
    return net.by_run(bands, rolling.episodes)


@query()
def edge_perturbation_runs(spark, sf_dir):
    returns = net.brand_returns(spark, sf_dir)
    edges = {m: cut_lineage(net.backbone(net.distances(returns, m)).select("i", "j", "w")) for m in net.METHODS}
    return reduce(DataFrame.unionByName, [net._keyed(resample.perturbation_robustness(e, net.C.perturbed, net.C.perturbation_replicas), method=m) for m, e in edges.items()])


def _variables(spark, sf_dir) -> DataFrame:
    """The distances of the nation panel by three methods and whether two nations share a region."""
    returns = net.nation_returns(spark, sf_dir)
    parts = [net.distances(returns, m, MRQAP_MIN_COMMON).where(F.col("w").isNotNull()).select("i", "j", F.col("w").alias(m)) for m in net.METHODS]
    of = net.sectors(spark, sf_dir)
    rows = parts[0].join(parts[1], ["i", "j"]).join(parts[2], ["i", "j"])
    rows = rows.join(of.select(F.col("node").alias("i"), F.col("sector").alias("si")), "i").join(of.select(F.col("node").alias("j"), F.col("sector").alias("sj")), "j")
    return cut_lineage(rows.select("i", "j", *net.METHODS, (F.col("si") == F.col("sj")).cast("double").alias("same_sector")))


_XS = ["mantegna", "spearman", "same_sector"]


@query()
def mrqap_dsp(spark, sf_dir):
    return net._r(regression.mrqap_dsp(_variables(spark, sf_dir), "symbolic", _XS, net.C.replicas), "beta", "t_obs", "vif")


@query()
def mrqap_freedman_lane(spark, sf_dir):
    return net._r(regression.mrqap_freedman_lane(_variables(spark, sf_dir), "symbolic", _XS, net.C.replicas), "beta", "t_obs")


SPECS = {"A": ["mantegna", "same_sector"], "B": ["spearman", "same_sector"], "C": _XS}


@query()
def symbolic_non_redundancy(spark, sf_dir):
    """Two sensitivity models and the joint one: ``spec, predictor, beta, t_obs, vif, p, p_bh``; p is adjusted within the joint model only."""
    rows = _variables(spark, sf_dir)
    fits = {k: net._keyed(regression.mrqap_dsp(rows, "symbolic", xs, net.C.replicas), spec=k) for k, xs in SPECS.items()}
    joint = resample.adjusted(fits["C"], "p").drop("p_holm")
    others = fits["A"].unionByName(fits["B"]).withColumn("p_bh", F.lit(None).cast("double"))
    return net._r(joint.unionByName(others), "beta", "t_obs", "vif")


@query()
def symbolic_residuals(spark, sf_dir):
    return net._r(regression.residual_analysis(_variables(spark, sf_dir), "symbolic", ["mantegna", "spearman"], "same_sector", net.C.replicas), "r2", "mean_diff")


@query(
    net._with(*net._NRET, net._symbols(), net._distance("mantegna", MRQAP_MIN_COMMON, "dm"), net._distance("symbolic", MRQAP_MIN_COMMON, "ds"))
    + "SELECT round(regr_slope(ds.w, dm.w), 6) AS beta, round(regr_intercept(ds.w, dm.w), 6) AS constant, round(regr_r2(ds.w, dm.w), 6) AS r2, count(*) AS n_pairs FROM dm JOIN ds USING (i, j) WHERE dm.w IS NOT NULL AND ds.w IS NOT NULL"
)
def symbolic_on_mantegna(spark, sf_dir):
    returns = net.nation_returns(spark, sf_dir)
    x, y = (net.distances(returns, m, MRQAP_MIN_COMMON).where(F.col("w").isNotNull()).select("i", "j", F.col("w").alias(m)) for m in ("mantegna", "symbolic"))
    rows = cut_lineage(x.join(y, ["i", "j"]))
    fits = rows.agg(F.regr_slope("symbolic", "mantegna").alias("beta"), F.regr_intercept("symbolic", "mantegna").alias("constant"), F.regr_r2("symbolic", "mantegna").alias("r2"), F.count("*").alias("n_pairs"))
    return net._r(fits, "beta", "constant", "r2")


