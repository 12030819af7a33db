"""Convergence of methods and robustness of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.distance import symbolic
from tidegraph.operators.graph import betweenness, both_ways, branches, degrees, drop_isolated, edge_jaccard, finite, hubs, largest_component, spanning_trees
from tidegraph.operators.symbols import symbolize, thresholds
from tidegraph.plans.runtime import cut_lineage


def distance_correlation(edges: DataFrame) -> DataFrame:
    """``pair, n_pairs, r``: Pearson's correlation of the distances of each pair of methods (``method, i, j, w``) on their common finite pairs."""
    a = finite(edges).select(F.col("method").alias("ma"), "i", "j", F.col("w").alias("x"))
    b = finite(edges).select(F.col("method").alias("mb"), "i", "j", F.col("w").alias("y"))
    sums = a.join(b, ["i", "j"]).where("ma < mb").groupBy("ma", "mb").agg(F.count("*").alias("n_pairs"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return sums.select(F.concat_ws("-", "ma", "mb").alias("pair"), "n_pairs", F.try_divide("c", F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0))).alias("r"))


def series_correlation(series: DataFrame, least: int = 10) -> DataFrame:
    """``pair, n_shared, r``: Pearson's correlation of the series (``method, t_end, ntl``) of each pair of methods over the windows where both have a value.

    ``r`` is null with ``least`` shared windows or fewer, or if a series doesn't vary.
    """
    told = series.where("ntl is not null")
    a = told.select(F.col("method").alias("ma"), "t_end", F.col("ntl").alias("x"))
    b = told.select(F.col("method").alias("mb"), "t_end", F.col("ntl").alias("y"))
    sums = a.join(b, "t_end").where("ma < mb").groupBy("ma", "mb").agg(F.count("*").alias("n_shared"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    r = F.try_divide("c", F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0)))
    return sums.select(F.concat_ws("-", "ma", "mb").alias("pair"), "n_shared", F.when(F.col("n_shared") > least, r).alias("r"))


def tree_agreement(trees: DataFrame) -> DataFrame:
    """``pair, shared, united, jaccard``: the edges that the trees of two methods share."""
    methods = trees.select("method").distinct()
    pairs = methods.select(F.col("method").alias("ma")).join(methods.select(F.col("method").alias("mb")), F.col("ma") < F.col("mb")).select("ma", "mb", F.concat_ws("-", "ma", "mb").alias("pair"))
    few = F.broadcast(pairs)  # pairs of methods, three of them
    a = trees.join(few, trees["method"] == few["ma"]).select("pair", "i", "j")
    b = trees.join(few, trees["method"] == few["mb"]).select("pair", "i", "j")
    return edge_jaccard(a, b, ("pair",))


def snapshot_row(tree: DataFrame) -> DataFrame:
    """One row: ``hub, hub_degree, tied, co_hubs`` (the other nodes of that degree), the leader by betweenness, and the shortest and longest edge of a tree. Ties by name."""
    degree, between = degrees(tree), betweenness(branches(tree))
    hub = hubs(degree, between)
    peers = degree.join(hub, (F.col("degree") == F.col("hub_degree")) & (F.col("node") != F.col("hub")))
    co = peers.agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("co_hubs"))
    lead = between.agg(F.min(F.struct((-F.round("betweenness", 9)).alias("b"), "node", "betweenness")).alias("x")).select(F.col("x.node").alias("leader"), F.col("x.betweenness").alias("leader_betweenness"))
    order = F.struct("w", "i", "j")
    ends = tree.agg(F.min(order).alias("a"), F.max(order).alias("b"))
    name = lambda e: F.concat_ws("-", f"{e}.i", f"{e}.j")
    ends = ends.select(name("a").alias("min_edge"), F.col("a.w").alias("min_w"), name("b").alias("max_edge"), F.col("b.w").alias("max_w"))
    return hub.join(F.broadcast(co)).join(F.broadcast(lead)).join(F.broadcast(ends))  # one row each


def leave_one_out(edges: DataFrame, top: int = 5, nodes: list[str] | None = None, min_peers: int = 1) -> DataFrame:
    """``excluded, degree, new_hub, new_hub_degree, new_ntl, n_edges, jaccard``: the tree without each of the ``top`` nodes of highest degree (ties by name), or without each of ``nodes``.

    Distances of other pairs don't change, so they are used again; nodes that lose their ``min_peers`` or the largest component with the removal go too. The Jaccard index is against the first
    tree's edges without the node. A node that isn't in the tree gives no row.
    """
    tree = spanning_trees(edges)
    best = degrees(tree).select(F.col("node").alias("excluded"), "degree")
    best = cut_lineage(best.where(F.col("excluded").isin(nodes)) if nodes is not None else best.orderBy(F.desc("degree"), "excluded").limit(top))
    out = F.broadcast(best)  # a row a node left out
    without = lambda df: df.join(out, (F.col("i") != F.col("excluded")) & (F.col("j") != F.col("excluded")))
    key = ("excluded",)
    met = cut_lineage(drop_isolated(without(finite(edges)).select("excluded", "i", "j", "w"), min_peers, key))
    inside = largest_component(met, key)
    for end in ("i", "j"):
        met = met.join(inside.withColumnRenamed("node", end), ["excluded", end], "left_semi")
    fresh = cut_lineage(spanning_trees(met.select("excluded", "i", "j", "w"), key))
    hub = hubs(degrees(fresh, key), betweenness(branches(fresh, key), key), key).select("excluded", F.col("hub").alias("new_hub"), F.col("hub_degree").alias("new_hub_degree"))
    mean = fresh.groupBy("excluded").agg(F.avg("w").alias("new_ntl"), F.count("*").alias("n_edges"))
    shared = edge_jaccard(without(tree.select("i", "j")).select("excluded", "i", "j"), fresh.select("excluded", "i", "j"), key)
    return best.join(hub, "excluded").join(mean, "excluded").join(shared.select("excluded", "jaccard"), "excluded")


def partition_robustness(returns: DataFrame, pairs: list[tuple[str, float, float]], least: int, min_common: int) -> DataFrame:
    """``partition, ntl, delta_ntl_pct, r_distance, jaccard, status`` for quantile pairs (name, low, high); the first one is the base.

    ``status`` is ``base``, ``ok``, ``disconnected`` (a forest) or ``no tree`` (all other columns are null).
    """
    parts = None
    for name, low, high in pairs:
        symbols = symbolize(returns, thresholds(returns, (low, high), least))
        d = symbolic(symbols, min_common).withColumn("partition", F.lit(name))
        parts = d if parts is None else parts.unionByName(d)
    edges = finite(parts)
    trees = spanning_trees(edges, ("partition",))
    base = pairs[0][0]
    ntl = trees.groupBy("partition").agg(F.avg("w").alias("ntl"), (F.count("*") == F.max("n_nodes") - 1).alias("whole"))
    first = ntl.where(F.col("partition") == base).select(F.col("ntl").alias("base_ntl"))
    mine = edges.select("partition", "i", "j", "w").join(edges.where(F.col("partition") == base).select("i", "j", F.col("w").alias("b")), ["i", "j"])
    r = mine.groupBy("partition").agg(F.covar_pop("w", "b").alias("c"), F.var_pop("w").alias("x"), F.var_pop("b").alias("y"))
    r = r.select("partition", F.try_divide("c", F.nullif(F.sqrt(F.col("x") * F.col("y")), F.lit(0.0))).alias("r_distance"))
    names = trees.select("partition").distinct()
    original = trees.where(F.col("partition") == base).select("i", "j").join(F.broadcast(names))  # one row a partition
    met = edge_jaccard(original.select("partition", "i", "j"), trees.select("partition", "i", "j"), ("partition",)).select("partition", "jaccard")
    out = ntl.join(F.broadcast(first)).join(r, "partition").join(met, "partition")  # one row
    asked = returns.sparkSession.createDataFrame([(name,) for name, _, _ in pairs], "partition string")
    status = F.when(F.col("whole").isNull(), "no tree").when(~F.col("whole"), "disconnected").when(F.col("partition") == base, "base").otherwise("ok")
    rows = asked.join(out, "partition", "left")
    return rows.select("partition", "ntl", (100 * (F.col("ntl") / F.col("base_ntl") - 1)).alias("delta_ntl_pct"), "r_distance", "jaccard", status.alias("status"))


def module_correlation(rho: DataFrame, sectors: DataFrame) -> DataFrame:
    """``corr_intra, corr_inter, n_intra, n_inter, difference``: mean correlation of pairs of the same sector and of others; a node without a sector is in 'Other'."""
    of = sectors.groupBy("node").agg(F.min("sector").alias("sector"))
    named = lambda end: of.select(F.col("node").alias(end), F.col("sector").alias(f"s{end}"))
    pairs = rho.where(F.col("rho").isNotNull()).join(named("i"), "i", "left").join(named("j"), "j", "left")
    same = F.coalesce("si", F.lit("Other")) == F.coalesce("sj", F.lit("Other"))
    sums = pairs.agg(F.avg(F.when(same, F.col("rho"))).alias("corr_intra"), F.avg(F.when(~same, F.col("rho"))).alias("corr_inter"), F.count_if(same).alias("n_intra"), F.count_if(~same).alias("n_inter"))
    return sums.withColumn("difference", F.col("corr_intra") - F.col("corr_inter"))


def edge_table(tree: DataFrame, sectors: DataFrame) -> DataFrame:
    """``rank, i, sector_i, j, sector_j, w, same_sector``: the edges of a tree in ascending order."""
    of = sectors.groupBy("node").agg(F.min("sector").alias("sector"))
    named = lambda end: of.select(F.col("node").alias(end), F.col("sector").alias(f"sector_{end}"))
    rows = tree.select(F.col("step").alias("rank"), "i", "j", "w").join(named("i"), "i", "left").join(named("j"), "j", "left")
    rows = rows.withColumns({f"sector_{e}": F.coalesce(f"sector_{e}", F.lit("Other")) for e in "ij"})
    return rows.select("rank", "i", "sector_i", "j", "sector_j", "w", (F.col("sector_i") == F.col("sector_j")).alias("same_sector"))


def strongest_neighbours(edges: DataFrame, top: int = 3) -> DataFrame:
    """``node, rank, other, w``: the nearest nodes of each node."""
    w = Window.partitionBy("node").orderBy("w", "other")
    return both_ways(finite(edges)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("node", "rank", "other", "w")
