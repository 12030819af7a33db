import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.operators import distance, graph, panel, resample, robustness, rolling, symbols

EDGES = "i string, j string, w double"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def random_graph(n, seed, share=1.0, ties=False):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(n)]
    pick = (lambda: rng.choice([0.0, 0.5, 1.0])) if ties else rng.random
    return [(a, b, pick()) for k, a in enumerate(names) for b in names[k + 1 :] if rng.random() < share]


def kruskal(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j, w in sorted(rows, key=lambda e: (e[2], e[0], e[1])):
        if find(i) != find(j):
            up[find(i)] = find(j)
            out.append((i, j, w))
    return out


@pytest.mark.parametrize(("n", "share", "ties"), [(2, 1, False), (12, 1, True), (15, 0.15, False), (20, 1, False)])
def test_trees_equal_kruskal(spark, n, share, ties):
    rows = random_graph(n, n, share, ties) or [("a", "b", 1.0)]
    df = edges(spark, rows + [("n00", "zz", None), ("n01", "zy", math.nan)])
    want = kruskal(rows)
    assert [(r.i, r.j, r.w) for r in graph.spanning_trees(df).orderBy("step").collect()] == want
    assert sorted((r.i, r.j, r.w) for r in graph.boruvka(df).collect()) == sorted(want)


def test_empty_graph(spark):
    none = edges(spark, [])
    assert graph.spanning_trees(none).count() == 0
    assert graph.boruvka(none).count() == 0
    assert graph.largest_component(none).count() == 0


def test_isolated_and_components(spark):
    four = [(a, b, 1.0) for k, a in enumerate("abcd") for b in "abcd"[k + 1 :]]
    df = edges(spark, [*four, ("d", "e", 1.0), ("x", "y", 1.0)])
    assert {(r.i, r.j) for r in graph.drop_isolated(df, 3).collect()} == {(a, b) for a, b, _ in four}
    assert {r.node for r in graph.largest_component(df).collect()} == set("abcde")
    tied = edges(spark, [("c", "d", 1.0), ("a", "b", 2.0)])
    assert {r.node for r in graph.largest_component(tied).collect()} == {"a", "b"}


def test_path_metrics_on_a_known_tree(spark):
    tree = graph.spanning_trees(edges(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("b", "d", 3.0), ("d", "e", 4.0)])).cache()
    paths = graph.tree_paths(tree).cache()
    got = {(r.src, r.dst): (r.hops, r.length, r.longest) for r in paths.collect()}
    assert len(got) == 20
    below = graph.branches(tree)
    assert {(r.node, r.branch): (r["size"], r.hops, r.length) for r in below.collect()} == {("a", "b"): (4, 3, 8.0), ("b", "c"): (1, 1, 2.0), ("b", "d"): (2, 2, 7.0), ("d", "e"): (1, 1, 4.0)}
    assert got["a", "e"] == (3, 8.0, 4.0)
    assert {r.node: round(r.betweenness, 6) for r in graph.betweenness(below).collect()} == {"a": 0, "b": round(5 / 6, 6), "c": 0, "d": 0.5, "e": 0}
    assert tuple(graph.hubs(graph.degrees(tree), graph.betweenness(below)).first()) == ("b", 3, False)
    m = graph.tree_metrics(tree, below).first()
    assert (m.n_edges, m.sum_w, m.diameter_hops, m.diameter_weighted, m.max_degree) == (4, 10.0, 3, 9.0, 3)
    assert [(r.a, r.b, r["size"]) for r in tree.orderBy("step").collect()] == [(0, 1, 2), (2, 5, 3), (3, 6, 4), (4, 7, 5)]


@pytest.mark.parametrize(("n", "share"), [(2, 1), (14, 1), (18, 0.12)])
def test_metrics_from_branches_equal_those_from_all_paths(spark, n, share):
    rows = [("g", *e) for e in random_graph(n, n, share)] + [(None, *e) for e in random_graph(9, 50)]
    tree = graph.spanning_trees(spark.createDataFrame(rows, "g string, " + EDGES), ("g",)).cache()
    paths = graph.tree_paths(tree, ("g",)).cache()
    below = graph.branches(tree, ("g",))
    far = paths.groupBy("g").agg(F.avg("hops").alias("h"), F.avg("length").alias("l"), F.max("hops").alias("dh"), F.max("length").alias("dl"))
    want = {r.g: (r.h, r.l, r.dh, r.dl) for r in far.collect()}
    got = {r.g: (r.apl_hops, r.apl_weighted, r.diameter_hops, r.diameter_weighted) for r in graph.tree_metrics(tree.where("g is not null"), below, ("g",)).collect()}
    assert set(got) == {"g"}
    assert got["g"] == pytest.approx(want["g"])
    ways = {(r.src, r.dst): r.hops for r in paths.where("g is not null").collect()}
    nodes = sorted({s for s, _ in ways})
    for r in graph.betweenness(below, ("g",)).where("g is not null").collect():
        mine = {d for s, d in ways if s == r.node}
        pairs = [(a, b) for a in mine for b in mine if a < b]
        crossed = sum(ways[a, r.node] + ways[r.node, b] == ways[a, b] for a, b in pairs)
        assert r.betweenness == pytest.approx(crossed / len(pairs) if pairs else 0.0)
    assert len(nodes) == graph.betweenness(below, ("g",)).where("g is not null").count()


def test_large_graphs_give_the_rows_of_small_ones(spark, monkeypatch):
    df = edges(spark, random_graph(20, 31, 0.1) + [("zx", "zy", 0.5)]).cache()
    folds = [sorted(map(tuple, f(df).collect())) for f in (graph.spanning_trees, graph.components)]
    monkeypatch.setattr(graph, "FOLD_EDGES", 5)
    assert [sorted(map(tuple, f(df).collect())) for f in (graph.spanning_trees, graph.components)] == folds


def test_ultrametric_is_below_distance(spark):
    df = edges(spark, random_graph(12, 7)).cache()
    u = graph.ultrametric(graph.spanning_trees(df))
    joined = df.join(u, ["i", "j"]).collect()
    assert len(joined) == 66
    assert all(r.u <= r.w + 1e-12 for r in joined)
    h = {frozenset((r.i, r.j)): r.u for r in joined}
    names = sorted({x for p in h for x in p})
    assert all(h[frozenset((a, c))] <= max(h[frozenset((a, b))], h[frozenset((b, c))]) for a in names for b in names for c in names if len({a, b, c}) == 3)


def frame(spark, wide):
    rows = [(t, n, float(v)) for n in wide for t, v in enumerate(wide[n]) if v is not None and not math.isnan(v)]
    return spark.createDataFrame(rows, "t int, node string, r double")


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10_000))
def test_distances_against_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.integers(0, 6, (40, 4)).astype(float), columns=list("abcd"))
    wide[rng.random(wide.shape) < 0.2] = np.nan
    wide["z"] = 1.0
    df = frame(spark, wide)
    for f, how in ((distance.mantegna, "pearson"), (distance.spearman, "spearman")):
        got = {(r.i, r.j): r.w for r in f(df, 25).collect()}
        for k, a in enumerate(wide):
            for b in list(wide)[k + 1 :]:
                both = wide[[a, b]].dropna()
                both = both.rank() if how == "spearman" else both
                rho = both[a].corr(both[b]) if len(both) >= 25 and both[a].nunique() > 1 and both[b].nunique() > 1 else np.nan
                assert (got[a, b] is None) == np.isnan(rho)
                if got[a, b] is not None:
                    assert abs(got[a, b] - math.sqrt(max(0, 2 * (1 - rho)))) < 1e-9
                    assert 0 <= got[a, b] <= 2


def test_symbols_and_thresholds(spark):
    df = frame(spark, {"a": list(range(31)), "same": [2.0] * 40, "few": [1.0] * 29})
    limits = symbols.thresholds(df, (1 / 3, 2 / 3), 30)
    assert {r.node for r in limits.collect()} == {"a", "same"}
    got = symbols.symbolize(df, limits).groupBy("node", "symbol").count().collect()
    assert {(r.node, r.symbol): r["count"] for r in got} == {("a", 1): 10, ("a", 2): 11, ("a", 3): 10, ("same", 2): 40}
    pair = spark.createDataFrame([(t, n, s) for n, v in (("a", [1, 2, 3, 1]), ("b", [1, 3, 1, None])) for t, s in enumerate(v) if s], "t int, node string, symbol int")
    assert distance.symbolic(pair, 3).first().w == pytest.approx(math.sqrt(2 / 3))
    assert distance.symbolic(pair, 3, ordinal=True).first().w == pytest.approx(math.sqrt(1.5 / 3))
    assert distance.symbolic(pair, 4).first().w is None


def test_panel_operators(spark):
    d = [f"2020-01-{k:02d}" for k in range(1, 7)]
    rows = [(d[0], "a", 1.0), (d[1], "a", 2.0), (d[2], "a", None), (d[3], "a", 4.0), (d[4], "a", 8.0), (d[4], "a", 9.0), (d[5], "a", math.nan), *[(x, "b", 1.0) for x in d], (d[0], "c", -1.0), (None, "c", 1.0)]
    prices = panel.clean_prices(spark.createDataFrame(rows, "date string, node string, price double").withColumn("date", F.col("date").cast("date")))
    r = {(str(x.date)[-2:], x.node): x.r for x in panel.log_returns(prices).collect()}
    assert {k: v for k, v in r.items() if k[1] == "a"} == {("02", "a"): pytest.approx(math.log(2)), ("05", "a"): pytest.approx(math.log(2))}
    got = {x.node: (round(x.coverage, 4), x.sector, x.included) for x in panel.coverage(prices, 0.8).collect()}
    assert got == {"a": (0.6667, "Other", False), "b": (1.0, "Other", True)}
    assert {x.node for x in panel.filter_by_coverage(prices, 0.8).collect()} == {"b"}


def test_splice(spark):
    rows = [("n", 1, 1, 10.0), ("n", 1, 2, 20.0), ("n", 2, 2, 4.0), ("n", 2, 3, 6.0), ("n", 3, 4, 3.0), ("bad", 1, 1, 5.0), ("bad", 2, 2, None)]
    df = spark.createDataFrame(rows, "node string, seg_no int, date int, price double")
    got = {(r.node, r.date): round(r.price, 9) for r in panel.splice(df).collect()}
    # segment 2 is scaled by 3/6, segment 1 by that times 4/20; on date 2 the earlier one holds
    assert got == {("n", 1): 1.0, ("n", 2): 2.0, ("n", 3): 3.0, ("n", 4): 3.0}
    assert {(r.node, r.date) for r in panel.transition_dates(df).collect()} == {("n", 2), ("n", 4), ("bad", 2)}


def test_rolling_equals_windows_one_by_one(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(0, 0.01, (45, 5)), columns=list("abcde"))
    wide.iloc[10:14, 1] = np.nan
    df = frame(spark, wide)
    got = {(r.t_end, r.i, r.j): (r.n_common, r.w) for r in rolling.rolling_mantegna(df, 20, 18).collect()}
    for end in range(19, 45):
        part = {(r.i, r.j): (r.n_common, r.w) for r in distance.mantegna(df.where(F.col("t").between(end - 19, end)), 18).collect()} if end in (19, 25, 33, 44) else {}
        for (i, j), (n, w) in part.items():
            assert got[end, i, j][0] == n
            assert got[end, i, j][1] == (None if w is None else pytest.approx(w, abs=1e-9))
    ends = rolling.window_ends(df.withColumn("date", F.expr("date_add(date'2020-01-01', t)")), 20)
    series = rolling.rolling_ntl(rolling.rolling_mantegna(df, 20, 18), ends, 5, 3)
    seen = {r.t_end: r.status for r in series.collect()}
    assert len(seen) == 26
    assert seen[25] == "isolated"
    assert seen[44] == "ok"
    assert rolling.diagnostics(series).first().total_windows == 26


def test_rolling_ranks_and_symbols_equal_windows_one_by_one(spark):
    rng = random.Random(5)
    gone = {("b", 7), ("d", 30)}
    rows = [(t, n, rng.choice([0.0, 0.5, 1.0, 2.0]) if n == "c" else rng.gauss(0, 1)) for t in range(47) for n in "abcd" if (n, t) not in gone]
    df = spark.createDataFrame(rows, "t int, node string, r double")
    ranks = {(r.t_end, r.i, r.j): (r.n_common, r.w) for r in rolling.rolling_spearman(df, 42, 41).collect()}
    # 41 and 42 values: no quantile falls on a value, where the last bit would decide
    codes = {(r.t_end, r.i, r.j): (r.n_common, r.w) for r in rolling.rolling_symbolic_inwindow(df, 42, (1 / 3, 2 / 3), 30, 41).collect()}
    wide = pd.DataFrame(rows, columns=["t", "node", "r"]).pivot(index="t", columns="node", values="r")
    assert set(ranks) == set(codes) == {(t, i, j) for t in range(41, 47) for i in "abcd" for j in "abcd" if i < j}
    for (t, i, j), (n, w) in ranks.items():
        both = wide.loc[t - 41 : t, [i, j]].dropna()
        assert n == len(both) and (w is None) == (n < 41)
        if w is not None:
            assert w == pytest.approx(math.sqrt(2 * (1 - both[i].rank().corr(both[j].rank()))), abs=1e-9)
    for (t, i, j), (n, w) in codes.items():
        part = wide.loc[t - 41 : t, [i, j]]
        symbol = part.apply(lambda c: c.map(lambda v, lo=c.quantile(1 / 3), hi=c.quantile(2 / 3): v if v != v else 1 if v < lo else 2 if v <= hi else 3))
        both = symbol.dropna()
        assert n == len(both) and (w is None) == (n < 41)
        if w is not None:
            assert w == pytest.approx(math.sqrt((both[i] != both[j]).mean()), abs=1e-9)


def test_series_correlation_needs_shared_windows(spark):
    rows = [("a", t, float(t)) for t in range(20)] + [("b", t, -2.0 * t) for t in range(20)] + [("c", t, 1.0) for t in range(20)] + [("d", t, float(t)) for t in range(10)] + [("a", 30, None)]
    got = {r.pair: (r.n_shared, r.r) for r in robustness.series_correlation(spark.createDataFrame(rows, "method string, t_end int, ntl double")).collect()}
    assert got["a-b"] == (20, pytest.approx(-1.0)) and got["a-c"] == (20, None) and got["a-d"] == (10, None)


def test_episodes(spark):
    v = [5, 5, 1, 1, None, 1, -5, 5, 0, 5]
    rows = [(k, None if x is None else float(x), 0.0, 2.0) for k, x in enumerate(v)]
    got = sorted(tuple(r)[:4] for r in rolling.episodes(spark.createDataFrame(rows, "t_end int, ntl double, low double, high double")).collect())
    assert got == [(0, 1, 2, "fragmentation"), (6, 7, 2, "integration"), (9, 9, 1, "fragmentation")]


def test_leave_one_out_against_new_trees(spark):
    rows = random_graph(9, 21)
    got = {r.excluded: r for r in robustness.leave_one_out(edges(spark, rows), 3).collect()}
    whole = {(i, j) for i, j, _ in kruskal(rows)}
    for node, r in got.items():
        tree = kruskal([e for e in rows if node not in e[:2]])
        new, old = {(i, j) for i, j, _ in tree}, {e for e in whole if node not in e}
        assert r.new_ntl == pytest.approx(sum(w for *_, w in tree) / len(tree))
        assert r.jaccard == pytest.approx(len(new & old) / len(new | old))


def test_nulls_keep_each_node_s_values(spark):
    rng = np.random.default_rng(1)
    wide = pd.DataFrame(rng.normal(size=(30, 3)), columns=list("abc"))
    wide.iloc[3:9, 0] = np.nan
    df = frame(spark, wide)
    for kind in ("permutation", "circular_shift", "phase"):
        got = resample.null_panel(df, 3, kind).toPandas()
        for rep in (1, 2, 3):
            for n in wide:
                mine = got[(got.rep == rep) & (got.node == n)].sort_values("t")
                x = wide[n].dropna()
                assert mine.t.tolist() == x.index.tolist()
                if kind == "phase":
                    assert np.allclose(np.abs(np.fft.rfft(mine.r)), np.abs(np.fft.rfft(x)))
                else:
                    assert sorted(mine.r) == sorted(x)
                if kind == "circular_shift":
                    assert any(np.allclose(np.roll(x, k), mine.r) for k in range(len(x)))
        again = resample.null_panel(df.repartition(7), 3, kind).toPandas()
        pd.testing.assert_frame_equal(*(f.sort_values(["rep", "node", "t"]).reset_index(drop=True) for f in (got, again)))


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.03]
    got = resample.adjusted(spark.createDataFrame([(k, x) for k, x in enumerate([*p, None])], "k int, p double"), "p").orderBy("k").collect()
    order = np.argsort(p)
    bh, holm = np.empty(6), np.empty(6)
    low, high = 1.0, 0.0
    for rank in range(6, 0, -1):
        low = min(low, p[order[rank - 1]] * 6 / rank)
        bh[order[rank - 1]] = low
    for rank in range(6):
        high = max(high, min(1, (6 - rank) * p[order[rank]]))
        holm[order[rank]] = high
    assert np.allclose([r.p_bh for r in got[:6]], bh)
    assert np.allclose([r.p_holm for r in got[:6]], holm)
    assert got[6].p_bh is None
    assert all(r.p_holm >= r.p for r in got[:6])


def test_order_statistics(spark):
    observed = spark.createDataFrame([(1, 0.5), (2, 2.0)], "rank int, w double")
    null = spark.createDataFrame([(k, r, float(k)) for k in range(1, 10) for r in (1, 2)], "rep int, rank int, w double")
    got = {r["rank"]: r for r in resample.order_statistic_test(observed, null).collect()}
    assert got[1].p_one == pytest.approx(1 / 10)
    assert got[1].p_two == pytest.approx(2 / 10)
    assert got[2].p_one == pytest.approx(3 / 10)
    assert got[1].null_mean == 5


def test_random_trees_and_perturbation(spark):
    d = resample.random_tree_degrees(spark, 12, 50).groupBy("rep").agg(F.sum("degree").alias("s"), F.min("degree").alias("m")).collect()
    assert {(r.s, r.m) for r in d} == {(22, 1)}
    assert resample.random_tree_degrees(spark, 2, 3).agg(F.sum("degree")).first()[0] == 6
    df = edges(spark, random_graph(8, 2)).cache()
    moved = resample.perturbed(df, (1, 5), 4).join(df.withColumnRenamed("w", "w0"), ["i", "j"]).groupBy("k", "rep").agg(F.count_if(F.col("w") != F.col("w0")).alias("n")).collect()
    assert all(r.n == r.k for r in moved)
    row = resample.perturbation_robustness(df, (1,), 20).first()
    assert row.n_replicas == 20
    assert 0 < row.jaccard_min <= row.jaccard_mean <= 1


def test_degree_test(spark):
    trees = resample.replicas(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("b", "d", 1.0)]), 5)
    tree = trees.where("rep = 1").drop("rep")
    got = {r.null_model: r for r in resample.degree_test(tree, trees, 40).collect()}
    assert got["null_panel"].p_max_degree == 1
    assert (got["uniform_tree"].n_null, got["uniform_tree"].max_degree, got["uniform_tree"].n_nodes) == (40, 3, 4)
    assert all(r.p_entropy_holm >= r.p_entropy for r in got.values())
    none = resample.degree_test(tree.limit(0), trees, 5)
    assert none.count() == 0
    assert none.columns == list(next(iter(got.values())).asDict())


def test_bootstrap_blocks(spark):
    assert [resample.block_length(n) for n in (4, 100, 1000)] == [2, 5, 10]
    rows = resample.block_dates(53, 4, spark).toPandas().sort_values(["rep", "t"])
    for _, g in rows.groupby("rep"):
        assert g.t.tolist() == list(range(53))
        assert (np.diff(g.src)[np.arange(52) % 5 != 4] == 1).all()
        assert g.src.between(0, 52).all()


def test_rolling_runs_have_every_method_and_window(spark):
    import datetime as dt

    import numpy as np

    from tidegraph.operators import rolling
    from tidegraph.plans import network as net

    assert {"rolling_ntl_runs", "rolling_diagnostics_runs", "seasonality_cv_runs", "band_episodes_runs", "hub_stability_runs", "hub_summary_runs"} <= set(net.QUERIES)
    x = np.random.default_rng(3).normal(0, 0.01, (40, 5))
    returns = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(t), t, f"n{k}", float(x[t, k])) for t in range(40) for k in range(5)], "date date, t int, node string, r double")
    step = lambda edges, ends, n: rolling.rolling_ntl(edges, ends, n, net.C.min_peers)
    rows = net.rolling_runs(returns, step, ("mantegna", "spearman"), (36, 38, 50)).collect()
    got = {(r.method, r.window, r.t_end): r.ntl for r in rows}
    assert set(got) == {(m, w, t) for m in ("mantegna", "spearman") for w in (36, 38) for t in range(w - 1, 40)}
    alone = rolling.rolling_ntl(rolling.rolling_spearman(returns, 38, net.C.common(38)), rolling.window_ends(returns, 38), 5, net.C.min_peers)
    assert {r.t_end: r.ntl for r in alone.collect()} == pytest.approx({t: v for (m, w, t), v in got.items() if (m, w) == ("spearman", 38)})
    assert net.C.windows == (120, 240, 360, 480)


@pytest.mark.parametrize("method", ["mantegna", "spearman", "symbolic"])
def test_replica_distances_equal_the_joins(spark, monkeypatch, method):
    rng = np.random.default_rng(11)
    rows = []
    for rep in (1, 2):
        for node in "abcdef":
            for t in range(40):
                if node in "abc" or rng.random() > 0.25:
                    r = 1.0 if node == "c" else float(rng.integers(0, 9))
                    rows.append((rep, t, node, r, int(r) % 3 + 1))
    rows += [(2, t, "z", 1.5, 1) for t in (100, 101)]  # no date in common
    df = spark.createDataFrame(rows, "rep int, t int, node string, r double, symbol int")
    told = lambda d: {(x.rep, x.i, x.j): (x.n_common, None if x.w is None else round(x.w, 9)) for x in d.collect()}
    compact = told(distance.replica_distances(df, method, 25, 100))
    assert compact == told(distance.replica_distances(df, method, 25, distance.PANEL_VALUES + 1))
    assert any(w is None for _, w in compact.values())
    assert distance.replica_distances(df.limit(0), method, 25, 0).count() == 0


def test_adjusted_close_and_export(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 9.0), (None, 2.0, 9.0), (math.nan, 3.0, 9.0), (None, None, 9.0)], "adj double, close_adj double, close double")
    assert [r.price for r in panel.adjusted_close(rows, "adj", "close_adj").collect()] == [1.0, 2.0, 3.0, None]
    series = spark.createDataFrame([(0, "2020-01-03", 1.0), (1, "2020-01-10", None), (2, "2020-01-17", 2.0)], "t_end int, date string, ntl double")
    band = spark.createDataFrame([(0, 0.5, 1.5)], "t int, low double, high double")
    assert sorted(map(tuple, rolling.banded_series(series, band).collect())) == [("2020-01-03", 1.0, 0.5, 1.5), ("2020-01-17", 2.0, None, None)]


def test_snapshot_row(spark):
    tree = graph.spanning_trees(edges(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0)]))
    assert tuple(robustness.snapshot_row(tree).first()) == ("b", 2, True, "c", "b", 2 / 3, "a-b", 1.0, "c-d", 3.0)


def test_leave_out_named_and_what_falls_off(spark):
    # without the middle, the tail is no longer part of the largest component
    rows = [("a", "b", 1.0), ("b", "c", 1.1), ("a", "c", 1.2), ("c", "m", 2.0), ("m", "y", 2.1), ("y", "z", 2.2)]
    got = robustness.leave_one_out(edges(spark, rows), nodes=["m", "nobody"]).collect()
    assert [(r.excluded, r.degree, r.n_edges) for r in got] == [("m", 2, 2)]
