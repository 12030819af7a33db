import numpy as np
import pytest

from tidegraph.operators import membership, regression, resample, timeseries
from tidegraph.sources import tables


def matrix_edges(spark, n=10, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            x1, x2 = map(float, rng.normal(size=2))
            rows.append((f"n{a}", f"n{b}", 2 * x1 - 0.1 * x2 + float(rng.normal(0, 0.5)), x1, x2, float((a + b) % 2)))
    return spark.createDataFrame(rows, "i string, j string, y double, x1 double, x2 double, s double").cache(), np.array([r[2:] for r in rows])


def test_coefficients_against_least_squares(spark):
    df, m = matrix_edges(spark)
    beta, t, r2 = regression.coefficients(df, "y", ["x1", "x2"])
    z = np.column_stack([np.ones(len(m)), m[:, 1], m[:, 2]])
    want = np.linalg.lstsq(z, m[:, 0], rcond=None)[0]
    e = m[:, 0] - z @ want
    se = np.sqrt(e @ e / (len(m) - 3) * np.diag(np.linalg.inv(z.T @ z)))
    assert np.allclose(beta, want)
    assert np.allclose(t, want / se)
    assert r2 == pytest.approx(1 - e @ e / np.sum((m[:, 0] - m[:, 0].mean()) ** 2))
    assert regression.vif(df, "x1", []) == 1
    assert regression.vif(df.withColumn("x3", df.x1 * 2), "x1", ["x3"]) == float("inf")


def test_relabelling_permutes_nodes(spark):
    df, _ = matrix_edges(spark, 6)
    moved = regression.relabelled(df, "y", 4).collect()
    original = sorted(r.y for r in df.collect())
    for rep in range(1, 5):
        mine = [r for r in moved if r.rep == rep]
        assert sorted(r.y for r in mine) == original
        assert len({(r.i, r.j) for r in mine}) == len(original)
        assert all(r.i < r.j for r in mine)


def test_mrqap_finds_the_effect(spark):
    df, _ = matrix_edges(spark)
    for f in (regression.mrqap_dsp, regression.mrqap_freedman_lane):
        got = {r.predictor: r for r in f(df, "y", ["x1", "x2"], 60).collect()}
        assert got["x1"].p == pytest.approx(1 / 61)
        assert got["x1"].beta == pytest.approx(2, abs=0.3)
        assert got["x2"].p > 1 / 61
    row = regression.residual_analysis(df, "y", ["x1", "x2"], "s", 40).first()
    assert 0 < row.p <= 1
    assert 0.8 < row.r2 < 1


def test_unit_root_tests_tell_kinds_apart():
    rng = np.random.default_rng(5)
    said = {k: [] for k in ("noise", "walk", "trend")}
    for _ in range(12):
        e = rng.normal(size=400)
        said["noise"].append(timeseries.test_row(e)[-1])
        said["walk"].append(timeseries.test_row(np.cumsum(e))[-1])
        said["trend"].append(timeseries.test_row(0.05 * np.arange(400) + e)[-1])
    assert said["noise"].count("level_stationary") >= 9
    assert said["walk"].count("level_stationary") <= 1
    assert said["trend"].count("level_stationary") <= 3
    assert timeseries.test_row(np.arange(10.0))[-1] == "insufficient"
    assert timeseries.test_row(np.ones(50))[-1] == "inconclusive"
    assert timeseries.conclusion("unit_root", "stationary") == "trend_stationary"
    # 5 % points of the two tests
    assert timeseries.ADF_SURFACE["c"][0] == -1.61
    assert timeseries.kpss(np.cumsum(rng.normal(size=300)))[0] > 0.463


@pytest.mark.parametrize("said", ["level_stationary", "trend_stationary", "unit_root_I1", "inconclusive"])
def test_bands(spark, said):
    x = np.sin(np.arange(60) / 5) + 0.02 * np.arange(60)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(99, None)], "t int, value double")
    rows = timeseries.bootstrap_band(df, said, 50).orderBy("t").collect()
    assert [r.t for r in rows] == list(range(60))
    assert all(r.low <= r.high for r in rows)
    assert rows[0].scheme == (said if said != "inconclusive" else "unit_root_I1 (FALLBACK)")
    if "I1" in rows[0].scheme:
        assert rows[0].low == rows[0].high == pytest.approx(x[0])
    with pytest.raises(ValueError):
        timeseries.bootstrap_band(df.limit(5), said, 5)


def test_turnover(spark):
    rows = [("X", 1, "2020-01-01", "a"), ("X", 1, "2020-01-01", "b"), ("X", 2, "2020-08-31", "b"), ("X", 2, "2020-08-31", "c"), ("X", 3, "2021-04-01", "b"), ("Y", 1, "2020-01-01", "a")]
    df = spark.createDataFrame(rows, "index_code string, n int, d string, ticker string").selectExpr("index_code", "n", "cast(d as date) as effective_date", "ticker")
    got = [(str(r.period_end), r.n_add, r.n_drop, r.added, r.dropped, r.n_members, r.spans_gap) for r in membership.turnover(df, "ticker").orderBy("period_end").collect()]
    assert got == [("2020-08-31", 1, 1, "c", "a", 2, False), ("2021-04-01", 0, 1, "", "c", 1, True)]
    seen = {r.ticker: (r.n_present, r.is_current) for r in membership.membership_summary(df.where("index_code = 'X'"), "ticker").collect()}
    assert seen == {"a": (1, False), "b": (3, True), "c": (1, False)}


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('effective_date,source,source_file,n_tickers,tickers\n2020-02-01,s,f,2,"A;B;"\n2020-01-01,"s, ""q""",f,1,A\n')
    rows = tables.read_membership(spark, str(tmp_path / "m.csv")).collect()
    assert [r.members for r in rows] == [["A"], ["A", "B"]]
    assert rows[0].source == 's, "q"'
    (tmp_path / "bad.csv").write_text("effective_date,source,source_file,n_tickers,tickers\n2020-02-01,s,f,3,A;B\n")
    with pytest.raises(Exception, match="declared count"):
        tables.read_membership(spark, str(tmp_path / "bad.csv")).collect()
    wide = tables.wide_matrix(spark.createDataFrame([("a", "b", 1.5), ("a", "c", 2.5)], "i string, j string, w double")).collect()
    assert [(r.node, r.a, r.b, r.c) for r in wide] == [("a", 0.0, 1.5, 2.5), ("b", 1.5, 0.0, None), ("c", 2.5, None, 0.0)]
    tables.write_csv(spark.createDataFrame([("é", 1)], "x string, y int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().x == "é"
    assert tables.as_json_rows(spark.createDataFrame([("k", 1)], "x string, y int"), ["x"]).first().json == '{"y":1}'
    tables.write_manifest(str(tmp_path / "m.json"), {"a": 1}, {"b": object})
    assert (tmp_path / "m.json").read_text().startswith("{")


def test_registered_queries_take_the_full_number_of_replicas():
    import inspect

    from tidegraph.plans import inference
    from tidegraph.plans.config import Config

    assert inspect.signature(inference._spanning).parameters["n"].default == Config().replicas == 1000
    assert (Config().random_trees, Config().band_replicas) == (10_000, 2000)
    for query, number in (
        (inference._support, "net.C.replicas"), (inference.mrqap_dsp, "net.C.replicas"), (inference.mrqap_freedman_lane, "net.C.replicas"), (inference.symbolic_residuals, "net.C.replicas"),
        (inference.symbolic_non_redundancy, "net.C.replicas"), (inference.degree_distribution_test, "net.C.random_trees"), (inference.ntl_band, "net.C.band_replicas"), (inference._bands, "net.C.band_replicas"),
    ):
        assert number in inspect.getsource(query)


def test_replicas_without_a_whole_tree_are_drawn_again(spark, monkeypatch):
    from tidegraph.plans import inference
    from tidegraph.plans import network as net

    monkeypatch.setattr(net, "C", net.Config(min_common=5, min_peers=1, attempts=3))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(t, n, float(v)) for n in "abcd" for t, v in enumerate(rng.normal(size=30))], "t int, node string, r double")
    # every other replica lacks a node
    draw = lambda n, first: resample.null_panel(df, n, "permutation", first=first).where("node != 'd' or rep % 2 = 0")
    trees = inference._spanning(df, draw, "mantegna", 8)
    assert trees.select("rep").distinct().count() >= 8 * 0.6
    assert all(r.rep % 2 == 0 for r in trees.select("rep").distinct().collect())
    assert {r["count"] for r in trees.groupBy("rep").count().collect()} == {3}
    with pytest.raises(ValueError, match="replicas"):
        inference._spanning(df, lambda n, first: draw(n, first).where("rep = 2"), "mantegna", 8)
