"""Queries of the dependence-network operators and their SQL.

The panels come from the star schema: a node's price is the mean price a unit of its line items in a week. ``brand`` has the
part brands as nodes, ``nation`` the suppliers' nations with the regions as sectors. Prices are rounded to 6 places so that the order of summation can't show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import distance, graph, membership, panel, robustness, rolling, symbols
from tidegraph.operators.snapshot_diff import issuer_members
from tidegraph.operators.versions import snapshot_members
from tidegraph.plans.config import Config
from tidegraph.plans.problems import _SNAPSHOTS
from tidegraph.plans.runtime import cut_lineage
from tidegraph.sources.tables import table

C = Config()
WINDOW = 120  #: of the queries of one run; the queries ..._runs have all of C.windows
SPECS = ("mantegna", "spearman", "symbolic", "symbolic_inwindow")
PARTITIONS = [("thirds", 1 / 3, 2 / 3), ("quarters", 0.25, 0.75), ("narrow", 0.4, 0.6), ("wide", 0.2, 0.8), ("skewed", 0.3, 0.8)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Rounded doubles; minus nought is nought."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


# ---------------------------------------------------------------- panels


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
    joined = items.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("node")), "l_partkey")
    return joined.groupBy("date", "node").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"))


def nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    of = of.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("node"), F.col("r_name").alias("sector"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
    return items.join(of, "l_suppkey").groupBy("date", "node", "sector").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"))


def brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row a week and brand, written to the checkpoint folder: every later step reads it more than once."""
    return cut_lineage(panel.log_returns(cut_lineage(panel.clean_prices(brand_prices(spark, sf_dir)))))


def nation_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = panel.filter_by_coverage(cut_lineage(panel.clean_prices(nation_prices(spark, sf_dir))), 0.9)
    return cut_lineage(panel.log_returns(kept))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("sector"))


def brand_symbols(returns: DataFrame, quantiles: tuple[float, float] = C.quantiles) -> DataFrame:
    return symbols.symbolize(returns, symbols.thresholds(returns, quantiles, C.min_symbol_obs))


def distances(returns: DataFrame, method: str, min_common: int = C.min_common) -> DataFrame:
    if method == "mantegna":
        return distance.mantegna(returns, min_common)
    if method == "spearman":
        return distance.spearman(returns, min_common)
    return distance.symbolic(brand_symbols(returns), min_common, ordinal=method == "ordinal")


def backbone(edges: DataFrame) -> DataFrame:
    """Finite edges between nodes with enough peers, within the largest component."""
    met = cut_lineage(graph.drop_isolated(cut_lineage(edges), C.min_peers))  # pairs of nodes; read several times
    inside = graph.largest_component(met)
    return met.join(inside.withColumnRenamed("node", "i"), "i", "left_semi").join(inside.withColumnRenamed("node", "j"), "j", "left_semi")


METHODS = ("mantegna", "spearman", "symbolic")

BRAND = """brandp AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS node, round(avg(l_extendedprice / l_quantity), 6) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
NATION = """nationall AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS node, r_name AS sector, round(avg(l_extendedprice / l_quantity), 6) AS price
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
cov AS (SELECT node, count(DISTINCT date) / (SELECT count(DISTINCT date) FROM nationall) AS coverage, count(DISTINCT date) AS n_valid_days FROM nationall GROUP BY 1),
nationp AS (SELECT date, node, price FROM nationall WHERE node IN (SELECT node FROM cov WHERE coverage >= 0.9))"""


def _returns(source: str) -> str:
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM {source})),
moved AS (SELECT date, node, ln(price) - lag(ln(price)) OVER w AS r, t - lag(t) OVER w AS step FROM {source} JOIN cal USING (date) WINDOW w AS (PARTITION BY node ORDER BY t)),
rcal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM moved WHERE step = 1)),
ret AS (SELECT date, t, node, r FROM moved JOIN rcal USING (date) WHERE step = 1)"""


def _symbols(name: str = "sym", low: float = 1 / 3, high: float = 2 / 3) -> str:
    return f"""lim{name} AS (SELECT node, quantile_cont(r, {low!r}) AS a, quantile_cont(r, {high!r}) AS b FROM ret GROUP BY node HAVING count(*) >= 30),
{name} AS (SELECT date, t, node, r, CASE WHEN r < a THEN 1 WHEN r <= b THEN 2 ELSE 3 END AS symbol FROM ret JOIN lim{name} USING (node))"""


_RHO = "covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0)"
_W = "CASE WHEN n_common >= {m} THEN sqrt(greatest(0, 2 * (1 - greatest(-1, least(1, rho))))) END"


def _distance(method: str, m: int = C.min_common, name: str = "d", sym: str = "sym") -> str:
    pairs = "SELECT a.t, a.node AS i, b.node AS j, a.{v} AS x, b.{v} AS y FROM {s} a JOIN {s} b ON a.t = b.t AND a.node < b.node"
    if method == "mantegna":
        return f"{name} AS (SELECT i, j, n_common, {_W.format(m=m)} AS w FROM (SELECT i, j, count(*) AS n_common, {_RHO} AS rho FROM ({pairs.format(v='r', s='ret')}) GROUP BY i, j))"
    if method == "spearman":
        rank = "rank() OVER (PARTITION BY i, j ORDER BY {c}) + (count(*) OVER (PARTITION BY i, j, {c}) - 1) / 2"
        ranked = f"SELECT i, j, {rank.format(c='x')} AS x, {rank.format(c='y')} AS y FROM ({pairs.format(v='r', s='ret')})"
        return f"{name} AS (SELECT i, j, n_common, {_W.format(m=m)} AS w FROM (SELECT i, j, count(*) AS n_common, {_RHO} AS rho FROM ({ranked}) GROUP BY i, j))"
    off = "sum(abs(x - y)) / 2" if method == "ordinal" else "count(*) FILTER (x <> y)"
    return f"{name} AS (SELECT i, j, n_common, CASE WHEN n_common >= {m} THEN sqrt(off / n_common) END AS w FROM (SELECT i, j, count(*) AS n_common, {off} AS off FROM ({pairs.format(v='symbol', s=sym)}) GROUP BY i, j))"


def _tree(source: str = "d", name: str = "tree", keys: str = "") -> str:
    """Prim from the smallest node of each key, with the order (w, i, j)."""
    k = f"{keys}, " if keys else ""
    pk = f"p.{keys}, " if keys else ""
    on = f"e.{keys} = p.{keys} AND " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}e AS (SELECT {k}i, j, w FROM {source} WHERE w IS NOT NULL),
{name}p AS (SELECT {k}[min(i)] AS seen, CAST(NULL AS STRUCT(w DOUBLE, i VARCHAR, j VARCHAR)) AS e FROM {name}e {group} UNION ALL
 SELECT {k}list_append(seen, CASE WHEN list_contains(seen, e.i) THEN e.j ELSE e.i END), e FROM
  (SELECT {pk}p.seen, min({{'w': e.w, 'i': e.i, 'j': e.j}}) AS e FROM {name}p p JOIN {name}e e ON {on}list_contains(p.seen, e.i) <> list_contains(p.seen, e.j) GROUP BY ALL)),
{name} AS (SELECT {k}e.i AS i, e.j AS j, e.w AS w FROM {name}p WHERE e IS NOT NULL)"""


def _paths(source: str = "tree", name: str = "paths", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    pk = f"p.{keys}, " if keys else ""
    on = f"s.{keys} = p.{keys} AND " if keys else ""
    return f"""{name}s AS (SELECT {k}i AS u, j AS v, w FROM {source} UNION ALL SELECT {k}j, i, w FROM {source}),
{name} AS (SELECT {k}u AS src, u AS prev, v AS dst, 1 AS hops, w AS length, w AS longest FROM {name}s UNION ALL
 SELECT {pk}p.src, p.dst, s.v, p.hops + 1, p.length + s.w, greatest(p.longest, s.w) FROM {name} p JOIN {name}s s ON {on}s.u = p.dst AND s.v <> p.prev)"""


def _degrees(source: str = "tree", name: str = "deg", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {k}node, count(*) AS degree FROM (SELECT {k}i AS node FROM {source} UNION ALL SELECT {k}j FROM {source}) GROUP BY ALL)"


def _between(paths: str = "paths", name: str = "btw", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f"a.{keys} = b.{keys} AND a.{keys} = c.{keys} AND " if keys else ""
    ka = f"a.{keys}, " if keys else ""
    join = f"q.{keys} = n.{keys} AND " if keys else ""
    nk = f"n.{keys}, " if keys else ""
    return f"""{name}q AS (SELECT {ka}b.src AS node, count(*) AS crossed FROM {paths} a, {paths} b, {paths} c
 WHERE {on}a.src < a.dst AND b.dst = a.dst AND c.src = a.src AND c.dst = b.src AND c.hops + b.hops = a.hops GROUP BY ALL),
{name}n AS (SELECT {k}src AS node, count(*) AS others FROM {paths} GROUP BY ALL),
{name} AS (SELECT {nk}n.node, coalesce(coalesce(crossed, 0) / nullif(others * (others - 1) / 2, 0), 0) AS betweenness FROM {name}n n LEFT JOIN {name}q q ON {join}q.node = n.node)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_BRET = (BRAND, _returns("brandp"))
_NRET = (NATION, _returns("nationp"))


# ---------------------------------------------------------------- panel operators


@query(_with(BRAND) + "SELECT CAST(date AS VARCHAR) AS date, node, price FROM brandp")
def price_panel(spark, sf_dir):
    return panel.clean_prices(brand_prices(spark, sf_dir)).select(F.col("date").cast("string").alias("date"), "node", "price")


@query(_with(NATION) + "SELECT node, round(coverage, 6) AS coverage, sector, coverage >= 0.9 AS included, n_valid_days FROM cov JOIN (SELECT DISTINCT node, sector FROM nationall) USING (node)")
def coverage_filter(spark, sf_dir):
    prices = cut_lineage(nation_prices(spark, sf_dir))
    return _r(panel.coverage(prices, 0.9, prices.select("node", "sector").distinct()), "coverage")


@query(_with(*_NRET) + "SELECT CAST(date AS VARCHAR) AS date, t, node, round(r, 6) AS r FROM ret")
def log_returns(spark, sf_dir):
    return _r(nation_returns(spark, sf_dir), "r").withColumn("date", F.col("date").cast("string"))


_SEGMENTS = """seg AS (SELECT node, date, price * (1 + (year(date) - 1990) / 10.0) AS price, year(date) AS seg_no FROM brandp
 UNION ALL SELECT node, date, price * (1 + (year(date) - 1991) / 10.0), year(date) - 1 FROM brandp WHERE month(date) = 1 AND year(date) > (SELECT min(year(date)) FROM brandp))"""


def _segments(spark, sf_dir) -> DataFrame:
    """The brand panel as yearly segments on scales of their own, each going on through the January that follows."""
    p = cut_lineage(brand_prices(spark, sf_dir))
    y = F.year("date")
    first = p.agg(F.min(y).alias("y0"))
    own = p.select("node", "date", (F.col("price") * (1 + (y - 1990) / 10.0)).alias("price"), y.alias("seg_no"))
    after = p.where(F.month("date") == 1).join(F.broadcast(first)).where(y > F.col("y0")).select("node", "date", (F.col("price") * (1 + (y - 1991) / 10.0)).alias("price"), (y - 1).alias("seg_no"))
    return own.unionByName(after)


@query(
    _with(BRAND, _SEGMENTS)
    + """, ends AS (SELECT node, seg_no, arg_min(price, date) AS first, arg_max(price, date) AS last FROM seg GROUP BY ALL),
step AS (SELECT node, seg_no, coalesce(lead(first) OVER (PARTITION BY node ORDER BY seg_no) / last, 1) AS ratio FROM ends),
fac AS (SELECT node, seg_no, exp(sum(ln(ratio)) OVER (PARTITION BY node ORDER BY seg_no DESC)) AS factor FROM step)
SELECT CAST(date AS VARCHAR) AS date, node, round(arg_min(price * factor, seg_no), 6) AS price FROM seg JOIN fac USING (node, seg_no) GROUP BY date, node"""
)
def spliced_prices(spark, sf_dir):
    return _r(panel.splice(_segments(spark, sf_dir)), "price").withColumn("date", F.col("date").cast("string"))


@query(
    _with(BRAND, _SEGMENTS, _returns("brandp"))
    + """, tr AS (SELECT node, date FROM (SELECT node, seg_no, min(date) AS date, row_number() OVER (PARTITION BY node ORDER BY seg_no) AS k FROM seg GROUP BY node, seg_no) WHERE k > 1)
SELECT CAST(date AS VARCHAR) AS date, node, round(r, 6) AS r FROM ret ANTI JOIN tr USING (node, date)"""
)
def splice_transitions_dropped(spark, sf_dir):
    kept = panel.drop_transitions(brand_returns(spark, sf_dir), panel.transition_dates(_segments(spark, sf_dir)))
    return _r(kept.select(F.col("date").cast("string").alias("date"), "node", "r"), "r")


@query(
    _with(*_BRET)
    + """, m AS (SELECT node, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM ret GROUP BY node),
g AS (SELECT node, n, mu, sd, avg((r - mu) ** 3) / avg((r - mu) ** 2) ** 1.5 AS g1, avg((r - mu) ** 4) / avg((r - mu) ** 2) ** 2 - 3 AS g2 FROM ret JOIN m USING (node) GROUP BY ALL HAVING n >= 30),
j AS (SELECT *, n / 6 * (g1 * g1 + g2 * g2 / 4) AS jb FROM g)
SELECT node, n, round(mu, 6) AS mean_r, round(sd, 6) AS std_r, round(g1 * sqrt(n * (n - 1)) / (n - 2), 6) AS skewness, round(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)), 6) AS excess_kurtosis,
 round(jb, 6) AS jb_stat, round(exp(-jb / 2), 6) AS jb_pval, exp(-jb / 2) >= 0.05 AS normal_5pct FROM j"""
)
def descriptive_stats(spark, sf_dir):
    return _r(panel.descriptive_stats(brand_returns(spark, sf_dir)), "mean_r", "std_r", "skewness", "excess_kurtosis", "jb_stat", "jb_pval")


@query(_with(*_BRET, _symbols()) + "SELECT node, round(a, 6) AS a, round(b, 6) AS b FROM limsym")
def symbol_thresholds(spark, sf_dir):
    return _r(symbols.thresholds(brand_returns(spark, sf_dir), C.quantiles, C.min_symbol_obs), "a", "b")


@query(_with(*_BRET, _symbols()) + "SELECT CAST(date AS VARCHAR) AS date, t, node, symbol FROM sym")
def symbol_panel(spark, sf_dir):
    return brand_symbols(brand_returns(spark, sf_dir)).select(F.col("date").cast("string").alias("date"), "t", "node", "symbol")


# ---------------------------------------------------------------- distances and trees


def _parts(method: str) -> tuple[str, ...]:
    return (*_BRET, *((_symbols(),) if method in ("symbolic", "ordinal") else ()), _distance(method))


def _add_method(method: str) -> None:
    def distance_query(spark, sf_dir):
        return _r(distances(brand_returns(spark, sf_dir), method), "w")

    def mst_query(spark, sf_dir):
        return _r(graph.spanning_trees(backbone(distances(brand_returns(spark, sf_dir), method))), "w").select("step", "i", "j", "w")

    def metrics_query(spark, sf_dir):
        tree = cut_lineage(graph.spanning_trees(backbone(distances(brand_returns(spark, sf_dir), method))))
        return _r(graph.tree_metrics(tree, graph.branches(tree)), "sum_w", "ntl", "apl_hops", "apl_weighted", "diameter_weighted", "assortativity", "degree_entropy")

    def linkage_query(spark, sf_dir):
        return _r(graph.spanning_trees(backbone(distances(brand_returns(spark, sf_dir), method))), "w").select("step", "a", "b", F.col("w").alias("height"), "size")

    def cophenetic_query(spark, sf_dir):
        edges = cut_lineage(backbone(distances(brand_returns(spark, sf_dir), method)))
        return _r(graph.cophenetic_correlation(edges, graph.ultrametric(graph.spanning_trees(edges))), "r_cophenetic")

    def hub_query(spark, sf_dir):
        tree = cut_lineage(graph.spanning_trees(backbone(distances(brand_returns(spark, sf_dir), method))))
        return graph.hubs(graph.degrees(tree), graph.betweenness(graph.branches(tree)))

    parts = _with(*_parts(method))
    tree = f", {_tree()}"
    metrics = f""", {_paths()}, {_degrees()},
ends AS (SELECT a.degree AS x, b.degree AS y FROM pathss s JOIN deg a ON a.node = s.u JOIN deg b ON b.node = s.v),
hist AS (SELECT degree, count(*) / sum(count(*)) OVER () AS p FROM deg GROUP BY degree)
SELECT (SELECT count(*) FROM tree) AS n_edges, round((SELECT sum(w) FROM tree), 6) AS sum_w, round((SELECT avg(w) FROM tree), 6) AS ntl, round(avg(hops), 6) AS apl_hops, round(avg(length), 6) AS apl_weighted,
 max(hops) AS diameter_hops, round(max(length), 6) AS diameter_weighted, round((SELECT covar_pop(x, y) / var_pop(x) FROM ends), 6) + 0.0 AS assortativity,
 round((SELECT -sum(p * log2(p)) FROM hist), 6) AS degree_entropy, (SELECT max(degree) FROM deg) AS max_degree FROM paths"""
    # clusters just before each merge: nodes joined by smaller tree edges
    clusters = f""", {_paths()}, ranked AS (SELECT *, row_number() OVER (ORDER BY w, i, j) AS step, (SELECT count(*) + 1 FROM tree) AS n FROM tree),
steps AS (SELECT i AS u, j AS v, step FROM ranked UNION ALL SELECT j, i, step FROM ranked),
top AS (SELECT u AS src, u AS prev, v AS dst, step AS m FROM steps UNION ALL SELECT p.src, p.dst, s.v, greatest(p.m, s.step) FROM top p JOIN steps s ON s.u = p.dst AND s.v <> p.prev),
pre AS (SELECT r.step, e.side, e.node, max(t.m) AS last, count(*) + 1 AS size FROM ranked r, (VALUES (0), (1)) f(k), LATERAL (SELECT CASE k WHEN 0 THEN r.i ELSE r.j END AS node, k AS side) e LEFT JOIN top t ON t.src = e.node AND t.m < r.step GROUP BY ALL),
names AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT DISTINCT u AS node FROM steps)),
lab AS (SELECT step, side, CASE WHEN last IS NULL THEN 1 ELSE size END AS size, CASE WHEN last IS NULL THEN id ELSE (SELECT max(n) FROM ranked) + last - 1 END AS label FROM pre JOIN names USING (node))
SELECT r.step, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, round(w, 6) AS height, a.size + b.size AS size FROM ranked r JOIN lab a ON a.step = r.step AND a.side = 0 JOIN lab b ON b.step = r.step AND b.side = 1"""
    for name, f, sql in (
        (f"distance_{method}", distance_query, parts + "SELECT i, j, n_common, round(w, 6) AS w FROM d"),
        (f"mst_{method}", mst_query, parts + tree + " SELECT row_number() OVER (ORDER BY w, i, j) AS step, i, j, round(w, 6) AS w FROM tree"),
        (f"tree_metrics_{method}", metrics_query, parts + tree + metrics),
        (f"linkage_{method}", linkage_query, parts + tree + clusters),
        (f"cophenetic_{method}", cophenetic_query, parts + tree + f", {_paths()} SELECT round({_RHO.replace('x', 'w').replace('y', 'longest')}, 6) AS r_cophenetic, count(*) AS n_pairs FROM d JOIN paths ON i = src AND j = dst WHERE w IS NOT NULL"),
        (f"hub_{method}", hub_query, parts + tree + f", {_paths()}, {_degrees()}, {_between()} SELECT node AS hub, degree AS hub_degree, (SELECT count(*) FROM deg WHERE degree = (SELECT max(degree) FROM deg)) > 1 AS tied FROM deg JOIN btw USING (node) ORDER BY degree DESC, round(betweenness, 9) DESC, node LIMIT 1"),
    ):
        QUERIES[name], SQL[name] = f, sql


for _method in METHODS:
    _add_method(_method)


@query(_with(*_parts("ordinal")) + "SELECT i, j, n_common, round(w, 6) AS w FROM d")
def distance_symbolic_ordinal(spark, sf_dir):
    return _r(distances(brand_returns(spark, sf_dir), "ordinal"), "w")


def _tree_of(spark, sf_dir, method: str = "mantegna") -> DataFrame:
    return cut_lineage(graph.spanning_trees(backbone(distances(brand_returns(spark, sf_dir), method))))


_MT = _with(*_parts("mantegna"), _tree())


@query(_MT + f", {_degrees()} SELECT node, degree FROM deg")
def degree_table(spark, sf_dir):
    return graph.degrees(_tree_of(spark, sf_dir))


@query(_MT + f", {_paths()}, {_between()} SELECT node, round(betweenness, 6) AS betweenness FROM btw")
def betweenness_table(spark, sf_dir):
    return _r(graph.betweenness(graph.branches(_tree_of(spark, sf_dir))), "betweenness")


@query(_MT + f", {_paths()} SELECT src AS i, dst AS j, round(longest, 6) AS u FROM paths WHERE src < dst")
def ultrametric(spark, sf_dir):
    return _r(graph.ultrametric(_tree_of(spark, sf_dir)), "u")


@query(_MT + f", {_paths()} SELECT src, dst, hops, round(length, 6) AS length, round(longest, 6) AS longest FROM paths")
def tree_path_table(spark, sf_dir):
    return _r(graph.tree_paths(_tree_of(spark, sf_dir)), "length", "longest")


@query(
    _with(*_NRET, _distance("mantegna", 60), "pe AS (SELECT node, count(*) AS peers FROM (SELECT i AS node FROM d WHERE w IS NOT NULL UNION ALL SELECT j FROM d WHERE w IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3)",
          "d2 AS (SELECT i, j, w FROM d WHERE w IS NOT NULL AND i IN (SELECT node FROM pe) AND j IN (SELECT node FROM pe))", _tree("d2"),
          "sec AS (SELECT n_name AS node, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)")
    + "SELECT row_number() OVER (ORDER BY w, i, j) AS rank, i, a.sector AS sector_i, j, b.sector AS sector_j, round(w, 6) AS w, a.sector = b.sector AS same_sector FROM tree JOIN sec a ON a.node = i JOIN sec b ON b.node = j"
)
def edge_table(spark, sf_dir):
    return _r(robustness.edge_table(graph.spanning_trees(graph.drop_isolated(cut_lineage(distances(nation_returns(spark, sf_dir), "mantegna", 60)), C.min_peers)), sectors(spark, sf_dir)), "w")


@query(
    _with(*_NRET, "sec AS (SELECT n_name AS node, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)",
          f"c AS (SELECT i, j, {_RHO} AS rho FROM (SELECT a.node AS i, b.node AS j, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.t = b.t AND a.node < b.node) GROUP BY i, j)",
          "s AS (SELECT rho, a.sector = b.sector AS same FROM c JOIN sec a ON a.node = i JOIN sec b ON b.node = j WHERE rho IS NOT NULL)")
    + "SELECT round(avg(rho) FILTER (same), 6) AS corr_intra, round(avg(rho) FILTER (NOT same), 6) AS corr_inter, count(*) FILTER (same) AS n_intra, count(*) FILTER (NOT same) AS n_inter, round(avg(rho) FILTER (same) - avg(rho) FILTER (NOT same), 6) AS difference FROM s"
)
def module_correlation(spark, sf_dir):
    return _r(robustness.module_correlation(distance.correlations(nation_returns(spark, sf_dir)), sectors(spark, sf_dir)), "corr_intra", "corr_inter", "difference")


@query(_with(*_parts("mantegna"), "b AS (SELECT i AS node, j AS other, w FROM d WHERE w IS NOT NULL UNION ALL SELECT j, i, w FROM d WHERE w IS NOT NULL)")
       + "SELECT node, rank, other, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w, other) AS rank FROM b) WHERE rank <= 3")
def strongest_neighbours(spark, sf_dir):
    return _r(robustness.strongest_neighbours(distances(brand_returns(spark, sf_dir), "mantegna")), "w")


@query(
    _with(*_parts("mantegna"), "s AS (SELECT i, j, w FROM d WHERE w < 1.36)", "n AS (SELECT i AS node FROM s UNION SELECT j FROM s)",
          "reach AS (SELECT node, node AS far FROM n UNION SELECT r.node, CASE WHEN s.i = r.far THEN s.j ELSE s.i END FROM reach r JOIN s ON s.i = r.far OR s.j = r.far)",
          "comp AS (SELECT node, min(far) AS component, count(*) AS size FROM reach GROUP BY node)")
    + "SELECT node, component, size FROM comp"
)
def component_table(spark, sf_dir):
    return graph.components(distances(brand_returns(spark, sf_dir), "mantegna").where("w < 1.36"))


@query(_MT + "SELECT i, j, round(w, 6) AS w FROM tree")
def mst_boruvka(spark, sf_dir):
    return _r(graph.boruvka(distances(brand_returns(spark, sf_dir), "mantegna")), "w")


# ---------------------------------------------------------------- convergence and robustness


def _all_distances(returns: DataFrame) -> DataFrame:
    parts = [distances(returns, m).select(F.lit(m).alias("method"), "i", "j", "w") for m in METHODS]
    return cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_ALL = (*_BRET, _symbols(), *(_distance(m, name=f"d_{m}") for m in METHODS), "alld AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, i, j, w FROM d_{m}" for m in METHODS) + ")")


@query(_with(*_ALL) + f"SELECT a.method || '-' || b.method AS pair, count(*) AS n_pairs, round({_RHO.replace('x', 'a.w').replace('y', 'b.w')}, 6) AS r FROM alld a JOIN alld b ON a.i = b.i AND a.j = b.j AND a.method < b.method WHERE a.w IS NOT NULL AND b.w IS NOT NULL GROUP BY 1")
def convergence_distances(spark, sf_dir):
    return _r(robustness.distance_correlation(_all_distances(brand_returns(spark, sf_dir))), "r")


@query(_with(*_ALL, _tree("alld", keys="method"), "ms AS (SELECT DISTINCT method FROM tree)")
       + """SELECT pair, shared, united, round(shared / united, 6) AS jaccard FROM (SELECT a.method || '-' || b.method AS pair, (SELECT count(*) FROM tree x JOIN tree y USING (i, j) WHERE x.method = a.method AND y.method = b.method) AS shared,
 (SELECT count(*) FROM (SELECT i, j FROM tree WHERE method IN (a.method, b.method) GROUP BY i, j)) AS united FROM ms a JOIN ms b ON a.method < b.method)""")  # fmt: skip
def convergence_trees(spark, sf_dir):
    trees = cut_lineage(graph.spanning_trees(_all_distances(brand_returns(spark, sf_dir)), ("method",)))
    return _r(robustness.tree_agreement(trees), "jaccard")


def _snapshot(method: str) -> str:
    k = method
    return f"""SELECT '{k}' AS method, h.node AS hub, h.degree AS hub_degree, h.degree IN (SELECT degree FROM deg_{k} WHERE node <> h.node) AS tied,
 coalesce((SELECT string_agg(node, ', ' ORDER BY node) FROM deg_{k} WHERE degree = h.degree AND node <> h.node), '') AS co_hubs, l.node AS leader, round(l.betweenness, 6) AS leader_betweenness,
 a.i || '-' || a.j AS min_edge, round(a.w, 4) AS min_w, b.i || '-' || b.j AS max_edge, round(b.w, 4) AS max_w
 FROM (SELECT * FROM deg_{k} JOIN btw_{k} USING (node) ORDER BY degree DESC, round(betweenness, 9) DESC, node LIMIT 1) h, (SELECT * FROM btw_{k} ORDER BY round(betweenness, 9) DESC, node LIMIT 1) l,
 (SELECT * FROM tree_{k} ORDER BY w, i, j LIMIT 1) a, (SELECT * FROM tree_{k} ORDER BY w DESC, i DESC, j DESC LIMIT 1) b"""


_SNAPSHOT_TREES = tuple(x for m in METHODS for x in (_tree(f"d_{m}", f"tree_{m}"), _paths(f"tree_{m}", f"paths_{m}"), _degrees(f"tree_{m}", f"deg_{m}"), _between(f"paths_{m}", f"btw_{m}")))


@query(_with(*_ALL, *_SNAPSHOT_TREES) + " UNION ALL ".join(f"({_snapshot(m)})" for m in METHODS))
def snapshot_rows(spark, sf_dir):
    returns = brand_returns(spark, sf_dir)
    rows = [_keyed(robustness.snapshot_row(cut_lineage(graph.spanning_trees(backbone(distances(returns, m))))), method=m) for m in METHODS]
    return _r(_r(reduce(DataFrame.unionByName, rows), "leader_betweenness"), "min_w", "max_w", places=4)


@query(_MT + f""", {_degrees()}, best AS (SELECT node AS excluded, degree FROM deg ORDER BY degree DESC, node LIMIT 5),
dw AS (SELECT excluded, i, j, w FROM d JOIN best ON i <> excluded AND j <> excluded), {_tree("dw", "nt", "excluded")}, {_paths("nt", "np", "excluded")}, {_degrees("nt", "nd", "excluded")}, {_between("np", "nb", "excluded")},
nh AS (SELECT excluded, arg_min(node, {{'a': -nd.degree, 'b': -round(betweenness, 9), 'c': node}}) AS new_hub, max(nd.degree) AS new_hub_degree FROM nd JOIN nb USING (excluded, node) GROUP BY excluded)
SELECT excluded, any_value(degree) AS degree, any_value(new_hub) AS new_hub, any_value(new_hub_degree) AS new_hub_degree, round(avg(nt.w), 6) AS new_ntl, count(*) AS n_edges,
 round(count(t.w) / (count(*) + (SELECT count(*) FROM tree q WHERE q.i <> excluded AND q.j <> excluded) - count(t.w)), 6) AS jaccard FROM nt JOIN best USING (excluded) JOIN nh USING (excluded) LEFT JOIN tree t ON t.i = nt.i AND t.j = nt.j GROUP BY excluded""")  # fmt: skip
def leave_one_out(spark, sf_dir):
    return _r(robustness.leave_one_out(cut_lineage(distances(brand_returns(spark, sf_dir), "mantegna")), min_peers=C.min_peers), "new_ntl", "jaccard")


NAMED = "Brand#13"  #: the node that is left out by name


QUERIES["leave_out_named"] = lambda spark, sf_dir: _r(
    robustness.leave_one_out(cut_lineage(distances(brand_returns(spark, sf_dir), "mantegna")), nodes=[NAMED], min_peers=C.min_peers), "new_ntl", "jaccard"
)
SQL["leave_out_named"] = SQL["leave_one_out"].replace("FROM deg ORDER BY degree DESC, node LIMIT 5", f"FROM deg WHERE node = '{NAMED}'")


@query(
    _with(*_BRET, *(x for k, (_, a, b) in enumerate(PARTITIONS) for x in (_symbols(f"s{k}", a, b), _distance("symbolic", name=f"d{k}", sym=f"s{k}"))),
          "alld AS (" + " UNION ALL ".join(f"SELECT '{n}' AS partition, i, j, w FROM d{k}" for k, (n, _, _) in enumerate(PARTITIONS)) + ")", _tree("alld", keys="partition"),
          "ntl AS (SELECT partition, avg(w) AS ntl, count(*) = (SELECT count(DISTINCT node) FROM ret) - 1 AS whole FROM tree GROUP BY 1)",
          f"r AS (SELECT a.partition, {_RHO.replace('x', 'a.w').replace('y', 'b.w')} AS r FROM alld a JOIN alld b ON a.i = b.i AND a.j = b.j AND b.partition = 'thirds' WHERE a.w IS NOT NULL AND b.w IS NOT NULL GROUP BY 1)",
          "jac AS (SELECT t.partition, count(b.w) / (count(*) + (SELECT count(*) FROM tree WHERE partition = 'thirds') - count(b.w)) AS jaccard FROM tree t LEFT JOIN tree b ON b.partition = 'thirds' AND b.i = t.i AND b.j = t.j GROUP BY 1)")
    + "SELECT partition, round(ntl, 6) AS ntl, round(100 * (ntl / (SELECT ntl FROM ntl WHERE partition = 'thirds') - 1), 6) AS delta_ntl_pct, round(r, 6) AS r_distance, round(jaccard, 6) AS jaccard, CASE WHEN NOT whole THEN 'disconnected' WHEN partition = 'thirds' THEN 'base' ELSE 'ok' END AS status FROM ntl JOIN r USING (partition) JOIN jac USING (partition)"
)
def partition_robustness(spark, sf_dir):
    return _r(robustness.partition_robustness(brand_returns(spark, sf_dir), PARTITIONS, C.min_symbol_obs, C.min_common), "ntl", "delta_ntl_pct", "r_distance", "jaccard")


# ---------------------------------------------------------------- rolling


def _universe(returns: DataFrame) -> int:
    return returns.select("node").distinct().count()


def _rolling_edges(returns: DataFrame, method: str, window: int = WINDOW) -> DataFrame:
    if method == "mantegna":
        return cut_lineage(rolling.rolling_mantegna(returns, window, C.common(window)))
    if method == "spearman":
        return cut_lineage(rolling.rolling_spearman(returns, window, C.common(window)))
    if method == "symbolic_inwindow":
        return cut_lineage(rolling.rolling_symbolic_inwindow(returns, window, C.quantiles, C.min_symbol_obs, C.common(window)))
    return cut_lineage(rolling.rolling_symbolic(brand_symbols(returns), window, C.common(window)))


def _rolling(spark, sf_dir, method: str) -> tuple[DataFrame, DataFrame, int]:
    returns = brand_returns(spark, sf_dir)
    return _rolling_edges(returns, method), rolling.window_ends(returns, WINDOW), _universe(returns)


def _keyed(df: DataFrame, **keys) -> DataFrame:
    return df.select(*(F.lit(v).alias(k) for k, v in keys.items()), "*")


def rolling_runs(returns: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], methods=(), windows=()) -> DataFrame:
    """The rows that ``step`` gives from distances, window ends and number of nodes, of every method and window: ``method, window, ...``."""
    n = _universe(returns)
    runs = [(m, w) for m in methods or SPECS for w in windows or C.windows]
    parts = [cut_lineage(_keyed(step(_rolling_edges(returns, m, w), rolling.window_ends(returns, w), n), method=m, window=w)) for m, w in runs]
    return reduce(DataFrame.unionByName, parts)


def by_run(rows: DataFrame, step: Callable[[DataFrame], DataFrame], methods=(), windows=()) -> DataFrame:
    """The rows that ``step`` gives from those of each run: ``method, window, ...``."""
    runs = [(m, w) for m in methods or SPECS for w in windows or C.windows]
    parts = [_keyed(step(rows.where((F.col("method") == m) & (F.col("window") == w)).drop("method", "window")), method=m, window=w) for m, w in runs]
    return reduce(DataFrame.unionByName, parts)


def ntl_runs(spark, sf_dir) -> DataFrame:
    """``method, window, t_end, date, ntl, status`` of all runs."""
    return rolling_runs(brand_returns(spark, sf_dir), lambda edges, ends, n: rolling.rolling_ntl(edges, ends, n, C.min_peers))


def _rolling_distances(method: str, window: int) -> tuple[str, ...]:
    m, within = C.common(window), f"t BETWEEN t_end - {window - 1} AND t_end"
    moments = _W.format(m=m).replace("rho", _RHO).replace("n_common", "count(*)")
    unequal = f"CASE WHEN count(*) >= {m} THEN sqrt(count(*) FILTER (x <> y) / count(*)) END"
    whole = f"wr AS MATERIALIZED (SELECT t_end, t, node, r FROM ret JOIN wend ON {within})"
    pairs = "pp AS MATERIALIZED (SELECT {k}a.t, a.node AS i, b.node AS j, a.{v} AS x, b.{v} AS y FROM {s} a JOIN {s} b ON {on}a.t = b.t AND a.node < b.node)"
    by_window = {"k": "a.t_end, ", "on": "a.t_end = b.t_end AND "}
    if method == "spearman":
        rank = "rank() OVER (PARTITION BY t_end, i, j ORDER BY {c}) + (count(*) OVER (PARTITION BY t_end, i, j, {c}) - 1) / 2 AS {c}"
        ranked = f"SELECT t_end, i, j, {rank.format(c='x')}, {rank.format(c='y')} FROM pp"
        return whole, pairs.format(v="r", s="wr", **by_window), f"d AS MATERIALIZED (SELECT t_end, i, j, count(*) AS n_common, {moments} AS w FROM ({ranked}) GROUP BY t_end, i, j)"
    if method == "symbolic_inwindow":
        limits = f"wlim AS (SELECT t_end, node, quantile_cont(r, {1 / 3!r}) AS a, quantile_cont(r, {2 / 3!r}) AS b FROM wr GROUP BY ALL HAVING count(*) >= {C.min_symbol_obs})"
        coded = "wsym AS (SELECT t_end, t, node, CASE WHEN r < a THEN 1 WHEN r <= b THEN 2 ELSE 3 END AS symbol FROM wr JOIN wlim USING (t_end, node))"
        return whole, limits, coded, pairs.format(v="symbol", s="wsym", **by_window), f"d AS MATERIALIZED (SELECT t_end, i, j, count(*) AS n_common, {unequal} AS w FROM pp GROUP BY t_end, i, j)"
    v, s, value = ("r", "ret", moments) if method == "mantegna" else ("symbol", "sym", unequal)
    return pairs.format(k="", v=v, s=s, on=""), f"d AS MATERIALIZED (SELECT t_end, i, j, count(*) AS n_common, {value} AS w FROM pp JOIN wend ON {within} GROUP BY t_end, i, j)"


def _rolling_sql(method: str, window: int = WINDOW) -> tuple[str, ...]:
    return (
        *_BRET,
        *((_symbols(),) if method == "symbolic" else ()),
        f"wend AS (SELECT DISTINCT t AS t_end, date FROM ret WHERE t >= {window - 1})",
        *_rolling_distances(method, window),
        "uni AS (SELECT count(DISTINCT node) AS n FROM ret)",
        "peers AS (SELECT t_end, count(*) FILTER (k >= 3) AS met FROM (SELECT t_end, node, count(*) AS k FROM (SELECT t_end, unnest([i, j]) AS node FROM d WHERE w IS NOT NULL) GROUP BY ALL) GROUP BY 1)",
        _tree("d", "alltree", "t_end"),
        "grown AS (SELECT t_end, count(*) AS n_edges, avg(w) AS m FROM alltree GROUP BY 1)",
        "stat AS (SELECT *, CASE WHEN status = 'ok' THEN m END AS ntl FROM (SELECT t_end, date, m, CASE WHEN coalesce(met, 0) < (SELECT n FROM uni) THEN 'isolated' WHEN n_edges <> (SELECT n FROM uni) - 1 THEN 'disconnected' ELSE 'ok' END AS status FROM wend LEFT JOIN peers USING (t_end) LEFT JOIN grown USING (t_end)))",
        "tree AS (SELECT * FROM alltree SEMI JOIN (SELECT t_end FROM stat WHERE status = 'ok') USING (t_end))",
    )


def _add_rolling(method: str) -> None:
    def ntl_query(spark, sf_dir):
        edges, ends, n = _rolling(spark, sf_dir, method)
        return _r(rolling.rolling_ntl(edges, ends, n, C.min_peers), "ntl").withColumn("date", F.col("date").cast("string"))

    QUERIES[f"rolling_ntl_{method}"] = ntl_query
    SQL[f"rolling_ntl_{method}"] = _with(*_rolling_sql(method)) + "SELECT t_end, CAST(date AS VARCHAR) AS date, round(ntl, 6) AS ntl, status FROM stat"


for _method in SPECS:
    _add_rolling(_method)


def _rolling_agreement(window: int) -> str:
    series = " UNION ALL ".join(f"SELECT '{m}' AS method, t_end, ntl FROM ({_with(*_rolling_sql(m, window))} SELECT t_end, ntl FROM stat WHERE ntl IS NOT NULL)" for m in METHODS)
    r = f"CASE WHEN count(*) > 10 THEN round({_RHO.replace('x', 'a.ntl').replace('y', 'b.ntl')}, 6) END AS r"
    return f"WITH alls AS ({series}) SELECT a.method || '-' || b.method AS pair, count(*) AS n_shared, {r} FROM alls a JOIN alls b ON a.t_end = b.t_end AND a.method < b.method GROUP BY 1"


@query(_rolling_agreement(WINDOW))
def convergence_rolling(spark, sf_dir):
    returns = brand_returns(spark, sf_dir)
    ends, n = rolling.window_ends(returns, WINDOW), _universe(returns)
    series = [rolling.rolling_ntl(_rolling_edges(returns, m), ends, n, C.min_peers).select(F.lit(m).alias("method"), "t_end", "ntl") for m in METHODS]
    return _r(robustness.series_correlation(cut_lineage(series[0].unionByName(series[1]).unionByName(series[2]))), "r")


_RM = _with(*_rolling_sql("mantegna"))


@query(_RM + f""", {_paths(keys="t_end")}, {_degrees(keys="t_end")},
ends AS (SELECT s.t_end, a.degree AS x, b.degree AS y FROM pathss s JOIN deg a ON a.t_end = s.t_end AND a.node = s.u JOIN deg b ON b.t_end = s.t_end AND b.node = s.v),
hist AS (SELECT t_end, degree, count(*) / sum(count(*)) OVER (PARTITION BY t_end) AS p FROM deg GROUP BY t_end, degree),
far AS (SELECT t_end, avg(hops) AS a, avg(length) AS b, max(hops) AS c, max(length) AS d FROM paths GROUP BY 1), mix AS (SELECT t_end, covar_pop(x, y) / nullif(var_pop(x), 0) AS e FROM ends GROUP BY 1),
ent AS (SELECT t_end, -sum(p * log2(p)) AS f, max(degree) AS g FROM hist GROUP BY 1), wt AS (SELECT t_end, count(*) AS n, sum(w) AS s, avg(w) AS m FROM tree GROUP BY 1)
SELECT t_end, n AS n_edges, round(s, 6) AS sum_w, round(m, 6) AS ntl, round(a, 6) AS apl_hops, round(b, 6) AS apl_weighted, c AS diameter_hops, round(d, 6) AS diameter_weighted, round(e, 6) + 0.0 AS assortativity, round(f, 6) AS degree_entropy, g AS max_degree
FROM wt JOIN far USING (t_end) JOIN mix USING (t_end) JOIN ent USING (t_end)""")  # fmt: skip
def rolling_topology(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    trees = cut_lineage(rolling.valid_trees(edges, ends, n, C.min_peers))
    return _r(rolling.rolling_topology(trees), "sum_w", "ntl", "apl_hops", "apl_weighted", "diameter_weighted", "assortativity", "degree_entropy")


_HUBS = f""", {_paths(keys="t_end")}, {_degrees(keys="t_end")}, {_between(keys="t_end")},
rk AS (SELECT t_end, node, degree, row_number() OVER (PARTITION BY t_end ORDER BY degree DESC, round(betweenness, 9) DESC, node) AS k, count(*) FILTER (degree = mx) OVER (PARTITION BY t_end) > 1 AS tied
 FROM (SELECT *, max(degree) OVER (PARTITION BY t_end) AS mx FROM deg) JOIN btw USING (t_end, node)),
hub AS (SELECT t_end, node AS hub, degree AS hub_degree, tied FROM rk WHERE k = 1)"""


@query(_RM + _HUBS + " SELECT t_end, hub, hub_degree, tied, hub = (SELECT hub FROM hub GROUP BY hub ORDER BY count(*) DESC, hub LIMIT 1) AS is_dominant FROM hub")
def hub_stability(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    return rolling.hub_stability(cut_lineage(rolling.valid_trees(edges, ends, n, C.min_peers)))


@query(_RM + _HUBS + " SELECT row_number() OVER (ORDER BY count(*) DESC, hub) AS rank, hub, count(*) AS windows, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM hub GROUP BY hub QUALIFY rank <= 5")
def hub_summary(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    stability = cut_lineage(rolling.hub_stability(cut_lineage(rolling.valid_trees(edges, ends, n, C.min_peers))))
    return _r(rolling.hub_summary(stability), "pct")


@query(_RM + "SELECT count(*) AS total_windows, count(*) FILTER (status = 'ok') AS ok_windows, count(*) FILTER (status <> 'ok') AS null_windows, count(*) FILTER (status = 'isolated') AS null_isolated, count(*) FILTER (status = 'disconnected') AS null_disconnected FROM stat")
def rolling_diagnostics(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    return rolling.diagnostics(rolling.window_status(edges, ends, n, C.min_peers))


@query(_RM + ", m AS (SELECT month(date) AS month, stddev_samp(ntl) / avg(ntl) AS cv FROM stat WHERE ntl IS NOT NULL GROUP BY 1) SELECT round(coalesce(max(cv), 0), 6) AS cv_max, coalesce(max(cv), 0) >= 0.2 AS seasonal FROM m")
def seasonality_cv(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    return _r(rolling.seasonality(rolling.rolling_ntl(edges, ends, n, C.min_peers)), "cv_max")


@query(_RM + """, band AS (SELECT t_end, ntl, CASE WHEN count(*) OVER w = 26 THEN avg(ntl) OVER w - stddev_pop(ntl) OVER w END AS lo, CASE WHEN count(*) OVER w = 26 THEN avg(ntl) OVER w + stddev_pop(ntl) OVER w END AS hi FROM stat WHERE ntl IS NOT NULL WINDOW w AS (ORDER BY t_end ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, coalesce(ntl > hi OR ntl < lo, false) AS out, sum(CASE WHEN ntl > hi OR ntl < lo THEN 0 ELSE 1 END) OVER (ORDER BY t_end) AS run FROM band)
SELECT min(t_end) AS start_t, max(t_end) AS end_t, count(*) AS duration, arg_min(CASE WHEN ntl > hi THEN 'fragmentation' ELSE 'integration' END, t_end) AS direction, round(avg(ntl), 6) AS ntl_mean,
 round(avg(CASE WHEN ntl > hi THEN ntl - hi ELSE lo - ntl END), 6) AS magnitude_mean, round(max(CASE WHEN ntl > hi THEN ntl - hi ELSE lo - ntl END), 6) AS magnitude_max FROM o WHERE out GROUP BY run""")  # fmt: skip
def band_episodes(spark, sf_dir):
    edges, ends, n = _rolling(spark, sf_dir, "mantegna")
    banded = rolling.rolling_band(rolling.rolling_ntl(edges, ends, n, C.min_peers), 26, 1.0)
    return _r(rolling.episodes(banded), "ntl_mean", "magnitude_mean", "magnitude_max")


# ---------------------------------------------------------------- every method and window


def _each_run(name: str, methods=SPECS, windows=C.windows, head: str = _RM) -> str:
    """The SQL of a query of one run, for every method and window."""
    tail = SQL[name][len(head) :]
    return " UNION ALL ".join(f"SELECT '{m}' AS method, {w} AS \"window\", q.* FROM ({_with(*_rolling_sql(m, w))}{tail}) q" for m in methods for w in windows)


@query(_each_run("rolling_ntl_mantegna"))
def rolling_ntl_runs(spark, sf_dir):
    return _r(ntl_runs(spark, sf_dir), "ntl").withColumn("date", F.col("date").cast("string"))


@query(_each_run("rolling_diagnostics"))
def rolling_diagnostics_runs(spark, sf_dir):
    return by_run(ntl_runs(spark, sf_dir), rolling.diagnostics)


@query(_each_run("seasonality_cv"))
def seasonality_cv_runs(spark, sf_dir):
    return _r(by_run(ntl_runs(spark, sf_dir), rolling.seasonality), "cv_max")


@query(_each_run("band_episodes"))
def band_episodes_runs(spark, sf_dir):
    rows = by_run(ntl_runs(spark, sf_dir), lambda series: rolling.episodes(rolling.rolling_band(series, 26, 1.0)))
    return _r(rows, "ntl_mean", "magnitude_mean", "magnitude_max")


def hub_runs(spark, sf_dir) -> DataFrame:
    step = lambda edges, ends, n: rolling.hub_stability(cut_lineage(rolling.valid_trees(edges, ends, n, C.min_peers)))
    return rolling_runs(brand_returns(spark, sf_dir), step, METHODS, C.hub_windows)


@query(_each_run("hub_stability", METHODS, C.hub_windows))
def hub_stability_runs(spark, sf_dir):
    return hub_runs(spark, sf_dir)


@query(_each_run("hub_summary", METHODS, C.hub_windows))
def hub_summary_runs(spark, sf_dir):
    return _r(by_run(hub_runs(spark, sf_dir), rolling.hub_summary, METHODS, C.hub_windows), "pct")


@query(_rolling_agreement(240))
def convergence_rolling_240(spark, sf_dir):
    series = rolling_runs(brand_returns(spark, sf_dir), lambda edges, ends, n: rolling.rolling_ntl(edges, ends, n, C.min_peers), METHODS, (240,))
    return _r(robustness.series_correlation(series.select("method", "t_end", "ntl")), "r")


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, q.* FROM ({_with(*_parts(m), _tree())}{SQL['leave_one_out'][len(_MT):]}) q" for m in METHODS))
def leave_one_out_runs(spark, sf_dir):
    returns = brand_returns(spark, sf_dir)
    return _r(reduce(DataFrame.unionByName, [_keyed(robustness.leave_one_out(cut_lineage(distances(returns, m)), min_peers=C.min_peers), method=m) for m in METHODS]), "new_ntl", "jaccard")


# ---------------------------------------------------------------- membership


def _turnover_sql(name: str, source: str) -> str:
    return f"""lists AS (SELECT index_code, n, effective_date, list_sort(list(DISTINCT {name})) AS now FROM {source} GROUP BY ALL),
pairs AS (SELECT index_code, lag(effective_date) OVER w AS a, effective_date AS b, now, lag(now) OVER w AS was FROM lists WINDOW w AS (PARTITION BY index_code ORDER BY n)),
turn AS (SELECT index_code, a, b, list_sort([x for x in now if NOT list_contains(was, x)]) AS added, list_sort([x for x in was if NOT list_contains(now, x)]) AS dropped, len(now) AS k FROM pairs WHERE was IS NOT NULL)"""


_TURN = """SELECT index_code, CAST(a AS VARCHAR) AS period_start, CAST(b AS VARCHAR) AS period_end, len(added) AS n_add, len(dropped) AS n_drop, coalesce(array_to_string(added, ', '), '') AS added,
 coalesce(array_to_string(dropped, ', '), '') AS dropped, k AS n_members, (year(b) - year(a)) * 12 + month(b) - month(a) > 7 AS spans_gap FROM turn"""
_ISSUERS = "al AS (SELECT ticker, min(issuer_id) AS issuer_id FROM ipc_issuer_aliases GROUP BY 1), im AS (SELECT index_code, n, effective_date, coalesce(al.issuer_id, m.ticker) AS issuer FROM members m LEFT JOIN al USING (ticker))"


def _texts(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


@query(f"WITH {_SNAPSHOTS}, {_turnover_sql('ticker', 'members')} {_TURN}")
def turnover_by_ticker(spark, sf_dir):
    return _texts(membership.turnover(snapshot_members(table(spark, sf_dir, "ipc_composition_history")), "ticker"), "period_start", "period_end")


@query(f"WITH {_SNAPSHOTS}, {_ISSUERS}, {_turnover_sql('issuer', 'im')} {_TURN}")
def turnover_by_issuer(spark, sf_dir):
    rows = issuer_members(table(spark, sf_dir, "ipc_composition_history"), table(spark, sf_dir, "ipc_issuer_aliases"))
    return _texts(membership.turnover(rows, "issuer_id"), "period_start", "period_end")


@query(f"""WITH {_SNAPSHOTS}, tot AS (SELECT index_code, count(DISTINCT n) AS n_total, max(effective_date) AS last_date FROM members GROUP BY 1)
SELECT index_code, ticker, count(*) AS n_present, any_value(n_total) AS n_total, round(100 * count(*) / any_value(n_total), 6) AS pct_present, CAST(min(effective_date) AS VARCHAR) AS first_seen, CAST(max(effective_date) AS VARCHAR) AS last_seen,
 max(effective_date) = any_value(last_date) AS is_current FROM members JOIN tot USING (index_code) GROUP BY index_code, ticker""")  # fmt: skip
def membership_summary(spark, sf_dir):
    rows = membership.membership_summary(cut_lineage(snapshot_members(table(spark, sf_dir, "ipc_composition_history"))), "ticker")
    return _r(_texts(rows, "first_seen", "last_seen"), "pct_present")


@query(f"""WITH {_SNAPSHOTS}, {_turnover_sql('ticker', 'members')},
rep AS (SELECT index_code, period_end, arg_max({{'a': n_add, 'd': n_drop}}, turnover_id) AS t FROM ipc_turnover_by_ticker WHERE period_end IS NOT NULL GROUP BY ALL)
SELECT coalesce(u.index_code, t.index_code) AS index_code, CAST(coalesce(b, period_end) AS VARCHAR) AS period_end, len(added) AS n_add, len(dropped) AS n_drop, t.t.a AS n_add_told, t.t.d AS n_drop_told,
 coalesce(t.t.a = len(added) AND t.t.d = len(dropped), false) AS agrees FROM turn u FULL JOIN rep t ON u.index_code = t.index_code AND u.b = t.period_end""")  # fmt: skip
def turnover_check(spark, sf_dir):
    found = membership.turnover(snapshot_members(table(spark, sf_dir, "ipc_composition_history")), "ticker")
    return _texts(membership.reported_against_found(table(spark, sf_dir, "ipc_turnover_by_ticker"), found), "period_end")


def _joined_convergence() -> str:
    hub = " UNION ALL ".join(f"SELECT '{m}' AS method, hub FROM ({SQL[f'hub_{m}']})" for m in METHODS)
    return f"""SELECT t.pair, t.jaccard, d.r AS r_distance, n.r AS r_ntl, n.n_shared, a.hub AS hub_a, b.hub AS hub_b FROM ({SQL['convergence_trees']}) t JOIN ({SQL['convergence_distances']}) d ON d.pair = t.pair
 LEFT JOIN ({SQL['convergence_rolling']}) n ON n.pair = t.pair JOIN ({hub}) a ON a.method = split_part(t.pair, '-', 1) JOIN ({hub}) b ON b.method = split_part(t.pair, '-', 2)"""


@query(_joined_convergence())
def convergence_table(spark, sf_dir):
    """The three comparisons of each pair of methods and their hubs in one row."""
    part = lambda name, **as_: QUERIES[name](spark, sf_dir).select("pair", *(F.col(c).alias(a) for c, a in as_.items()))
    rows = part("convergence_trees", jaccard="jaccard").join(part("convergence_distances", r="r_distance"), "pair").join(part("convergence_rolling", r="r_ntl", n_shared="n_shared"), "pair", "left")
    hub = reduce(DataFrame.unionByName, [QUERIES[f"hub_{m}"](spark, sf_dir).select(F.lit(m).alias("method"), "hub") for m in METHODS])
    hub = cut_lineage(hub)
    for k, end in enumerate("ab"):
        rows = rows.join(hub.select(F.col("method").alias(f"m{end}"), F.col("hub").alias(f"hub_{end}")), F.split("pair", "-")[k] == F.col(f"m{end}")).drop(f"m{end}")
    return rows
