"""Graphs of distances: components, minimum spanning trees, hierarchies, tree metrics.

Edges are ``by, i, j, w`` with i < j. All choices follow the total order (w, i, j). Sorted edges of a group are folded in one pass inside
the JVM, which suits many graphs of bounded size (windows, replicas) and one graph of at most ``FOLD_EDGES`` edges, which are counted; a larger one is
treated by ``boruvka``, which joins by component in O(log N) rounds and holds no graph in one task. Both give the same rows.
Metrics of trees come from the sizes and depths of branches below a root, so nothing is kept for each pair of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.runtime import cut_lineage

FOLD_EDGES = 200_000


def finite(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("w").isNotNull() & ~F.isnan("w"))


def both_ways(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node, other, w``: every edge from either end."""
    ends = F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")), F.struct(F.col("j").alias("node"), F.col("i").alias("other")))
    return edges.select(*by, F.inline(ends), "w")


def drop_isolated(edges: DataFrame, min_peers: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The finite edges between nodes with at least ``min_peers`` of them; one pass, not repeated."""
    real = finite(edges)
    kept = both_ways(real, by).groupBy(*by, "node").agg(F.count("*").alias("peers")).where(F.col("peers") >= min_peers)
    i, j = kept.select(*by, F.col("node").alias("i")), kept.select(*by, F.col("node").alias("j"))
    return real.join(i, [*by, "i"], "left_semi").join(j, [*by, "j"], "left_semi")


def _folded(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, nodes, tree, labels`` of each group: Kruskal over the sorted edges, with component labels in an array of the nodes.

    A merge of clusters a < b of sizes that add up to ``size`` makes cluster N + step, so the fold is single linkage at once.
    """
    cols = [F.col(c) for c in by]
    rows = finite(edges).select(*by, "i", "j", "w")
    if by:  # the fold is work, not bytes: as many tasks as the session asks for, whatever the size of the rows
        rows = rows.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
    groups = rows.groupBy(*cols).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("i", "j"))))).alias("nodes"), F.array_sort(F.collect_list(F.struct("w", "i", "j"))).alias("edges")
    )
    at = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    indexed = groups.withColumn("coded", F.transform("edges", lambda e: F.struct(e["w"].alias("w"), e["i"].alias("i"), e["j"].alias("j"), at(e["i"]).alias("p"), at(e["j"]).alias("q"))))
    empty = "cast(array() as array<struct<w:double,i:string,j:string,a:int,b:int,size:int>>)"
    fold = f"""aggregate(coded, named_struct('labels', sequence(0, size(nodes) - 1), 'tree', {empty}), (s, e) ->
      if(s.labels[e.p] = s.labels[e.q], s, named_struct(
        'labels', transform(s.labels, l -> if(l = s.labels[e.p] or l = s.labels[e.q], size(nodes) + size(s.tree), l)),
        'tree', concat(s.tree, array(named_struct('w', e.w, 'i', e.i, 'j', e.j, 'a', least(s.labels[e.p], s.labels[e.q]), 'b', greatest(s.labels[e.p], s.labels[e.q]),
          'size', size(filter(s.labels, l -> l = s.labels[e.p] or l = s.labels[e.q]))))))))"""
    return indexed.select(*by, "nodes", F.expr(fold).alias("f")).select(*by, "nodes", "f.tree", "f.labels")


def _too_many(edges: DataFrame) -> bool:
    return len(edges.select(F.lit(1)).head(FOLD_EDGES + 1)) > FOLD_EDGES


def spanning_trees(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, step, i, j, w, a, b, size, n_nodes``: tree edges in ascending order, with the merge of clusters that each makes.

    A graph that isn't connected gives a forest of fewer than ``n_nodes - 1`` edges. Of a single large graph only the edges of its tree are folded.
    """
    if not by:
        edges = cut_lineage(edges.select("i", "j", "w"))
        if _too_many(edges):
            edges = boruvka(edges)
    return _folded(edges, by).select(*by, F.size("nodes").alias("n_nodes"), F.posexplode("tree")).select(*by, (F.col("pos") + 1).alias("step"), "col.*", "n_nodes")


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node, component, size``: a component is named by its smallest node."""
    if not by:
        edges = cut_lineage(finite(edges).select("i", "j", "w"))
    if not by and _too_many(edges):
        rows = _contracted(edges)[1].withColumnRenamed("c", "label")
    else:
        rows = _folded(edges, by).select(*by, F.explode(F.arrays_zip("nodes", "labels")).alias("z")).select(*by, F.col("z.nodes").alias("node"), F.col("z.labels").alias("label"))
    named = rows.groupBy(*by, "label").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    same = F.col("label") == F.col("_label")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named.withColumnsRenamed({"label": "_label", **{c: f"_{c}" for c in by}}), same).select(*by, "node", "component", "size")


def largest_component(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node`` of the largest component; of several as large, the one with the smallest node."""
    rows = components(edges, by)
    best = F.first("component").over(Window.partitionBy(*by).orderBy(F.desc("size"), "component"))
    return rows.withColumn("best", best).where("component = best").select(*by, "node")


def boruvka(edges: DataFrame) -> DataFrame:
    """``i, j, w`` of the minimum spanning forest of one graph of any size."""
    return _contracted(edges)[0]


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest ``i, j, w`` and the component ``c`` (one of its nodes) of each ``node``.

    In each round every component takes its least outgoing edge and components joined so are merged by pointer jumping; each step is a keyed aggregate or a join,
    and lineage is cut by a reliable checkpoint. Rounds at least halve the components that can still grow, so they end.
    """
    live = cut_lineage(finite(edges).select("i", "j", "w", F.col("i").alias("ci"), F.col("j").alias("cj")))
    labels = live.select(F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("c", F.col("node"))
    tree = live.select("i", "j", "w").limit(0)
    while not live.isEmpty():
        sides = F.array(F.struct(F.col("ci").alias("c"), F.col("cj").alias("d")), F.struct(F.col("cj").alias("c"), F.col("ci").alias("d")))
        least = live.select("i", "j", "w", F.inline(sides)).groupBy("c").agg(F.min(F.struct("w", "i", "j", "d")).alias("e"))
        chosen = cut_lineage(least.select("c", "e.*"))
        tree = tree.unionByName(chosen.select("i", "j", "w").distinct())
        # following the chosen edge, the two ends of the least edge of a component point at each other: the smaller one is the root
        back = chosen.select(F.col("c").alias("d"), F.col("d").alias("up2"))
        parent = chosen.select("c", "d").join(back, "d", "left").select("c", F.when((F.col("up2") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("up"))
        moved = True
        while moved:
            jumped = parent.join(parent.select(F.col("c").alias("up"), F.col("up").alias("top")), "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            jumped = cut_lineage(jumped)
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("c", "up")
        labels = cut_lineage(labels.join(parent, "c", "left").select("node", F.coalesce("up", "c").alias("c")))
        ci, cj = parent.select(F.col("c").alias("ci"), F.col("up").alias("ni")), parent.select(F.col("c").alias("cj"), F.col("up").alias("nj"))
        live = cut_lineage(live.join(ci, "ci").join(cj, "cj").where("ni != nj").select("i", "j", "w", F.col("ni").alias("ci"), F.col("nj").alias("cj")))
    return tree, labels


def tree_paths(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, src, dst, hops, length, longest``: the path between every ordered pair of a tree's nodes; ``longest`` is its longest edge.

    Paths grow by one edge a step and never turn back, so each is found once; it takes as many steps as the tree's diameter.
    """
    spark = tree.sparkSession
    steps = cut_lineage(both_ways(tree, by).withColumnsRenamed({"node": "u", "other": "v"}))
    steps.createOrReplaceTempView("_tree_steps")
    keys = "".join(f"{c}, " for c in by)
    carried = "".join(f"p.{c}, " for c in by)
    same = "".join(f"p.{c} <=> s.{c} AND " for c in by)
    # written once: what follows joins the paths with themselves, and recursion isn't shared between branches of a plan
    return cut_lineage(spark.sql(f"""WITH RECURSIVE p AS (
      SELECT {keys}u AS src, u AS prev, v AS dst, 1 AS hops, w AS length, w AS longest FROM _tree_steps
      UNION ALL
      SELECT {carried}p.src, p.dst, s.v, p.hops + 1, p.length + s.w, greatest(p.longest, s.w) FROM p JOIN _tree_steps s ON {same}p.dst = s.u AND s.v <> p.prev)
      SELECT {keys}src, dst, hops, length, longest FROM p"""))


def ultrametric(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, i, j, u``: the longest edge on the path between each pair; also the height at which single linkage joins it."""
    return tree_paths(tree, by).where("src < dst").select(*by, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("longest").alias("u"))


def cophenetic_correlation(edges: DataFrame, heights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, r_cophenetic, n_pairs``: Pearson's correlation of distances and joining heights."""
    joined = finite(edges).join(heights, [*by, "i", "j"])
    sums = joined.groupBy(*map(F.col, by)).agg(F.covar_pop("w", "u").alias("c"), F.var_pop("w").alias("a"), F.var_pop("u").alias("b"), F.count("*").alias("n_pairs"))
    return sums.select(*by, F.try_divide("c", F.nullif(F.sqrt(F.col("a") * F.col("b")), F.lit(0.0))).alias("r_cophenetic"), "n_pairs")


def degrees(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node, degree``."""
    return both_ways(tree, by).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def branches(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, root, node, branch, w, size, hops, length, n_nodes``: the branches below each node of a tree hung up at its smallest node.

    ``branch`` is the child at the other end of an edge of weight ``w``, ``size`` the number of nodes behind it, ``hops`` and ``length`` the way to the farthest of them; ``n_nodes`` is that of
    the tree. Every edge is one branch. Trees are walked down from their roots, one edge a step, and each node tells its ancestors.
    """
    steps = cut_lineage(both_ways(tree, by).withColumnsRenamed({"node": "u", "other": "v"}))
    steps.createOrReplaceTempView("_branch_steps")
    roots = components(tree, by).where("node = component").select(*by, F.col("node").alias("root"), F.col("size").alias("n_nodes"))
    roots.createOrReplaceTempView("_branch_roots")
    keys, carried, same = "".join(f"{c}, " for c in by), "".join(f"p.{c}, " for c in by), "".join(f"p.{c} <=> s.{c} AND " for c in by)
    at = "named_struct('node', {node}, 'w', {w}, 'hops', {hops}, 'length', {length})"
    walked = tree.sparkSession.sql(f"""WITH RECURSIVE p AS (
      SELECT {keys}root, n_nodes, root AS node, cast(NULL AS string) AS up, 0 AS hops, cast(0 AS double) AS length,
        array({at.format(node="root", w="cast(0 AS double)", hops="0", length="cast(0 AS double)")}) AS path FROM _branch_roots
      UNION ALL
      SELECT {carried}p.root, p.n_nodes, s.v, p.node, p.hops + 1, p.length + s.w,
        concat(p.path, array({at.format(node="s.v", w="s.w", hops="p.hops + 1", length="p.length + s.w")})) FROM p JOIN _branch_steps s ON {same}p.node = s.u AND NOT (s.v <=> p.up))
      SELECT {keys}root, n_nodes, hops, length, path FROM p""")
    above = walked.select(*by, "root", "n_nodes", "hops", "length", F.inline(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, c: F.struct(a.alias("a"), c.alias("c"))))).where("a is not null")
    rows = above.groupBy(*by, "root", F.col("a.node").alias("node"), F.col("c.node").alias("branch")).agg(
        F.first("c.w").alias("w"), F.count("*").alias("size"), F.max(F.col("hops") - F.col("a.hops")).alias("hops"), F.max(F.col("length") - F.col("a.length")).alias("length"), F.first("n_nodes").alias("n_nodes")
    )
    return cut_lineage(rows)


def betweenness(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, node, betweenness``: the share of pairs of other nodes whose path crosses a node, from the ``branches`` of a tree.

    Of the (N-1)(N-2)/2 pairs those within one branch at the node, or within what lies above it, don't cross.
    """
    within = F.col("size") * (F.col("size") - 1) / 2
    below = rows.select(*by, "node", "n_nodes", "size", within.alias("within"))
    # at its far end an edge has the rest of the tree as a branch
    rest = F.col("n_nodes") - F.col("size")
    above = rows.select(*by, F.col("branch").alias("node"), "n_nodes", rest.alias("size"), (rest * (rest - 1) / 2).alias("within"))
    sums = below.unionByName(above).groupBy(*by, "node").agg(F.first("n_nodes").alias("n"), F.sum("within").alias("within"))
    pairs = (F.col("n") - 1) * (F.col("n") - 2) / 2
    return sums.select(*by, "node", F.coalesce(F.try_divide(pairs - F.col("within"), pairs), F.lit(0.0)).alias("betweenness"))


def hubs(degree: DataFrame, between: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, hub, hub_degree, tied``: the node of highest degree; ties by betweenness, then by name."""
    joined = degree.join(between, [*by, "node"])
    top = F.max("degree").over(Window.partitionBy(*by))
    ranked = joined.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("degree"), F.desc(F.round("betweenness", 9)), "node"))).withColumn("top", top)
    tied = F.count_if(F.col("degree") == F.col("top")).over(Window.partitionBy(*by)) > 1
    return ranked.withColumn("tied", tied).where("k = 1").select(*by, F.col("node").alias("hub"), F.col("degree").alias("hub_degree"), "tied")


def tree_metrics(tree: DataFrame, below: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a tree, from its edges and ``branches``: edges, sum and mean weight, mean and largest path by hops and length, assortativity, degree entropy, largest degree."""
    key = [F.col(c) for c in by]
    weight = tree.groupBy(*key).agg(F.count("*").alias("n_edges"), F.sum("w").alias("sum_w"), F.avg("w").alias("ntl"))
    # an edge with s nodes behind it lies on s (N - s) paths; the longest path turns at some node from its deepest branch to the next one
    crossed = F.col("size") * (F.col("n_nodes") - F.col("size"))
    sums = below.groupBy(*by, "root").agg(F.first("n_nodes").alias("n"), F.sum(crossed).alias("h"), F.sum(crossed * F.col("w")).alias("l"))
    mean = sums.groupBy(*key).agg((F.sum("h") / F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("apl_hops"), (F.sum("l") / F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("apl_weighted"))
    deepest = lambda c: F.slice(F.sort_array(F.collect_list(c), False), 1, 2)
    turns = below.groupBy(*by, "node").agg(deepest("hops").alias("h"), deepest("length").alias("l"))
    both = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda s, x: s + x)
    widest = turns.groupBy(*key).agg(F.max(both("h")).cast("int").alias("diameter_hops"), F.max(both("l")).alias("diameter_weighted"))
    deg = degrees(tree, by)
    x, y = deg.select(*by, "node", F.col("degree").alias("x")), deg.select(*by, F.col("node").alias("other"), F.col("degree").alias("y"))
    ends = both_ways(tree, by).join(x, [*by, "node"]).join(y, [*by, "other"])
    mix = ends.groupBy(*key).agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"))
    mix = mix.select(*by, F.try_divide("c", F.nullif("v", F.lit(0.0))).alias("assortativity"))
    shares = deg.groupBy(*by, "degree").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(*by))
    entropy = shares.withColumn("p", p).groupBy(*key).agg(F.sum(-F.col("p") * F.log2("p")).alias("degree_entropy"), F.max("degree").alias("max_degree"))
    out = weight
    for part in (mean, widest, mix, entropy):
        out = out.join(part, list(by)) if by else out.join(F.broadcast(part))  # one row
    return out


def edge_jaccard(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, shared, united, jaccard`` of two sets of edges."""
    both = a.select(*by, "i", "j", F.lit(1).alias("a")).join(b.select(*by, "i", "j", F.lit(1).alias("b")), [*by, "i", "j"], "full")
    sums = both.groupBy(*map(F.col, by)).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("united"))
    return sums.withColumn("jaccard", F.try_divide("shared", "united"))
