"""Connected components and what is built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import running_sums
from gridloom.functions.rounds import dealt, materialize
from gridloom.operators import filters as N, raster as R
from gridloom.operators.tiles import SHIFTS4, SHIFTS8, key_schema, per_tile

IMG = ["image_id"]
ROW = 2**32  # pixel id = y * ROW + x


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n items' components under the links a-b."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(pa, pb)[open_], np.minimum(pa, pb)[open_])
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]


def connected_components(edges: DataFrame, keys: list[str], local_limit: int = 100_000) -> DataFrame:
    """(keys, node, component) for every node with an edge; a component is named by its smallest
    node.  `edges` has (keys, a, b).

    Randomized contraction: each round every node follows the member of its closed neighbourhood
    with the smallest hash, edges move to those representatives and loops vanish.  The graph
    shrinks by a constant factor per round whatever its shape, a hub only meets a partial
    minimum, and the maps of the rounds are composed at the end.  Once the counted remainder is
    at most `local_limit` edges in total, each key's rest is finished in place.
    """
    ks = list(keys)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        out = pd.DataFrame({"node": ids, "rep": ids[_roots(a, b, len(ids))]})
        return out.assign(**{k: pdf[k].iloc[0] for k in ks})

    e = edges.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, obs = materialize(e, n=F.count(F.lit(1)))
    maps: list[DataFrame] = []
    i = -1
    while obs["n"]:
        i += 1
        if obs["n"] <= local_limit:
            maps.append(e.groupBy(*keys).applyInPandas(finish, f"node long, rep long, {key_schema(e, keys)}").select(*keys, "node", "rep"))
            break
        both = e.select(*keys, "a", "b").unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(c: str):
            return F.struct(F.xxhash64(*keys, c, F.lit(i)).alias("h"), F.col(c).alias("id"))

        rep = both.groupBy(*keys, "a").agg(F.min(ranked("b")).alias("m"))
        rep = rep.select(*keys, F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["id"].alias("rep"))
        rep, _ = materialize(rep)
        maps.append(rep)
        to = [*keys]
        nxt = e.join(rep.withColumnsRenamed({"node": "a", "rep": "ra"}), [*to, "a"]).join(rep.withColumnsRenamed({"node": "b", "rep": "rb"}), [*to, "b"])
        nxt = nxt.filter("ra <> rb").select(*keys, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e, obs = materialize(nxt, n=F.count(F.lit(1)))
    if not maps:
        return edges.select(*keys, F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    final = maps[-1].withColumnRenamed("rep", "root")
    if len(maps) == 1 and obs["n"]:
        return final.withColumnRenamed("root", "component")  # all in place: roots are smallest nodes
    for m in reversed(maps[:-1]):
        up = final.withColumnsRenamed({"node": "rep", "root": "up"})
        final = m.join(up, [*keys, "rep"], "left").select(*keys, "node", F.coalesce("up", "rep").alias("root"))
    final, _ = materialize(final)
    least = final.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return final.join(least, [*keys, "root"]).select(*keys, "node", "component")


def _local_labels(y: np.ndarray, x: np.ndarray, conn: int) -> np.ndarray:
    """Index of the smallest member of each pixel's component inside one tile."""
    grid = np.full((y.max() + 3, x.max() + 3), -1, dtype=np.int64)
    grid[y + 1, x + 1] = np.arange(len(y))
    links = []
    for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else []):
        other = grid[y + 1 + dy, x + 1 + dx]
        hit = other >= 0
        links.append(np.c_[np.flatnonzero(hit), other[hit]])
    a, b = np.concatenate(links).T
    return _roots(a, b, len(y))


def label_components(mask: DataFrame, conn: int = 4, keys: list[str] = IMG, tile: int = 256) -> DataFrame:
    """Component of every foreground pixel, named by its first pixel (id y * 2^32 + x).

    Tiles are labelled on their own, then only labels that touch across tile borders enter the
    distributed contraction: its input follows the length of tile borders, not the mask's area.
    """
    ks = list(keys)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        first = _local_labels(y - y.min(), x - x.min(), conn)
        return pdf[[*ks, "y", "x"]].assign(local=(y * ROW + x)[first])

    loc = per_tile(mask.select(*keys, "y", "x"), tile, 0, fn, key_schema(mask, keys) + ", y long, x long, local long", keys)
    loc, _ = materialize(loc)
    last = tile - 1
    rim = loc.filter(F.expr(f"y % {tile} IN (0, {last}) OR x % {tile} IN (0, {last})"))
    offs = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in (SHIFTS4 if conn == 4 else SHIFTS8) if (a, b) > (0, 0)])
    look = rim.withColumn("_o", F.explode(offs)).select(*keys, "y", "x", (F.col("y") + F.col("_o.dy")).alias("ny"), (F.col("x") + F.col("_o.dx")).alias("nx"), F.col("local").alias("a"))
    look = look.filter(F.expr(f"y div {tile} <> ny div {tile} OR x div {tile} <> nx div {tile}"))
    edges = look.join(rim.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("local").alias("b")), [*keys, "ny", "nx"]).select(*keys, "a", "b")
    comp = connected_components(edges, keys).withColumnRenamed("node", "local")
    return loc.join(comp, [*keys, "local"], "left").select(*keys, "y", "x", F.coalesce("component", "local").alias("component"))


def number_components(px: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """Labels 1, 2, ... in order of each component's first pixel."""
    ids = px.select(*keys, "component").distinct().withColumn("_one", F.lit(1))
    num = running_sums(ids, keys, "component", {"label": "_one"}, 8).select(*keys, "component", "label")
    return px.join(num, [*keys, "component"]).drop("component")


def fill_holes(df: DataFrame, fg: str = "fg", keys: list[str] = IMG, tile: int = 256) -> DataFrame:
    """Dense mask with background components that do not reach the image border filled."""
    bg = df.filter(~F.col(fg)).select(*keys, "y", "x")
    comp = label_components(bg, 4, keys, tile)
    size = df.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("_h")) | (F.col("x") == F.col("_w"))
    outside = comp.join(size, keys).filter(edge).select(*keys, "component").distinct()
    holes = comp.join(outside, [*keys, "component"], "left_anti").select(*keys, "y", "x", F.lit(True).alias("_hole"))
    return df.join(holes, [*keys, "y", "x"], "left").withColumn(fg, F.col(fg) | F.coalesce("_hole", F.lit(False))).drop("_hole")


def combine_masks(df: DataFrame, prob: str, magnitude: str, t1: float, t2: float, keys: list[str] = IMG) -> DataFrame:
    """Probability above t1 and hole-filled magnitude above t2, holes filled again."""
    m = fill_holes(df.select(*keys, "y", "x", prob, (F.col(magnitude) > t2).alias("fg")), "fg", keys)
    return fill_holes(m.select(*keys, "y", "x", (F.col("fg") & (F.col(prob) > t1)).alias("fg")), "fg", keys)


def hybrid_threshold(df: DataFrame, frac: float, block: int, min_size: int, keys: list[str] = IMG) -> DataFrame:
    """Above a share of Otsu and above the local mean, without objects under min_size pixels."""
    t = R.otsu_threshold(df, keys).select(*keys, "threshold")
    m = N.local_threshold(df, block, keys).join(t, keys)
    m = m.filter(F.col("fg") & (F.col("v") > frac * F.col("threshold"))).select(*keys, "y", "x")
    c = label_components(m, 4, keys)
    return with_stats(c, [*keys, "component"], _n=F.count("*")).filter(F.col("_n") >= min_size).select(*keys, "y", "x", "component")


def canny_link(df: DataFrame, min_size: int, keys: list[str] = IMG) -> DataFrame:
    """Edges that survive suppression and double thresholds: 8-connected pieces with enough
    pixels and at least one strong one."""
    e, _ = materialize(N.hysteresis_classes(df, keys))
    c = label_components(e, 8, keys).join(e, [*keys, "y", "x"])
    c = with_stats(c, [*keys, "component"], _n=F.count("*"), _s=F.max("strong"))
    return c.filter((F.col("_n") >= min_size) & F.col("_s")).select(*keys, "y", "x", "component")


def stitch_slices(labels: DataFrame, iou: float, keys: list[str] = ["image_id", "c"]) -> DataFrame:
    """One id per chain of objects linked through adjacent slices; the id is the first object's
    z * 2^32 + label."""
    from gridloom.operators.regions import slice_links

    links = slice_links(labels, iou, keys)
    e = links.select(*keys, (F.col("z") * ROW + F.col("label")).alias("a"), ((F.col("z") - 1) * ROW + F.col("prev")).alias("b"))
    comp = connected_components(e, keys)
    objs = labels.select(*keys, "z", "label").distinct().withColumn("node", F.col("z") * ROW + F.col("label"))
    return objs.join(comp, [*keys, "node"], "left").select(*keys, "z", "label", F.coalesce("component", "node").alias("object_id"))


# ---- graphs -------------------------------------------------------------------------------


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cell number of every node, 1, 2, ... by smallest member per graph; isolated nodes kept."""
    e = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    c = connected_components(e, ["graph_id"])
    n = nodes.select("graph_id", "node").join(c, ["graph_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    ids = n.select("graph_id", "component").distinct().withColumn("_one", F.lit(1))
    num = running_sums(ids, ["graph_id"], "component", {"cell": "_one"}, 8).select("graph_id", "component", "cell")
    return n.join(num, ["graph_id", "component"]).select("graph_id", "node", "cell")


def topology(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, edges, largest degree and kind of every cell."""
    und = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ends = und.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))
    t = cells.join(ends, ["graph_id", "node"], "left").groupBy("graph_id", "cell").agg(
        F.count("*").alias("n_nodes"), F.expr("coalesce(sum(degree), 0) div 2").alias("n_edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree")
    )
    kind = F.when(F.col("n_nodes") == 1, "singleton").when(F.col("n_edges") != F.col("n_nodes") - 1, "cyclic").when(F.col("max_degree") <= 2, "path").otherwise("branched")
    return t.withColumn("topology", kind)


def euler_ranks(edges: DataFrame) -> DataFrame:
    """(graph_id, cell, u, v, pos, total): the arcs of every tree (graph_id, cell, src, dst) in the order of
    its Euler tour, which begins at the smallest node and visits neighbours by number.

    An arc into v goes on to v's next neighbour; the tour is a linked list, ranked by pointer doubling:
    each round every arc jumps twice as far, so the longest list of n arcs takes log2(n) rounds.
    """
    keys = ["graph_id", "cell"]
    arcs = edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(*keys, F.col("dst").alias("u"), F.col("src").alias("v")))
    size = arcs.groupBy(*keys).agg(F.min("u").alias("_root"), F.count(F.lit(1)).alias("total"))
    around = W.partitionBy(*keys, "u").orderBy("v")
    first = arcs.groupBy(*keys, "u").agg(F.min("v").alias("_first"))
    step = arcs.withColumn("_next", F.lead("v").over(around)).join(first, [*keys, "u"]).join(size, keys)
    ends = F.col("_next").isNull() & (F.col("u") == F.col("_root"))  # back at the root after its last neighbour
    arc = F.when(~ends, F.struct("u", F.coalesce("_next", "_first").alias("v")))
    todo = step.select(*keys, F.struct(F.col("v").alias("u"), F.col("u").alias("v")).alias("arc"), arc.alias("to"), F.when(ends, 0).otherwise(1).cast("long").alias("k"), "total")
    todo, obs = materialize(todo, n=F.count("to"))
    while obs["n"]:
        there = todo.select(*keys, F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("k").alias("_k"))
        j = todo.join(there, [*keys, "to"], "left")
        todo, obs = materialize(j.select(*keys, "arc", F.col("_to").alias("to"), (F.col("k") + F.coalesce("_k", F.lit(0))).alias("k"), "total"), n=F.count("to"))
    return todo.select(*keys, "arc.u", "arc.v", (F.col("total") - 1 - F.col("k")).alias("pos"), "total")


def tree_depths(ranks: DataFrame, roots: DataFrame, out: str) -> DataFrame:
    """(graph_id, cell, node, <out>): distances inside trees from one root (graph_id, cell, node) each.

    Turning the tour so that it begins at the root needs no new ranking; the arc of an edge that comes
    first leads down, and a node's depth is the running sum of down and up at that arc.
    """
    keys = ["graph_id", "cell"]
    start = ranks.join(roots.withColumnRenamed("node", "u"), [*keys, "u"]).groupBy(*keys).agg(F.min("pos").alias("_p0"))
    turned = ranks.join(start, keys).withColumn("q", (F.col("pos") - F.col("_p0") + F.col("total")) % F.col("total"))
    both = turned.groupBy(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(F.struct("q", F.col("v").alias("node"))).alias("down"), F.max("q").alias("up"))
    steps = both.select(*keys, F.explode(F.array(
        F.struct(F.col("down.q").alias("q"), F.lit(1).alias("d"), F.col("down.node").alias("node")),
        F.struct(F.col("up").alias("q"), F.lit(-1).alias("d"), F.lit(None).cast("long").alias("node")),
    )).alias("s")).select(*keys, "s.*")
    depth = running_sums(steps, keys, "q", {out: "d"}, bucket=F.expr("q div 4096")).filter("node is not null")
    return depth.select(*keys, "node", F.col(out).cast("int").alias(out)).unionByName(roots.select(*keys, "node", F.lit(0).alias(out)))


def chain_order(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Node order along every cell (graph_id, cell, pos, node): a path from its smaller end, a
    longest path of a branched tree, nothing for cyclic cells.

    All trees are ranked together by one Euler tour each (see `euler_ranks`), whatever their size.
    A longest path runs from the node farthest from the smallest one to the node farthest from
    that; its nodes are those whose distances to both ends add up to its length.
    """
    keys = ["graph_id", "cell"]
    top, _ = materialize(topology(cells, edges).select(*keys, "n_nodes", "topology"))
    und = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    trees = top.filter("topology IN ('path', 'branched')")
    e = und.join(cells.withColumnRenamed("node", "src"), ["graph_id", "src"]).join(trees.select(*keys), keys)
    single = cells.join(top.filter("topology = 'singleton'"), keys).select(*keys, F.lit(0).alias("pos"), "node")
    ranks = euler_ranks(e)
    degree = ranks.groupBy(*keys, F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")).join(trees, keys)
    first = degree.groupBy(*keys, "topology").agg(F.min(F.when((F.col("topology") == "branched") | (F.col("degree") == 1), F.col("node"))).alias("node"))

    def farthest(d: DataFrame, c: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.max(F.struct(F.col(c), (-F.col("node")).alias("n"))).alias("m")).select(*keys, (-F.col("m.n")).alias("node"), F.col(f"m.{c}").alias("length"))

    far = farthest(tree_depths(ranks, first.filter("topology = 'branched'").select(*keys, "node"), "d0"), "d0")
    start, _ = materialize(first.filter("topology = 'path'").select(*keys, "node").unionByName(far.select(*keys, "node")))
    da, _ = materialize(tree_depths(ranks, start, "da"))
    end = farthest(da, "da")
    db = tree_depths(ranks, end.select(*keys, "node"), "db")
    on = da.join(db, [*keys, "node"]).join(end.select(*keys, "length"), keys).filter("da + db = length")
    return on.select(*keys, F.col("da").alias("pos"), "node").unionByName(single)


def relabel(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Fragment pixels take their cell's number; `cells` has (image_id, label, cell)."""
    return labels.join(cells, ["image_id", "label"]).select("image_id", "y", "x", F.col("cell").alias("label"))


# Order of the kinds in summaries.
KINDS = ["singleton", "path", "branched", "cyclic"]


def summarize_cells(topo: DataFrame) -> DataFrame:
    """Count per kind as one text line per graph."""
    g = topo.groupBy("graph_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("topology") == k).alias(k) for k in KINDS])
    parts = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"))) for k in KINDS]))
    return g.select("graph_id", F.concat(F.col("n").cast("string"), F.lit(" cells: "), F.array_join(parts, ", ")).alias("summary"))


# ---- spanning trees and greedy chains -------------------------------------------------------


def _kruskal(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The forests of all groups among the edges, in one pass."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(u):
        while root.setdefault(u, u) != u:
            root[u] = root[root[u]]
            u = root[u]
        return u

    keep = []
    ordered = pdf.sort_values(["dist", "i", "j"])
    group = ordered.groupby(keys, dropna=False).ngroup()
    for n, (g, a, b) in enumerate(zip(group, ordered["i"], ordered["j"], strict=True)):
        a, b = find((g, a)), find((g, b))
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(n)
    return ordered.iloc[keep]


def minimum_forest(edges: DataFrame, keys: list[str], local_limit: int = 50_000) -> DataFrame:
    """Minimum spanning forest of (keys, i, j, dist) per group, ties by (i, j).

    Forests are mergeable: an edge that closes a cycle of cheaper ones in any slice of a group's edges
    is in no forest of the group.  So groups of more than `local_limit` edges are dealt into slices of
    that many, every slice keeps its own forest, and the forests are dealt again, as long as that sheds
    edges.  Smaller groups are finished many at once, in buckets that hold about a slice.  Groups with forests of more than a slice contract
    their cheapest edges round by round over the cluster.
    """
    edges, obs = materialize(edges.select(*keys, "i", "j", "dist"), n=F.count(F.lit(1)))
    buckets = max(-(-obs["n"] // local_limit), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _kruskal(pdf, keys)

    sized = with_stats(edges, keys, _n=F.count("*"))
    cut, obs = materialize(sized.filter(F.col("_n") > local_limit), n=F.count(F.lit(1)))
    before = None
    while obs["n"] and (before is None or obs["n"] <= 0.8 * before):
        before = obs["n"]
        slices = F.ceil(F.col("_n") / local_limit)
        sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("i", "j"), slices)).drop("_n")
        kept = sliced.groupBy(*keys, "_slice").applyInPandas(forest, sliced.schema).drop("_slice")
        cut, obs = materialize(with_stats(kept, keys, _n=F.count("*")), n=F.count_if(F.col("_n") > local_limit))
        sized = sized.filter(F.col("_n") <= local_limit).unionByName(cut.filter(F.col("_n") <= local_limit))
        cut = cut.filter(F.col("_n") > local_limit)
    sized = sized.filter(F.col("_n") <= local_limit).unionByName(cut)
    small = sized.filter(F.col("_n") <= local_limit).drop("_n").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    out = dealt(small, "_bucket").groupBy("_bucket").applyInPandas(forest, small.schema).drop("_bucket")
    big, obs = materialize(sized.filter(F.col("_n") > local_limit).drop("_n"), n=F.count(F.lit(1)))
    cur = big.withColumn("a", F.col("i")).withColumn("b", F.col("j"))
    while obs["n"]:
        half = F.struct("dist", "i", "j").alias("e")
        ends = cur.select(*keys, F.col("a").alias("u"), half).unionByName(cur.select(*keys, F.col("b").alias("u"), half))
        best = ends.groupBy(*keys, "u").agg(F.min("e").alias("e")).select(*keys, "e.i", "e.j", "e.dist").distinct()
        best, _ = materialize(best)
        out = out.unionByName(best)
        joined = cur.join(best.select(*keys, "i", "j"), [*keys, "i", "j"], "left_semi").select(*keys, "a", "b")
        comp = connected_components(joined, keys)
        for c in ("a", "b"):
            cur = cur.join(comp.withColumnsRenamed({"node": c, "component": f"_{c}"}), [*keys, c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        cur, obs = materialize(cur.filter("a <> b"), n=F.count(F.lit(1)))
    return out


def merge_edges(labels: DataFrame, boundary: DataFrame, assign: DataFrame, start: int = 16) -> DataFrame:
    """Spanning tree over the fragments of every ground-truth cell by outline distance
    (image_id, gt, i, j, dist); nothing for single fragments.

    Only pairs whose boxes lie within a radius are measured.  Every tree edge up to the radius
    is then certain; cells that stay unconnected repeat with a larger radius.
    """
    from gridloom.operators.candidates import boundary_distance
    from gridloom.operators.regions import region_basic

    keys = ["image_id", "gt"]
    f = region_basic(labels).join(assign.filter("gt <> -1").select("image_id", F.col("frag").alias("label"), "gt"), ["image_id", "label"])
    f = with_stats(f.select(*keys, "label", "r0", "r1", "c0", "c1"), keys, _n=F.count("*")).filter("_n >= 2")
    todo, obs = materialize(f, n=F.count(F.lit(1)))
    radius, done = start, []
    while obs["n"] or not done:  # once even for an empty input, which fixes the schema
        def cells(lo: str, hi: str):
            return F.sequence(F.floor((F.col(lo) - radius / 2) / radius).cast("long"), F.floor((F.col(hi) + radius / 2) / radius).cast("long"))

        g = todo.select(*keys, "label", "r0", "r1", "c0", "c1", F.explode(cells("r0", "r1")).alias("gy"), "_n")
        g = g.withColumn("gx", F.explode(cells("c0", "c1")))
        b = g.select(*keys, "gy", "gx", F.col("label").alias("j"))
        pairs = g.select(*keys, "gy", "gx", F.col("label").alias("i")).join(b, [*keys, "gy", "gx"]).filter("i < j").select(*keys, "i", "j").distinct()
        pairs, _ = materialize(pairs)
        d = boundary_distance(pairs, boundary).filter(F.col("dist") <= radius)
        tree, _ = materialize(minimum_forest(pairs.join(d.select("image_id", "i", "j", "dist"), ["image_id", "i", "j"]), keys))
        have = tree.groupBy(*keys).agg(F.count("*").alias("_e"))
        state = todo.join(have, keys, "left").withColumn("_ok", F.coalesce("_e", F.lit(0)) == F.col("_n") - 1)
        done.append(tree.join(state.filter("_ok").select(*keys).distinct(), keys, "left_semi"))
        todo, obs = materialize(state.filter("NOT _ok").drop("_e", "_ok"), n=F.count(F.lit(1)))
        radius *= 4
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


def greedy_chains(edges: DataFrame, points: DataFrame, t: float = 0.0, angle: float = 90.0) -> DataFrame:
    """Edges a greedy pass by falling score accepts: degree at most 2, no cycle, no turn sharper
    than `angle` degrees.  `edges` (graph_id, src, dst, score), `points` (graph_id, node, y, x).

    Equal to the sequential pass: an edge is settled once it is the best open edge of both
    components it touches, since only better edges at those components could change its fate.
    Each component settles at most one edge per round, so merging needs only a join.
    """
    import math

    k = ["graph_id"]
    open_ = edges.filter((F.col("score") > 0) & (F.col("score") >= t)).select(*k, "src", "dst", "score")
    open_, obs = materialize(open_, n=F.count(F.lit(1)))
    node, _ = materialize(points.select(*k, "node", "y", "x", F.col("node").alias("comp"), F.lit(0).alias("degree"), F.lit(None).cast("double").alias("ny"), F.lit(None).cast("double").alias("nx")))
    taken = None
    while obs["n"]:
        def end(p: str, c: str) -> DataFrame:
            return node.select(*k, F.col("node").alias(c), *[F.col(q).alias(f"{p}{q}") for q in ("y", "x", "comp", "degree", "ny", "nx")])

        e = open_.join(end("u", "src"), [*k, "src"]).join(end("v", "dst"), [*k, "dst"])

        def sharp(p: str, q: str):
            ay, ax = F.col(f"{p}ny") - F.col(f"{p}y"), F.col(f"{p}nx") - F.col(f"{p}x")
            by, bx = F.col(f"{q}y") - F.col(f"{p}y"), F.col(f"{q}x") - F.col(f"{p}x")
            na, nb = F.sqrt(ay * ay + ax * ax), F.sqrt(by * by + bx * bx)
            cos = F.least(F.greatest((ay * by + ax * bx) / (na * nb), F.lit(-1.0)), F.lit(1.0))
            turn = F.when((na == 0) | (nb == 0), 180.0).otherwise(F.acos(cos) * (180 / math.pi))
            return (F.col(f"{p}degree") == 1) & (turn < angle)

        e = e.filter((F.col("udegree") < 2) & (F.col("vdegree") < 2) & (F.col("ucomp") != F.col("vcomp")) & ~sharp("u", "v") & ~sharp("v", "u"))
        e, obs = materialize(e, n=F.count(F.lit(1)))
        if not obs["n"]:
            break
        pri = F.struct((-F.col("score")).alias("s"), "src", "dst").alias("p")
        sides = e.select(*k, F.col("ucomp").alias("comp"), pri).unionByName(e.select(*k, F.col("vcomp").alias("comp"), pri))
        best = sides.groupBy(*k, "comp").agg(F.min("p").alias("p")).groupBy(*k, "p").agg(F.count("*").alias("c")).filter("c = 2")
        win = e.join(best.select(*k, F.col("p.src").alias("src"), F.col("p.dst").alias("dst")), [*k, "src", "dst"])
        win, _ = materialize(win)
        got = win.select(*k, "src", "dst", "score")
        taken = got if taken is None else taken.unionByName(got)
        merge = win.select(*k, F.greatest("ucomp", "vcomp").alias("comp"), F.least("ucomp", "vcomp").alias("into"))
        add = win.select(*k, F.col("src").alias("node"), F.col("vy").alias("ay"), F.col("vx").alias("ax")).unionByName(win.select(*k, F.col("dst").alias("node"), F.col("uy").alias("ay"), F.col("ux").alias("ax")))
        node = node.join(merge, [*k, "comp"], "left").join(add, [*k, "node"], "left").select(
            *k, "node", "y", "x", F.coalesce("into", "comp").alias("comp"), (F.col("degree") + F.when(F.col("ay").isNotNull(), 1).otherwise(0)).alias("degree"),
            F.coalesce("ny", "ay").alias("ny"), F.coalesce("nx", "ax").alias("nx"),
        )
        node, _ = materialize(node)
        open_, obs = materialize(e.select(*k, "src", "dst", "score").join(got.select(*k, "src", "dst"), [*k, "src", "dst"], "left_anti"), n=F.count(F.lit(1)))
    return taken if taken is not None else edges.select(*k, "src", "dst", "score").limit(0)
