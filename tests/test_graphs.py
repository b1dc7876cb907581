import math
import random

import pytest
from pyspark.sql import functions as F
from conftest import boxes

from gridloom.operators import components as C, filters as N, labels as L, messages as MS, metrics as M, regions as G, sampling as S, tiles as T


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(0, i) for i in nodes], "graph_id long, node long")
    e = spark.createDataFrame([(0, a, b) for a, b in edges], "graph_id long, src long, dst long")
    return n, e


CASES = {
    "path": (range(4), [(0, 1), (1, 2), (2, 3)], [0, 1, 2, 3]),
    "branched": (range(6), [(0, 1), (1, 2), (2, 3), (2, 4), (4, 5)], None),
    "cyclic": (range(3), [(0, 1), (1, 2), (0, 2)], []),
}


@pytest.mark.parametrize("kind", CASES)
def test_topology_and_chain_order(spark, kind):
    nodes, edges, order = CASES[kind]
    n, e = graph(spark, nodes, edges)
    cells = C.graph_components(n, e)
    t = C.topology(cells, e).collect()
    assert [r.topology for r in t] == [kind]
    chain = [r.node for r in C.chain_order(cells, e).orderBy("pos").collect()]
    if order is not None:
        assert chain == order
    else:
        assert len(chain) == 5 and all((min(a, b), max(a, b)) in edges for a, b in zip(chain, chain[1:]))


def test_isolated_nodes_are_kept_and_numbered(spark):
    n, e = graph(spark, [3, 5, 7, 9], [(5, 9)])
    got = {r.node: r.cell for r in C.graph_components(n, e).collect()}
    assert got == {3: 1, 5: 2, 9: 2, 7: 3}
    top = C.topology(C.graph_components(n, e), e)
    assert C.summarize_cells(top).first().summary == "3 cells: 2 singleton, 1 path"


@pytest.mark.parametrize("limit", [0, 100, 10_000])
def test_components_survive_long_paths_and_hubs(spark, limit):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)]
    random.Random(1).shuffle(edges)
    e = spark.createDataFrame([(0, a, b) for a, b in edges], "graph_id long, a long, b long")
    got = {r.node: r.component for r in C.connected_components(e, ["graph_id"], local_limit=limit).collect()}
    assert {v for k, v in got.items() if k <= 300} == {0} and {v for k, v in got.items() if k >= 1000} == {1000}


def test_label_components_do_not_depend_on_tiles(spark):
    rng = random.Random(3)
    px = [(0, y, x) for y in range(30) for x in range(30) if rng.random() < 0.5]
    m = spark.createDataFrame(px, "image_id long, y long, x long")
    for conn in (4, 8):
        a = {(r.y, r.x): r.component for r in C.label_components(m, conn, tile=256).collect()}
        b = {(r.y, r.x): r.component for r in C.label_components(m, conn, tile=7).collect()}
        assert a == b and len(a) == len(px)


def test_geodesic_and_watershed_do_not_depend_on_tiles(spark):
    rng = random.Random(4)
    px = [(0, y, x, float(rng.randint(0, 9))) for y in range(24) for x in range(24) if rng.random() < 0.75]
    m = spark.createDataFrame(px, "image_id long, y long, x long, height double")
    src = m.limit(1).select("image_id", "y", "x")
    first = (px[0][1], px[0][2])
    src = spark.createDataFrame([(0, *first)], "image_id long, y long, x long")
    a = {(r.y, r.x): round(r.dist, 9) for r in T.geodesic_distance(m, src, tile=256).collect()}
    b = {(r.y, r.x): round(r.dist, 9) for r in T.geodesic_distance(m, src, tile=5).collect()}
    assert a == b
    seeds = spark.createDataFrame([(0, *px[i][1:3], n) for n, i in enumerate((0, 100, 200, 300), 1)], "image_id long, y long, x long, seed long")
    a = {(r.y, r.x): r.seed for r in T.seeded_watershed(m, seeds, tile=256).collect()}
    b = {(r.y, r.x): r.seed for r in T.seeded_watershed(m, seeds, tile=5).collect()}
    assert a == b


def test_thinning_keeps_connectivity_and_ignores_tiles(spark):
    lab, _ = boxes(spark, [(1, 3, 10, 2, 30), (1, 3, 25, 12, 18)], (30, 32))
    m = lab.select("image_id", "y", "x").distinct()
    a = {(r.y, r.x) for r in T.thin(m, tile=256).collect()}
    b = {(r.y, r.x) for r in T.thin(m, tile=11, steps=2).collect()}
    assert a == b and 0 < len(a) < m.count() / 3
    sk = spark.createDataFrame([(0, y, x) for y, x in a], "image_id long, y long, x long")
    assert C.label_components(sk, 8).select("component").distinct().count() == 1


def kruskal(edges):
    root = {}

    def find(u):
        while root.setdefault(u, u) != u:
            u = root[u]
        return u

    out = set()
    for d, i, j in sorted((d, i, j) for i, j, d in edges):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.add((i, j))
    return out


def brute_chain(near):
    """End to end for a path, else from the node farthest from the smallest one, to the one farthest from that."""

    def walk(root):
        back, dist, todo = {root: None}, {root: 0}, [root]
        for u in todo:
            for v in near[u]:
                if v not in dist:
                    back[v], dist[v] = u, dist[u] + 1
                    todo.append(v)
        return back, min(dist, key=lambda n: (-dist[n], n))

    path = max(map(len, near.values())) <= 2
    start = min(n for n in near if len(near[n]) == 1) if path else walk(min(near))[1]
    back, end = walk(start)
    out = []
    while end is not None:
        out.append(end)
        end = back[end]
    return out[::-1]


def test_chain_order_of_random_trees(spark):
    """Many trees at once, stars and combs among them."""
    rng = random.Random(6)
    nodes, edges, cell_of = [], [], {}
    for c in range(30):
        ids = rng.sample(range(c * 100, c * 100 + 100), rng.randint(2, 40))
        shape = c % 3
        for k in range(1, len(ids)):
            other = ids[0] if shape == 0 else ids[k - 1] if shape == 1 and rng.random() < 0.8 else ids[rng.randrange(k)]
            edges.append((ids[k], other) if rng.random() < 0.5 else (other, ids[k]))
        nodes += ids
        cell_of |= dict.fromkeys(ids, c)
    n, e = graph(spark, nodes, edges + edges[:20] + [(nodes[0], nodes[0])])
    cells = spark.createDataFrame([(0, c, i) for i, c in cell_of.items()], "graph_id long, cell long, node long")
    got = {}
    for r in C.chain_order(cells, e).orderBy("cell", "pos").collect():
        got.setdefault(r.cell, []).append(r.node)
    for c in range(30):
        near = {i: set() for i in nodes if cell_of[i] == c}
        for a, b in edges:
            if cell_of[a] == c:
                near[a].add(b)
                near[b].add(a)
        assert got[c] == brute_chain(near), c


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n = 200_000
    ids = (F.col("id") * 7919) % n  # numbers that jump along the path
    e = spark.range(n - 1).select(F.lit(0).cast("long").alias("graph_id"), F.lit(1).cast("long").alias("cell"), ids.alias("src"), (((F.col("id") + 1) * 7919) % n).alias("dst"))
    rounds, real = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, **k: rounds.append(1) or real(df, **k))
    ranks = C.euler_ranks(e)
    assert len(rounds) < 25
    d = C.tree_depths(ranks, spark.createDataFrame([(0, 1, 0)], "graph_id long, cell long, node long"), "d")
    at = d.join(spark.range(n).select(ids.alias("node"), F.col("id").alias("want")), "node")
    assert at.count() == n and at.filter("d <> want").count() == 0


@pytest.mark.parametrize("limit", [10_000, 30, 7, 0])
def test_minimum_forest(spark, limit):
    rng = random.Random(5)
    edges = [(i, j, float(rng.randint(1, 30))) for i in range(20) for j in range(i + 1, 20) if rng.random() < 0.4]
    df = spark.createDataFrame([(0, *e) for e in edges], "image_id long, i long, j long, dist double")
    other = df.withColumn("image_id", F.lit(9).cast("long")).filter("i < 3")
    rows = C.minimum_forest(df.unionByName(other), ["image_id"], max(limit, 1)).collect()
    assert {(r.i, r.j) for r in rows if r.image_id == 0} == kruskal(edges)
    assert {(r.i, r.j) for r in rows if r.image_id == 9} == kruskal([x for x in edges if x[0] < 3])


def greedy(edges, pts, angle):
    deg, near, root, out = {}, {}, {}, set()

    def find(u):
        while root.setdefault(u, u) != u:
            u = root[u]
        return u

    def turn(c, a, b):
        va = [pts[a][k] - pts[c][k] for k in (0, 1)]
        vb = [pts[b][k] - pts[c][k] for k in (0, 1)]
        na, nb = math.hypot(*va), math.hypot(*vb)
        if na == 0 or nb == 0:
            return 180.0
        return math.degrees(math.acos(max(-1, min(1, (va[0] * vb[0] + va[1] * vb[1]) / (na * nb)))))

    for s, u, v in sorted((-w, a, b) for a, b, w in edges if w > 0):
        if deg.get(u, 0) > 1 or deg.get(v, 0) > 1 or find(u) == find(v):
            continue
        if deg.get(u, 0) == 1 and turn(u, near[u], v) < angle or deg.get(v, 0) == 1 and turn(v, near[v], u) < angle:
            continue
        root[find(u)] = find(v)
        for a, b in ((u, v), (v, u)):
            deg[a] = deg.get(a, 0) + 1
            near.setdefault(a, b)
        out.add((u, v))
    return out


def test_greedy_chains_equal_the_sequential_pass(spark):
    rng = random.Random(6)
    pts = {i: (rng.random() * 10, rng.random() * 10) for i in range(25)}
    edges = [(i, j, round(rng.random(), 2)) for i in pts for j in pts if i < j and rng.random() < 0.5]
    e = spark.createDataFrame([(0, *t) for t in edges], "graph_id long, src long, dst long, score double")
    p = spark.createDataFrame([(0, i, *c) for i, c in pts.items()], "graph_id long, node long, y double, x double")
    got = {(r.src, r.dst) for r in C.greedy_chains(e, p, 0.0, 90.0).collect()}
    assert got == greedy(edges, pts, 90.0)


def test_symmetrize_needs_no_reverse_edge(spark):
    e = spark.createDataFrame([(0, 1, 2, 0.2), (0, 2, 1, 0.6), (0, 3, 4, 0.9), (0, 5, 5, 0.3)], "graph_id long, src long, dst long, p double")
    got = {(r.src, r.dst): round(r.p, 6) for r in MS.symmetrize(e, "p").collect()}
    assert got == {(1, 2): 0.4, (2, 1): 0.4, (3, 4): 0.9, (5, 5): 0.3}


def test_undirected_edges_swap_endpoint_angles(spark):
    e = spark.createDataFrame([(1, 2, 0.1, 0.7, 9.0)], "src long, dst long, node1_angle_diff double, node2_angle_diff double, w double")
    rows = {(r.src, r.dst): (r.node1_angle_diff, r.node2_angle_diff, r.w) for r in L.to_undirected(e).collect()}
    assert rows == {(1, 2): (0.1, 0.7, 9.0), (2, 1): (0.7, 0.1, 9.0)}
    with pytest.raises(Exception, match="src < dst"):
        L.to_undirected(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "node1_angle_diff", "node2_angle_diff", "w")).collect()


@pytest.mark.parametrize("counts,ratio,want", [((10, 40, 200), 1.0, (10, 10, 10)), ((4, 0, 153), 1.0, (4, 0, 4)), ((10, 40, 200), 2.0, (10, 20, 20)), ((10, 12, 200), 5.0, (10, 12, 50))])
def test_balanced_sample_counts(spark, counts, ratio, want):
    rows = [(n * 1000 + i, n) for n, c in enumerate(counts) for i in range(c)]
    df = spark.createDataFrame(rows, "node long, cls int")
    got = {r.cls: r["count"] for r in S.balanced_sample(df, "cls", "node", ratio, 1).groupBy("cls").count().collect()}
    assert tuple(got.get(i, 0) for i in range(3)) == want


@pytest.mark.parametrize("pos,neg,want", [(200, 800, (15, 15)), (3, 500, (3, 15))])
def test_sample_per_class(spark, pos, neg, want):
    df = spark.createDataFrame([(i, 1 if i < pos else 0) for i in range(pos + neg)], "id long, y int")
    got = {r.y: r["count"] for r in S.sample_per_class(df, "y", "id", 15, 0).groupBy("y").count().collect()}
    assert (got[1], got[0]) == want


def test_negative_links_are_new_distinct_and_complete(spark):
    e = spark.createDataFrame([(u, (u * 7 + k) % 50) for u in range(40) for k in range(5)], "user_id long, item_id long").distinct()
    neg = S.negative_links(e, 1.0, 3)
    assert neg.count() == e.count() == neg.distinct().count()
    assert neg.join(e, ["user_id", "item_id"]).count() == 0


def test_absent_and_missed_classes(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 2, 1)], "fold int, truth int, pred int")
    got = {(r.fold, r.cls): (r.precision, r.recall, r.support) for r in M.class_metrics(df, ["fold"]).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 2)} and got[1, 2] == (0.0, 0.0, 1)
    assert got[0, 1] == (0.5, 1.0, 1)


def test_dilation_and_erosion(spark):
    lab, sizes = boxes(spark, [(1, 0, 3, 0, 3), (2, 0, 3, 3, 6)], (6, 6))
    assert N.dilate(lab, N.diamond(1), sizes).filter("label = 1").count() == 15
    assert {(r.label, r.y, r.x) for r in N.erode_labels(lab, N.square(1)).collect()} == {(1, 1, 1), (2, 1, 4)}


@pytest.mark.parametrize("overlap", [False, True])
def test_objects_of_a_tile_share_a_group_and_stay_apart(spark, monkeypatch, overlap):
    """Touching (or overlapping) objects thin and measure as if each had an image of its own, in one group a tile."""
    rng = random.Random(9)
    px = {(rng.randint(1, 4), y, x) for y in range(40) for x in range(30)}
    px |= {(5 + k, y, x) for k in range(2) for y in range(40, 60) for x in range(k * 11, k * 11 + (14 if overlap else 11)) if rng.random() < 0.9}
    m = spark.createDataFrame([(0, *p) for p in px], "image_id long, label long, y long, x long")
    alone = m.select(F.col("label").alias("image_id"), "y", "x")
    src = m.filter("(y * 7 + x) % 13 = 0")
    alone_src = src.select(F.col("label").alias("image_id"), "y", "x")
    both = ["image_id", "label"]
    want = ({tuple(r) for r in T.thin(alone, tile=16, steps=3).collect()}, {(r.image_id, r.y, r.x): round(r.dist, 9) for r in T.geodesic_distance(alone, alone_src, tile=16).collect()})
    groups, tiled = [], T.per_tile

    def recorded(df, tile, halo, fn, schema, keys):
        groups.append(keys)
        return tiled(df, tile, halo, fn, schema, keys)

    monkeypatch.setattr(T, "per_tile", recorded)
    got = ({(r.label, r.y, r.x) for r in T.thin(m, both, tile=16, steps=3).collect()}, {(r.label, r.y, r.x): round(r.dist, 9) for r in T.geodesic_distance(m, src, 1.0, both, tile=16).collect()})
    assert got == want
    assert groups and all(k == ["image_id"] for k in groups)


def test_small_groups_share_their_calls(spark):
    """Forests of small groups and hulls of small regions need no pandas group each; the results stay those of each alone."""
    rng = random.Random(2)
    rows = [(g, i, j, float(rng.randint(1, 9))) for g in range(30) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.7]
    edges = spark.createDataFrame(rows, "image_id long, i long, j long, dist double")
    got = C.minimum_forest(edges, ["image_id"])
    want = set()
    for g in range(30):
        of = list(range(6))
        for d, i, j in sorted((d, i, j) for h, i, j, d in rows if h == g):
            if of[i] != of[j]:
                want.add((g, i, j, d))
                of = [of[i] if o == of[j] else o for o in of]
    assert {(r.image_id, r.i, r.j, r.dist) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "_bucket" in plan and "FlatMapGroupsInPandas [image_id" not in plan

    px = [(0, n, y, 20 * n + x) for n in range(30) for y in range(n % 4 + 1) for x in range(n % 5 + 1) if n % 3 or y == 0 or x == 0]
    solid = G.region_solidity(spark.createDataFrame(px, "image_id long, label long, y long, x long"))
    assert "FlatMapGroupsInPandas" not in solid._jdf.queryExecution().toString()
    of = {r.label: r for r in solid.collect()}
    assert len(of) == 30
    for n in range(30):
        area = sum(p[1] == n for p in px)
        assert of[n].solidity == area / of[n].hull_area
        if n % 3:
            assert of[n].hull_area == area  # full rectangles are convex
    assert of[9].hull_area > sum(p[1] == 9 for p in px) - 1
