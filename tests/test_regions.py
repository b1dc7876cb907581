import math

import pytest
from pyspark.sql import functions as F
from conftest import HYPHA, HYPHA_GT, boxes, image

from gridloom.operators import candidates as C, components as CC, filters as N, matching as M, regions as G
from gridloom.plans.pipelines import build_graph


def overlap(spark, frag, gt, shape):
    f, _ = boxes(spark, frag, shape)
    g, _ = boxes(spark, gt, shape)
    j = f.withColumnRenamed("label", "frag").join(g.withColumnRenamed("label", "gt"), ["image_id", "y", "x"], "full")
    return f, j.na.fill(0, ["frag", "gt"])


def test_assignment_and_spanning_tree(spark):
    f, px = overlap(spark, HYPHA + [(5, 2, 4, 2, 6)], HYPHA_GT, (20, 60))
    a = M.assign_to_gt(px, 0.5)
    assert {r.frag: r.gt for r in a.collect()} == {1: 10, 2: 10, 3: 10, 4: 20, 5: -1}
    sizes = spark.createDataFrame([(0, 20, 60)], "image_id long, h long, w long")
    tree = CC.merge_edges(f, G.inner_boundary(f, sizes), a, start=2)
    assert sorted((r.i, r.j) for r in tree.collect()) == [(1, 2), (2, 3)]


def test_knn_edges_and_cap(spark):
    f, sizes = boxes(spark, HYPHA[:3], (20, 60))
    b = G.inner_boundary(f, sizes)
    reg = G.region_basic(f)
    assert sorted((r.i, r.j) for r in C.knn_edges(reg, b, 1).collect()) == [(1, 2), (2, 3)]
    assert C.knn_edges(reg, b, 1, cap=0.5).count() == 0


def test_single_region_has_node_but_no_edges(spark):
    f, sizes = boxes(spark, [(1, 3, 7, 3, 7)], (10, 10))
    px = image(spark, (10, 10), lambda y, x: 1.0)
    nodes, edges = build_graph(f, px, None, None, k=3)
    assert nodes.count() == 1 and edges.count() == 0
    n = nodes.first()
    assert n.area_norm == 1.0 and n.solidity == pytest.approx(1.0) and n.interior_intensity == 1.0


def test_pipeline_labels_follow_ground_truth(spark):
    f, px = overlap(spark, HYPHA, HYPHA_GT, (20, 60))
    im = image(spark, (20, 60), lambda y, x: (7 * y + 3 * x) % 11)
    nodes, edges = build_graph(f, im, px, spark.createDataFrame([(0, None, "mean_width", 8.0)], "image_id long, all_type string, metric string, threshold double"), k=2)
    rows = edges.collect()
    assert {(r.src, r.dst) for r in rows if r.edge_label} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    fwd = {(r.src, r.dst): r for r in rows}
    for (a, b), r in fwd.items():
        assert fwd[b, a].node1_angle_diff == r.node2_angle_diff and fwd[b, a].area_ratio == r.area_ratio
        assert 0 <= r.contact_frac <= 1 and 0 <= r.relative_angle <= 1
    assert {r.node_type for r in nodes.collect()} <= {1, 2}


CELLS = [(1, 10, 12, 5, 55), (2, 30, 50, 20, 40)]


def metrics(spark, items, shape):
    c, _ = boxes(spark, items, shape)
    k = G.KEYS
    return M.cell_metrics(G.region_basic(c).join(G.region_moments(c), k).join(G.region_perimeter(c), k).join(G.region_solidity(c), k))


@pytest.mark.parametrize("metric,threshold", [("mean_width", 8.0), ("axis_ratio", 5.0)])
def test_cell_rules(spark, metric, threshold):
    rules = spark.createDataFrame([(0, None, metric, threshold)], "image_id long, all_type string, metric string, threshold double")
    got = {r.label: r.cell_type for r in M.classify_cells(metrics(spark, CELLS, (60, 60)), rules).collect()}
    assert got == {1: "hyphal", 2: "epithelial"}


def test_unknown_metric_fails(spark):
    rules = spark.createDataFrame([(0, None, "beauty", 1.0)], "image_id long, all_type string, metric string, threshold double")
    with pytest.raises(Exception, match="unknown metric"):
        M.classify_cells(metrics(spark, CELLS, (60, 60)), rules).collect()


def test_fragment_type_comes_from_its_cell(spark):
    frag = [(1, 10, 12, 5, 30), (2, 30, 50, 20, 40), (3, 0, 5, 0, 5)]
    _, px = overlap(spark, frag, CELLS, (60, 60))
    rules = spark.createDataFrame([(0, None, "mean_width", 8.0)], "image_id long, all_type string, metric string, threshold double")
    types = M.node_types(M.assign_to_gt(px, 0.1), M.classify_cells(metrics(spark, CELLS, (60, 60)), rules))
    assert {r.frag: r.node_type for r in types.collect()} == {1: 2, 2: 1, 3: 0}


def test_region_shapes_of_a_rectangle(spark):
    f, sizes = boxes(spark, [(1, 2, 6, 3, 13)], (20, 20))
    r = G.region_basic(f).join(G.region_moments(f), G.KEYS).join(G.region_perimeter(f), G.KEYS).join(G.region_solidity(f), G.KEYS).first()
    assert (r.area, r.r0, r.c0, r.r1, r.c1, r.extent) == (40, 2, 3, 6, 13, 1.0)
    assert r.major == pytest.approx(4 * math.sqrt(100 / 12)) and r.minor == pytest.approx(4 * math.sqrt(16 / 12))
    assert abs(r.orientation) == pytest.approx(math.pi / 2)
    assert r.perimeter == pytest.approx(2 * (3 + 9)) and r.solidity == pytest.approx(1.0)


def test_solidity_of_an_l_shape(spark):
    f, _ = boxes(spark, [(1, 0, 10, 0, 2), (1, 8, 10, 2, 10)], (12, 12))
    r = G.region_solidity(f).first()
    # brute force: pixel centres inside the hull of the pixel diamonds, legs 9.5 apart
    pts = [(y + a, x + b) for y in range(10) for x in range(10) if x < 2 or y >= 8 for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    def inside(y, x):
        for (ay, ax) in pts:
            for (by, bx) in pts:
                if (ay, ax) != (by, bx):
                    s = [(by - ay) * (px - ax) - (bx - ax) * (py - ay) for py, px in pts]
                    if min(s) >= -1e-9 and (by - ay) * (x - ax) - (bx - ax) * (y - ay) < -1e-9:
                        return False
        return True
    hull = sum(inside(y, x) for y in range(10) for x in range(10))
    assert r.hull_area == hull


def test_features_do_not_change_under_quarter_turns(spark):
    items = [(1, 2, 6, 3, 13), (2, 8, 18, 9, 12), (3, 10, 13, 2, 6)]
    f, sizes = boxes(spark, items, (20, 20))
    px = image(spark, (20, 20), lambda y, x: (y * 31 + x * 17) % 23)
    turned = f.select("image_id", "label", (19 - F.col("x")).alias("y"), F.col("y").alias("x"))
    tpx = px.select("image_id", (19 - F.col("x")).alias("y"), F.col("y").alias("x"), "v")
    a = {r.label: r for r in G.node_features(f, px).collect()}
    b = {r.label: r for r in G.node_features(turned, tpx).collect()}
    for lab, r in a.items():
        for c in r.asDict():
            assert b[lab][c] == pytest.approx(r[c]), c


def test_node_box_is_clipped(spark):
    f, sizes = boxes(spark, [(1, 0, 4, 0, 10)], (20, 20))
    r = G.node_box(G.region_basic(f), sizes, 0.1).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (0.0, 0.0, 11.0, 4.4)


def test_centroid_knn_matches_brute_force_on_clustered_points(spark):
    pts = [(0, i, float((i * i) % 7 + (100 if i % 9 == 0 else 0)), float((i * 13) % 11)) for i in range(60)]
    reg = spark.createDataFrame(pts, "image_id long, label long, cy double, cx double")
    got = {(r.i, r["rank"]): r.j for r in C.centroid_knn(reg, 5).collect()}
    for _, i, y, x in pts:
        best = sorted(((y - b) ** 2 + (x - a) ** 2, j) for _, j, b, a in pts if j != i)[:5]
        assert [got[i, n + 1] for n in range(5)] == [j for _, j in best]


def test_an_upright_region_stands_at_a_right_angle(spark):
    """Its covariance is zero in whole numbers, so no rounding decides the sign of the angle."""
    px = [(i, 1, y + 3 * i, x + 7 * i) for i in range(40) for y, x in ((0, 0), (0, 3), (1, 1), (1, 2), (2, 0), (2, 3), (0, 1), (0, 2), (2, 1), (2, 2))]
    m = G.region_moments(spark.createDataFrame(px, "image_id long, label long, y long, x long")).collect()
    assert {r.orientation for r in m} == {math.pi / 2} and len({(r.major, r.minor) for r in m}) == 1
