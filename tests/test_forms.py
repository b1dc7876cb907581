"""Forms that queries alone don't show: masks, runs, listed labels, odd tiles, wavelets, caps, merges, fits."""

import math

import numpy as np
import pytest
from conftest import image
from pyspark.sql import functions as F

from gridloom.operators import candidates as C, labels as LB, learning as ML, profiles as P, regions as G, wavelets as WV
from gridloom.plans import compositions, pipelines
from gridloom.sources import views as V

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bank,shape,levels,size", [("sym8", (37, 50), 2, 7), ("sym8", (9, 16), 1, 4096), ("sym8", (5, 3), 2, 4096), ("haar", (12, 17), 3, 5)])
def test_wavelets_reconstruct(spark, bank, shape, levels, size):
    v = np.random.default_rng(1).random(shape)
    df = image(spark, shape, lambda y, x: v[y, x])
    a, d = WV.decompose(df, bank, levels, size=size)
    got = {(r.y, r.x): r.v for r in WV.compose(a, d, bank, size=size).collect()}
    assert len(got) == v.size and max(abs(got[y, x] - v[y, x]) for y, x in got) < 1e-9
    h, w, n = *shape, len(WV.BANKS[bank])
    for level in d:
        h, w = (h + n - 1) // 2, (w + n - 1) // 2
        assert level.count() == h * w


def test_wavelets_keep_smooth_images(spark):
    """Polynomials have no details inside: eight vanishing moments."""
    df = image(spark, (64, 64), lambda y, x: 1.0 + y + 0.1 * x * x)
    _, (d,) = WV.decompose(df, "sym8", 1)
    inner = d.filter("y between 10 and 25 and x between 10 and 25")
    assert inner.agg(F.max(F.greatest(F.abs("lh"), F.abs("hl"), F.abs("hh")))).first()[0] < 1e-4


def test_masks(spark):
    px = [(0, 1, 2, x) for x in (3, 4, 5, 9)] + [(0, 1, 3, 3)] + [(0, 2, 2, 6), (0, 2, 2, 7)]
    lab = spark.createDataFrame(px + px[:2], "image_id long, label long, y long, x long")
    runs = G.prompts(lab, "mask")
    assert rows(runs) == [(0, 1, 2, 3, 5), (0, 1, 2, 9, 9), (0, 1, 3, 3, 3), (0, 2, 2, 6, 7)]
    assert rows(G.mask_pixels(runs)) == sorted(px)
    one = runs.withColumn("label", F.lit(7).cast("long")).unionByName(spark.createDataFrame([(0, 7, 2, 4, 6)], "image_id long, label long, y long, first_x long, last_x long"))
    assert rows(G.union_runs(one)) == [(0, 7, 2, 3, 7), (0, 7, 2, 9, 9), (0, 7, 3, 3, 3)]
    assert rows(G.mask_boxes(G.union_runs(one))) == [(0, 7, 3, 2, 10, 4, 7)]
    with pytest.raises(ValueError):
        G.prompts(lab, "outline")


def test_a_far_distance_does_not_widen_profiles(spark):
    df = spark.createDataFrame([("a", 0.4, 1.0), ("a", 5.2, 2.0), ("b", 3.0, 4.0), ("far", 1e7, 9.0)], "label string, distance double, intensity double")
    runs = P.profile_runs(df, 1.0)
    assert runs.count() <= 2 * df.count() + 3
    a = [(r.first_bin, r.last_bin, r.intensity) for r in runs.filter("label = 'a'").orderBy("first_bin").collect()]
    assert a == [(0, 0, 1.0), (1, 4, None), (5, 5, 2.0), (6, 9_999_999, None)]
    near = df.filter("label <> 'far'")
    assert P.profile_matrix(near, 1.0).count() == 2 * 6


def test_listed_labels(spark):
    c = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 5, 6), (1, 0, 2, 3)], "graph_id long, pos int, src long, dst long")
    flags = "graph_id long, labels array<int>"
    got = LB.edge_labels_listed(c, spark.createDataFrame([(0, [0, 1]), (1, [1])], flags))
    assert sorted((r.graph_id, r.pos, r.edge_label) for r in got.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1)]
    for bad in ([(0, [0, 1, 1]), (1, [1])], [(0, [0, 2]), (1, [1])], [(0, [0, 1])]):
        with pytest.raises(Exception, match="label list"):
            LB.edge_labels_listed(c, spark.createDataFrame(bad, flags)).collect()


def test_whole_tiles_stitch_alike(spark):
    """Where all tiles are whole, both forms give the same map inside; odd tiles fill it to the border."""
    t = V.tiles(spark, DIR).filter("image_id < 5")
    size = t.select("image_id").distinct()
    shapes = size.select("image_id", F.lit(20).cast("long").alias("h"), F.lit(23).cast("long").alias("w"))
    m = C.stitch_feature_map(t, shapes, 12, 2, 8)
    assert m.groupBy("image_id").count().filter("count <> 10 * 12").count() == 0
    flat = C.stitch_feature_map(t.withColumn("f", F.lit(3.5)), shapes, 12, 2, 8)
    assert flat.filter("abs(f - 3.5) > 1e-12").count() == 0
    with pytest.raises(Exception, match="full feature grid"):
        C.stitch_feature_map(t.filter("fx > 0 or tile_id > 0"), shapes, 12, 2, 8).collect()


def test_graphs_take_one_channel_and_cap_edges(spark):
    f = V.frags(spark, DIR).filter("image_id = 0")
    px = V.region(spark, DIR).filter("image_id = 0").select("image_id", "y", "x", "v")
    with pytest.raises(ValueError):
        pipelines.build_graph(f, px.withColumn("c", F.lit(0)), None, None)
    with pytest.raises(Exception, match="single channel"):
        pipelines.build_graph(f, px.unionByName(px.limit(1)), None, None)[1].collect()
    _, every = pipelines.build_graph(f, px, None, None, k=2)
    all_of = [(r.src, r.dst, r.boundary_dist_norm) for r in every.collect()]
    a, b = sorted({x[2] for x in all_of})[:2]
    _, near = pipelines.build_graph(f, px, None, None, k=2, cap_factor=(a + b) / 2)
    assert sorted((r.src, r.dst) for r in near.collect()) == sorted(x[:2] for x in all_of if x[2] <= a)


def test_merge_of_all_kinds_of_cells(spark):
    edges = [(0, 1, 0.9), (1, 0, 0.3), (1, 2, 0.8), (3, 4, 0.9), (4, 5, 0.9), (5, 3, 0.9), (6, 7, 0.9), (6, 8, 0.7), (6, 9, 0.6), (9, 10, 0.5), (11, 11, 1.0), (11, 0, 0.49)]
    s = spark.createDataFrame([(0, *e) for e in edges], "graph_id long, src long, dst long, prob double")
    n = spark.createDataFrame([(0, i, i + 100) for i in range(12)], "graph_id long, node long, label long")
    lab = spark.createDataFrame([(0, i + 100, i, 0) for i in range(12)], "image_id long, label long, y long, x long")
    record, merged, used = pipelines.merge_fragments(n, s, lab)
    cells = {}
    for r in record.collect():
        cells.setdefault((r.cell, r.topology), []).append((-1 if r.pos is None else r.pos, r.node))
    off = [v for k, v in cells.items() if k[1] == "branched"][0]
    assert {k[1]: sorted(v) for k, v in cells.items() if k[1] in ("path", "cyclic")} == {"path": [(0, 0), (1, 1), (2, 2)], "cyclic": [(0, 3), (1, 4), (2, 5)]}
    assert [n for p, n in sorted(off) if p < 0] in ([7], [8]) and [p for p, _ in sorted(off) if p >= 0] == [0, 1, 2, 3]
    assert {k for k in cells if k[1] == "singleton"} == {(4, "singleton")}
    by = {r.y: r.label for r in merged.collect()}
    assert by[0] == by[1] == by[2] == 1 and by[3] == 2 and by[11] == 4 and len(by) == 12
    assert {(r.src, r.dst, r.prob) for r in used.filter("src < 3").collect()} == {(0, 1, 0.6), (1, 0, 0.6), (1, 2, 0.8)}


def test_mixture_probabilities(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-4, 0.5, 200), rng.normal(3, 1, 300)])
    g = ML.gmm_1d(spark.createDataFrame([(float(v),) for v in x], "x double"), F.col("x"), 2)
    assert g.filter("abs(p0 + p1 - 1) > 1e-9").count() == 0  # probabilities
    assert g.filter("(x < -2 and p0 < 0.99) or (x > 1 and p1 < 0.99)").count() == 0  # components by mean


def test_main_axes_are_orthonormal(spark):
    rng = np.random.default_rng(3)
    m = rng.random((300, 5)) * [9, 4, 2, 1, 0.1] @ np.linalg.qr(rng.random((5, 5)))[0]
    fit = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "node long, vec array<double>")
    unit = spark.createDataFrame([(k, (m.mean(0) + np.eye(5)[k]).tolist()) for k in range(5)], "node long, vec array<double>")
    z = np.array([[r.pc1, r.pc2] for r in ML.pca(unit, fit, 2).orderBy("node").collect()])  # images of the unit vectors
    assert np.allclose(z.T @ z, np.eye(2), atol=1e-8)
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    r = ML.pca(fit, fit, 2).first()
    assert math.isclose(r.explained1, values[0] / values.sum(), rel_tol=1e-6) and math.isclose(r.explained2, values[1] / values.sum(), rel_tol=1e-6)


def test_held_out_folds_are_never_trained_on(spark):
    """Scores of a fold don't change with its own labels."""
    rng = np.random.default_rng(4)
    n = spark.createDataFrame([(g, g * 10 + k, g % 2, rng.random(3).tolist()) for g in range(6) for k in range(10)], "graph_id long, node long, fold int, vec array<double>").cache()
    p = spark.createDataFrame([(g, g % 2, g * 10 + a, g * 10 + b, float(rng.random()), int(rng.random() < 0.4)) for g in range(6) for a in range(10) for b in range(a)], "graph_id long, fold int, src long, dst long, prob double, true_label int").cache()
    turned = p.withColumn("true_label", F.when(F.col("fold") == 1, 1 - F.col("true_label")).otherwise(F.col("true_label")))
    a, b = ({(r.src, r.dst): r.score for r in ML.edge_classifier(x, n, [1]).collect()} for x in (p, turned))
    assert len(a) == 135 and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_pixel_forest(spark):
    """Two textures that the features tell apart; every feature has a value."""
    rng = np.random.default_rng(5)
    v = np.where(np.arange(24) < 12, 1000, 9000) + rng.integers(0, 300, (16, 24))
    f = ML.pixel_features(image(spark, v.shape, lambda y, x: int(v[y, x])).withColumn("v", F.col("v").cast("int")))
    assert f.filter(" or ".join(f"{c} is null" for c in ML.FEATURES)).count() == 0
    f = f.withColumn("label", (F.col("x") >= 12).cast("int"))
    r = ML.rf_pixels(f.filter("y % 2 = 0"), f.filter("y % 2 = 1"), "label")
    assert r.filter("cls <> label").count() <= 4 and r.filter("abs(aggregate(probability, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0


def test_merge_queries_agree(spark):
    """The label map has the cells of the record."""
    record, merged, _ = compositions.merged(spark, DIR)
    cells = {(r.graph_id, r.label): r.cell for r in record.collect()}
    f = V.frags(spark, DIR).join(merged.withColumnRenamed("label", "cell"), ["image_id", "y", "x"]).select("image_id", "label", "cell").distinct().collect()
    assert all(cells[r.image_id, r.label] == r.cell for r in f) and len(f) > 0
