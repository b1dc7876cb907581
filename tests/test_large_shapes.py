"""Long lines, uneven densities and large outlines: same results, work in proportion."""

import math

import numpy as np
import pytest
from conftest import image
from pyspark.sql import functions as F

from gridloom.functions import stencil as st
from gridloom.operators import candidates as C, filters as N, neighbours as NB, vectors as VK


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, (9, 61))
    return v, image(spark, v.shape, lambda y, x: v[y, x]).cache()


def as_array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", value).collect():
        assert np.isnan(out[r["y"], r["x"]])
        out[r["y"], r["x"]] = r[value] if r[value] is not None else -1
    return out


@pytest.mark.parametrize("size", [4, 1000])
@pytest.mark.parametrize("r", [1, 7, 70])
@pytest.mark.parametrize("how", ["max", "min"])
def test_line_extremes_in_any_segments(grid, size, r, how):
    v, df = grid
    for running in (0, 1000):
        got = as_array(st.line_extreme(df, ["image_id"], "x", "v", r, how, "m", size, running), "m", v.shape)
        want = [[getattr(row[max(0, x - r) : x + r + 1], how)() for x in range(len(row))] for row in v]
        assert (got == np.array(want)).all()


@pytest.mark.parametrize("border", [st.REFLECT, st.MIRROR, st.NEAREST, st.ZERO])
def test_filters_in_short_segments(grid, border, monkeypatch):
    v, df = grid
    kernel = {"k": [[1, 2, 3], [4, 5, 6], [7, 8, 10]]}
    w = st.gaussian_weights(1.5)
    whole = [as_array(st.convolve(df, ["image_id"], "v", kernel, border), "k", v.shape), as_array(st.separable(df, ["image_id"], "v", {"g": (w, w)}, border), "g", v.shape)]
    monkeypatch.setattr(st, "SEGMENT", 5)
    cut = [as_array(st.convolve(df, ["image_id"], "v", kernel, border), "k", v.shape), as_array(st.separable(df, ["image_id"], "v", {"g": (w, w)}, border), "g", v.shape)]
    assert all(np.allclose(a, b, atol=1e-9) and not np.isnan(a).any() for a, b in zip(whole, cut))


def test_no_window_is_longer_than_a_segment_with_halos(spark):
    line = spark.range(5000).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).cast("long").alias("y"), F.col("id").alias("x"), (F.col("id") % 7).cast("double").alias("v"))
    s = st.segmented(line, "x", 9, 100)
    assert s.groupBy("_s").count().agg(F.max("count")).first()[0] <= 118
    assert st.own(s, "x", 100).count() == 5000


def brute_distance(fg, sy, sx):
    ys, xs = np.nonzero(~fg)
    return np.array([[min((math.hypot((y - a) * sy, (x - b) * sx) for a, b in zip(ys, xs)), default=-1.0) for x in range(fg.shape[1])] for y in range(fg.shape[0])])


@pytest.mark.parametrize("share,size", [(0.5, 4096), (0.97, 4), (0.999, 7), (1.0, 16)])
def test_distance_transform(spark, share, size):
    rng = np.random.default_rng(int(share * 1000))
    fg = rng.random((17, 43)) < share
    if share == 0.999:
        fg[:] = True
        fg[11, 2] = False
    df = image(spark, fg.shape, lambda y, x: fg[y, x]).withColumn("fg", F.col("v") > 0)
    other = df.withColumn("image_id", F.lit(5).cast("long")).withColumn("fg", F.lit(False))
    out = N.distance_transform(df.unionByName(other), "fg", (2.0, 1.0), size=size)
    got = as_array(out.filter("image_id = 0"), "dist", fg.shape)
    assert np.allclose(got, brute_distance(fg, 2.0, 1.0), atol=1e-9)
    assert out.filter("image_id = 5 and dist = 0").count() == fg.size


def test_distance_of_one_background_pixel_stays_linear(spark):
    n = 40_000
    line = spark.range(n).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).cast("long").alias("y"), F.col("id").alias("x"), (F.col("id") != 17).alias("fg"))
    r = N.distance_transform(line, "fg")
    assert r.count() == n and r.filter(F.abs(F.col("dist") - F.abs(F.col("x") - 17)) > 1e-9).count() == 0


def points(spark, xy):
    return spark.createDataFrame([(0, i + 1, float(y), float(x)) for i, (y, x) in enumerate(xy)], "image_id long, label long, cy double, cx double")


@pytest.mark.parametrize("kind", ["even", "cluster", "line", "same", "few"])
def test_nearest_of_any_density(spark, kind):
    rng = np.random.default_rng(1)
    xy = {
        "even": rng.random((300, 2)) * 100,
        "cluster": np.concatenate([rng.random((250, 2)) * 1e-3, [[1e6, 1e6], [1e6, 1e6 + 1], [-5e5, 3.0]]]),
        "line": np.stack([np.zeros(120), np.arange(120.0) ** 2], 1),
        "same": np.concatenate([np.zeros((40, 2)), rng.integers(0, 4, (60, 2)).astype(float)]),
        "few": np.array([[0.0, 0.0], [3.0, 4.0], [3.0, 4.0]]),
    }[kind]
    got = {}
    for r in NB.nearest(points(spark, xy), 7).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append((r["d2"], r["j"]))
    for i, p in enumerate(xy):
        want = sorted(((float((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])), j + 1) for j, q in enumerate(xy) if j != i))[:7]
        assert got[i + 1] == want


def test_a_dense_cluster_and_an_outlier_compare_few_pairs(spark):
    rng = np.random.default_rng(2)
    n = 4000
    compared = []
    for xy in (rng.random((n, 2)), np.concatenate([rng.random((n - 1, 2)) * 1e-5, [[1e3, 1e3]]])):
        pairs, _ = NB.leaf_pairs(points(spark, xy), 6)
        compared.append(pairs.agg(F.sum(F.col("q.n") * F.col("c.n"))).first()[0])
    assert max(compared) < 400 * n, compared


def test_nearest_of_no_points(spark):
    none = spark.createDataFrame([], "image_id long, label long, cy double, cx double")
    assert NB.nearest(none, 3).columns == ["image_id", "i", "j", "d2", "rank"] and NB.nearest(none, 3).count() == 0


def test_large_outlines_compare_few_cells(spark):
    """Two wavy bands of 100,000 outline pixels, next to each other over their whole length."""
    n = 50_000
    x = F.col("id") % n
    wave = F.floor(F.sin(x / 200.0) * 60).cast("long")
    band = spark.range(2 * n).select(F.lit(0).cast("long").alias("image_id"), x.alias("x"), wave.alias("w"), F.floor(F.col("id") / n).cast("long").alias("s"))
    a = band.select("image_id", F.lit(1).cast("long").alias("label"), (F.col("w") + F.col("s") * 30).alias("y"), "x")
    b = band.select("image_id", F.lit(2).cast("long").alias("label"), (F.col("w") + 50 + F.col("s") * 30 - F.when(F.col("x") == 31_000, 15).otherwise(0) * (1 - F.col("s"))).alias("y"), "x")
    both = a.unionByName(b)
    pairs = spark.createDataFrame([(0, 1, 2)], "image_id long, i long, j long")
    _, boxes, top = C._outline_boxes(both, 8)
    assert C.outline_cell_pairs(pairs, boxes, top).count() < 1_000_000
    r = C.boundary_distance(pairs, both).collect()
    assert len(r) == 1 and r[0]["jx"] == 31_000 and r[0]["dist"] <= 5.0


def vectors(spark, m, graph=0):
    return spark.createDataFrame([(graph, i, r.tolist()) for i, r in enumerate(m)], "graph_id long, node long, vec array<double>")


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_nearest_vectors(spark, size):
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.normal(size=(60, 6)), np.zeros((5, 6)), rng.normal(size=(70, 6)) * 0.01 + 5])
    small = rng.normal(size=(4, 6))
    both = vectors(spark, m).unionByName(vectors(spark, small, 3))
    got = {}
    for r in VK.nearest_vectors(both, 5, size=size).collect():
        got.setdefault((r.graph_id, r.i), []).append((r.d, r.j))
    for g, x in ((0, m), (3, small)):
        for i in range(len(x)):
            d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
            assert sorted(got[g, i]) == sorted((float(d[j]), j) for j in range(len(x)) if j != i)[:5]


def test_clustered_vectors_meet_few_blocks(spark):
    rng = np.random.default_rng(7)
    n, centres = 20_000, rng.normal(size=(60, 16)) * 20
    m = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.05
    v = vectors(spark, m)
    b = VK.blocks(v)
    every, near = (VK.block_pairs(b).filter(c).count() for c in ("true", "low <= 1"))
    assert near < every / 4
    r = VK.nearest_vectors(v, 3)
    assert r.count() == 3 * n and r.filter("d > 1").count() == 0


@pytest.mark.parametrize("border", [st.ZERO, st.MIRROR])
def test_steps_along_an_axis_travel_once(grid, border):
    """Two passes in one go, in short segments, equal two passes one after the other."""
    _, df = grid
    a, b = st.gaussian_weights(0.8), [0.5, 0.0, -0.25]
    once = st.correlate_steps(df, ["image_id"], "x", [{"p": ("v", a)}, {"q": ("p", b)}], border, 5)
    twice = st.correlate_axis(st.correlate_axis(df, ["image_id"], "x", {"p": ("v", a)}, border), ["image_id"], "x", {"q": ("p", b)}, border)
    got, want = ({(r.y, r.x): r.q for r in d.collect()} for d in (once, twice))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
