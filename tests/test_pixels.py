import numpy as np
import pytest
from conftest import image
from hypothesis import HealthCheck, given, settings, strategies as hs
from pyspark.sql import functions as F

from gridloom.functions.ordering import exact_percentile, hash_rank, running_sums
from gridloom.operators import components as C, filters as N, layout, profiles as P, raster as R
from gridloom.streaming import early_stop as ES
from gridloom.operators.metrics import early_stop


def channels(spark, *arrays):
    rows = [(0, 0, c, y, x, int(a[y, x])) for c, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, z long, c long, y long, x long, v int")


def test_sum_and_stretch_flat_and_saturated(spark):
    flat = np.full((8, 8), 300)
    assert {r.v for r in R.sum_and_stretch(channels(spark, flat, flat)).collect()} == {0}
    spot = np.zeros((8, 8))
    spot[0, 0] = 65535
    got = {(r.y, r.x): r.v for r in R.sum_and_stretch(channels(spark, np.full((8, 8), 65535), spot)).collect()}
    assert got.pop((0, 0)) == 65535 and set(got.values()) == {0}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_merge_channels_by_count(spark, n):
    rng = np.random.default_rng(n)
    arrays = [rng.integers(0, 60000, (4, 5)) for _ in range(n)]
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in R.merge_channels(channels(spark, *arrays)).collect()}

    def stretch(parts):
        s = np.sum(parts, axis=0).astype(float)
        return ((s - s.min()) / (s.max() - s.min()) * 65535).astype(int)

    want = {1: lambda: [arrays[0]] * 3, 2: lambda: [stretch(arrays)] * 3, 3: lambda: arrays, 4: lambda: [*arrays[:2], stretch(arrays[2:])]}[n]()
    assert got == {(y, x): tuple(int(w[y, x]) for w in want) for y in range(4) for x in range(5)}


def test_split_channels_rejects_ragged_stacks(spark):
    pages = spark.createDataFrame([(0, p, 0, 0, 1) for p in range(7)], "image_id long, page long, y long, x long, v int")
    with pytest.raises(Exception, match="not divisible"):
        R.split_channels(pages, 3, check=True).collect()


def test_manual_slice_out_of_bounds(spark):
    st = spark.createDataFrame([(0, 0, z, 0, 0, 5) for z in range(3)], "image_id long, c long, z long, y long, x long, v int")
    with pytest.raises(Exception, match="out of bounds"):
        R.project_sharpest(st, 9).collect()


def test_manual_slice_leaves_shallow_stacks_out(spark):
    st = spark.createDataFrame([(i, 0, z, 0, 0, 5) for i, n in ((0, 7), (1, 3)) for z in range(n)], "image_id long, c long, z long, y long, x long, v int")
    assert [(r.image_id, r.z) for r in R.project_sharpest(st, 5, check=False).collect()] == [(0, 5)]


def test_pad_nearest_and_rotation_are_consistent(spark):
    a = np.arange(20).reshape(4, 5)
    im = image(spark, a.shape, lambda y, x: a[y, x])
    for k in range(4):
        got = {(r.y, r.x): r.v for r in R.rotate90(im).filter(F.col("k") == k).collect()}
        w = np.rot90(a, k)
        assert got == {(y, x): w[y, x] for y in range(w.shape[0]) for x in range(w.shape[1])}


def test_gaussian_of_small_images_reflects(spark):
    rng = np.random.default_rng(0)
    a = rng.random((9, 7))
    got = {(r.y, r.x): r.v for r in N.gaussian_blur(image(spark, a.shape, lambda y, x: a[y, x]), 1.0).collect()}
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    k /= k.sum()
    p = np.pad(a, 4, mode="symmetric")
    want = sum(k[i] * k[j] * p[i : i + 9, j : j + 7] for i in range(9) for j in range(9))
    assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(9) for x in range(7))


@pytest.mark.parametrize("paraboloid", [True, False])
def test_background_of_a_flat_image_is_the_image(spark, paraboloid):
    im = image(spark, (12, 12), lambda y, x: 0.5)
    assert all(abs(r.v) < 1e-9 for r in N.subtract_background(im, 3, paraboloid).collect())


def test_distance_transform_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.random((15, 17)) < 0.85
    rows = [(0, y, x, bool(m[y, x])) for y in range(15) for x in range(17)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, fg boolean")
    got = {(r.y, r.x): r.dist for r in N.distance_transform(df, "fg", (1.5, 1.0)).collect()}
    bg = np.argwhere(~m)
    for y, x in got:
        want = np.sqrt((((bg - [y, x]) * [1.5, 1.0]) ** 2).sum(1)).min()
        assert got[y, x] == pytest.approx(want)


def test_holes_are_filled_but_bays_are_not(spark):
    on = {(y, x) for y in range(1, 6) for x in range(1, 6)} - {(3, 3)} | {(y, x) for y in range(1, 6) for x in range(8, 12)} - {(3, 11), (3, 10)}
    rows = [(0, y, x, (y, x) in on) for y in range(8) for x in range(13)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, fg boolean")
    got = {(r.y, r.x) for r in C.fill_holes(df, tile=4).filter("fg").collect()}
    assert got == on | {(3, 3)}


def test_profile_quirks(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 20.0), ("a", 10.0, 30.0), ("b", 1.0, 5.0)], "label string, distance double, intensity double")
    z = P.zone_ratio(df).collect()
    assert [(r.label, r.tip_mean, r.body_mean) for r in z] == [("a", 15.0, 25.0)]  # 5.0 counts in both zones
    s = {r.label: r.spread for r in P.spread_and_centroid(df, 4.0).collect()}
    assert s == {"a": 10.0, "b": None}
    bins = {(r.label, r.distance) for r in P.bin_profile(df, 5.0).collect()}
    assert bins == {("a", 2.5), ("a", 7.5), ("b", 2.5)}  # a value on the last edge has no bin


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.floats(-1e3, 1e3), min_size=1, max_size=60), hs.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_percentile_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    assert exact_percentile(df, ["g"], "v", {"q": p}, 4).first().q == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_running_sums_and_hash_ranks_cover_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id"), F.lit(1).alias("one"))
    got = running_sums(df, ["g"], "id", {"n": "one"}, 16)
    assert got.groupBy("g").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("*").alias("c")).filter("m <> d OR d <> c").count() == 0
    r = hash_rank(df, ["g"], "id", 1)
    assert r.groupBy("g").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d"), F.count("*").alias("c")).filter("m <> d OR d <> c").count() == 0


def test_stream_equals_batch_across_batches(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(r, f, e, float(rng.random())) for r in ("a", "b") for f in (0, 1) for e in range(1, 61)]
    df = spark.createDataFrame(rows, ES.SCHEMA)
    src = str(tmp_path / "in")
    df.orderBy(F.rand(3)).repartition(5).write.parquet(src)  # epochs arrive out of order
    got = {(r["repeat"], r.fold): (r.best_epoch, r.stop_epoch) for r in ES.run_available(spark, src, str(tmp_path / "w"), 12, 3).collect()}
    want = {(r["repeat"], r.fold): (r.best_epoch, r.stop_epoch) for r in early_stop(df, 12, 3).collect()}
    assert got == want


def test_region_read_touches_one_directory(spark, tmp_path):
    px = spark.createDataFrame([(0, c, z, y, x, y * 8 + x) for c in range(2) for z in range(2) for y in range(8) for x in range(8)], "image_id long, c int, z int, y long, x long, v int").withColumn("level", F.lit(0))
    layout.write_chunks(px, str(tmp_path / "s"), 4)
    r = layout.read_region(spark, str(tmp_path / "s"), 0, 1, 0, 1, 1)
    assert r.count() == 16
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "PushedFilters: [IsNotNull(ty)" in plan


def test_pixel_features_hold_mean_and_vesselness(spark):
    from gridloom.operators import filters, learning

    v = np.random.default_rng(4).integers(0, 65536, (9, 11))
    df = spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(9) for x in range(11)], "image_id long, y long, x long, v long")
    f = {(r["y"], r["x"]): r for r in learning.pixel_features(df).collect()}
    ves = {(r["y"], r["x"]): r["vesselness"] for r in filters.frangi(df.withColumn("v", F.col("v") / 65535.0), [1.2, 1.6]).collect()}
    wide = np.pad(v, 1, mode="symmetric")
    for (y, x), r in f.items():
        assert r["v"] == v[y, x] and abs(r["f_mean"] - wide[y : y + 3, x : x + 3].mean()) < 1e-6 and abs(r["f_vesselness"] - ves[y, x]) < 1e-9
    assert len(f) == v.size and {"f_mean", "f_vesselness"} <= set(learning.FEATURES) and any(ves.values())


def test_bandpass_spans_zero_to_one(spark):
    v = np.random.default_rng(3).integers(0, 60000, (9, 12))
    got = [r.v for r in N.bandpass(image(spark, v.shape, lambda y, x: v[y, x]), 4, 1.5).collect()]
    assert len(got) == v.size and min(got) == 0.0 and max(got) == 1.0
    assert all(r.v == 0.0 for r in N.bandpass(image(spark, (5, 6), lambda y, x: 7), 4, 1.5).collect())


def test_stretch_truncates_whole_numbers(spark):
    """Values that the stretch maps to a whole number keep it, whatever the last bit of a percentile."""
    from fractions import Fraction

    v = np.random.default_rng(0).integers(2000, 60000, (400, 64))
    df = spark.createDataFrame([(i, 0, x, int(v[i, x])) for i in range(400) for x in range(64)], "image_id long, y long, x long, v int")
    got = {(r.image_id, r.x): r.v for r in R.contrast_stretch(df, 2.0).collect()}
    for i in range(400):
        u = sorted(int(a) for a in v[i])
        lo, hi = (u[int(p)] + (u[min(int(p) + 1, 63)] - u[int(p)]) * (p - int(p)) for p in (Fraction(63, 50), Fraction(63 * 49, 50)))
        for x in range(64):
            assert got[i, x] == (min(max(int(v[i, x]), lo), hi) - lo) * 65535 // (hi - lo)


def test_pixel_features_are_written_before_a_fit(spark):
    from gridloom.operators.learning import pixel_features

    f = pixel_features(image(spark, (6, 7), lambda y, x: 100 * y + x))
    assert f.count() == 42 and "Window" not in f._jdf.queryExecution().optimizedPlan().toString()


def test_best_shift_moves_no_pixel_once_a_shift(spark):
    v = np.random.default_rng(5).integers(0, 9000, (12, 15))
    a, b = image(spark, (9, 11), lambda y, x: v[y + 2, x + 1]), image(spark, (10, 12), lambda y, x: v[y + 1, x + 2])
    s = R.best_shift(a, b, 2)
    assert [(r.dy, r.dx) for r in s.collect()] == [(-1, 1)]
    assert "dy" not in s._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
