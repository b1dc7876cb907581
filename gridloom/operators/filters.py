"""Neighbourhood filters on dense grids, built on line windows (see functions.stencil)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions import stencil as st
from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import exact_percentile
from gridloom.operators import raster as R

IMG = ["image_id"]


def _hypot(a: str, b: str) -> Column:
    return F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))


def convolve(df: DataFrame, kernels: dict[str, list[list[float]]], keys: list[str] = IMG) -> DataFrame:
    return st.convolve(df, keys, "v", kernels, st.MIRROR)


def gaussian_blur(df: DataFrame, sigma: float, keys: list[str] = IMG, out: str = "v", border: str = st.REFLECT) -> DataFrame:
    g = st.gaussian_weights(sigma)
    return st.separable(df, keys, "v", {out: (g, g)}, border)


def sobel(df: DataFrame, keys: list[str] = IMG) -> DataFrame:
    s = st.convolve(df, keys, "v", {"gx": st.SOBEL_X, "gy": st.SOBEL_Y}, st.MIRROR)
    return s.withColumn("magnitude", _hypot("gx", "gy"))


def gaussian_gradient(df: DataFrame, sigma: float, keys: list[str] = IMG) -> DataFrame:
    g, d = st.gaussian_weights(sigma), st.gaussian_weights(sigma, order=1)
    s = st.separable(df, keys, "v", {"gx": (g, d), "gy": (d, g)}, st.NEAREST)
    return s.withColumn("magnitude", _hypot("gx", "gy"))


def laplacian(df: DataFrame, keys: list[str] = IMG, value: str = "v") -> DataFrame:
    return st.convolve(df, keys, value, {"lap": st.LAPLACIAN}, st.MIRROR)


def log_filter(df: DataFrame, sigma: float, keys: list[str] = IMG) -> DataFrame:
    b = gaussian_blur(df, sigma, keys, "_blur", st.MIRROR)
    return st.convolve(b, keys, "_blur", {"log": st.LAPLACIAN}, st.MIRROR).drop("_blur")


def marr_hildreth(df: DataFrame, sigma: float, t: float, keys: list[str] = IMG) -> DataFrame:
    """Zero crossings of the Laplacian of Gaussian: a positive pixel with a non-positive
    8-neighbour whose largest 4-neighbour step exceeds t times the image's largest magnitude."""
    g = st.gather(log_filter(df, sigma, keys), keys, "log", 1, st.NEAREST, "nb")
    around = F.flatten("nb")
    c = F.col("log")
    step = F.greatest(*[F.abs(F.col("nb")[i][j] - c) for i, j in ((0, 1), (2, 1), (1, 0), (1, 2))])
    g = g.withColumn("_cross", (c > 0) & (F.array_min(around) <= 0)).withColumn("_step", step).drop("nb")
    g = with_stats(g, keys, _top=F.max(F.abs("log")))
    return g.withColumn("edge", (F.col("_cross") & (F.col("_step") > t * F.col("_top"))).cast("int")).drop("_cross", "_step", "_top")


def median_filter(df: DataFrame, k: int, keys: list[str] = IMG) -> DataFrame:
    g = st.gather(df, keys, "v", k // 2, st.NEAREST, "nb")
    return g.withColumn("v", F.sort_array(F.flatten("nb"))[k * k // 2]).drop("nb")


def difference_of_gaussians(df: DataFrame, s1: float, s2: float, keys: list[str] = IMG) -> DataFrame:
    """Edges of |blur(s1) - blur(s2)| of the median-smoothed image, stretched, above Otsu."""
    m = median_filter(df, 3, keys)
    g1, g2 = st.gaussian_weights(s1), st.gaussian_weights(s2)
    b = st.separable(m, keys, "v", {"_a": (g1, g1), "_b": (g2, g2)}, st.MIRROR)
    b = b.withColumn("v", F.abs(F.col("_a") - F.col("_b"))).drop("_a", "_b")
    return R.otsu_edge_map(R.minmax_u16(b, keys), keys)


def bilateral_filter(df: DataFrame, d: int, sigma_value: float, sigma_space: float, keys: list[str] = IMG) -> DataFrame:
    """Edge-preserving mean over a disc: weight = space Gaussian times value Gaussian."""
    r = d // 2
    g = st.gather(df, keys, "v", r, st.MIRROR, "nb")
    num, den = F.lit(0.0), F.lit(0.0)
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            if i * i + j * j <= r * r:
                v = F.col("nb")[i + r][j + r]
                diff = v - F.col("v")
                w = F.lit(math.exp(-(i * i + j * j) / (2 * sigma_space**2))) * F.exp(-(diff * diff) / (2 * sigma_value**2))
                num, den = num + w * v, den + w
    return g.withColumn("v", num / den).drop("nb")


def bandpass(df: DataFrame, large: float, small: float, keys: list[str] = IMG) -> DataFrame:
    """Gaussian band-pass in space, rescaled to [0, 1]: detail finer than `small` and structure
    coarser than `large` are damped."""
    gs, gl = (st.gaussian_weights(math.sqrt(2) * size / math.pi) for size in (small, large))
    lo = st.separable(df, keys, "v", {"_fine": (gs, gs)}, st.REFLECT)
    b = st.separable(lo, keys, "_fine", {"_wide": (gl, gl)}, st.REFLECT)
    b = b.withColumn("v", F.col("_fine") - F.col("_wide")).drop("_fine", "_wide")
    b = with_stats(b, keys, _lo=F.min("v"), _hi=F.max("v"))
    span = F.col("_hi") - F.col("_lo")
    return b.withColumn("v", F.when(span > 1e-10, (F.col("v") - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")


def local_threshold(df: DataFrame, block: int, keys: list[str] = IMG) -> DataFrame:
    g = st.gaussian_weights((block - 1) / 6.0)
    s = st.separable(df, keys, "v", {"local_mean": (g, g)}, st.REFLECT)
    return s.withColumn("fg", F.col("v") > F.col("local_mean"))


def clahe(df: DataFrame, tile: int, clip: float, bins: int = 256, keys: list[str] = IMG) -> DataFrame:
    """Contrast-limited adaptive equalization of 16-bit values to [0, 1].

    Tile histograms are clipped at clip times the mean count, the excess is spread evenly, the
    cumulative histogram is the tile's map, and a pixel blends the maps of the four nearest tile
    centres.  A histogram has at most `bins` rows per tile whatever the image size.
    """
    t = with_stats(df, keys, _h=F.max("y") + 1, _w=F.max("x") + 1)
    t = t.withColumn("b", F.floor(F.col("v") * bins / 65536).cast("int"))
    t = t.withColumn("_ny", F.ceil(F.col("_h") / tile)).withColumn("_nx", F.ceil(F.col("_w") / tile))
    h = t.groupBy(*keys, F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"), "b").agg(F.count("*").alias("n"))
    size = h.groupBy(*keys, "ty", "tx").agg(F.sum("n").alias("area"))
    full = size.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = full.join(h, [*keys, "ty", "tx", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.greatest(F.floor(F.col("area") * clip / bins), F.lit(1))
    per_tile = W.partitionBy(*keys, "ty", "tx")
    full = full.withColumn("_cut", F.least(F.col("n"), limit))
    full = full.withColumn("_share", F.sum(F.col("n") - F.col("_cut")).over(per_tile) / bins)
    cdf = F.sum(F.col("_cut") + F.col("_share")).over(per_tile.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) / F.col("area")
    maps = full.select(*keys, "ty", "tx", "b", cdf.alias("m"))
    for p, n in (("y", "_ny"), ("x", "_nx")):
        at = (F.col(p) + 0.5) / tile - 0.5
        lo = F.floor(at)
        frac = at - lo
        top = F.col(n) - 1
        first = F.least(F.greatest(lo, F.lit(0)), top)
        second = F.least(F.greatest(lo + 1, F.lit(0)), top)
        t = t.withColumn(f"_c{p}", F.explode(F.array(F.struct(first.alias("t"), (1 - frac).alias("w")), F.struct(second.alias("t"), frac.alias("w")))))
    t = t.select(*keys, "y", "x", "b", F.col("_cy.t").alias("ty"), F.col("_cx.t").alias("tx"), (F.col("_cy.w") * F.col("_cx.w")).alias("w"))
    return t.join(maps, [*keys, "ty", "tx", "b"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("w") * F.col("m")).alias("v"))


def paraboloid_background(df: DataFrame, radius: float, keys: list[str] = IMG) -> DataFrame:
    """Grey erosion then dilation with a parabola, first along x, then along y."""
    r = math.ceil(radius)
    heights = [u * u / (radius * radius) for u in range(-r, r + 1)]

    def pass_(d: DataFrame, axis: str, sign: int, value: str, out: str) -> DataFrame:
        d = st.framed(d, keys, axis, r, {"_f": F.col(value)})
        first = F.greatest(F.col(axis) - r, F.lit(0)) - F.col(axis) + r
        add = F.transform("_f", lambda v, i: v + sign * F.get(F.array(*[F.lit(h) for h in heights]), (i + first).cast("int")))
        return d.withColumn(out, F.array_min(add) if sign > 0 else F.array_max(add)).drop("_f")

    d = df.withColumn("_b", F.col("v").cast("double"))
    for axis in ("x", "y"):
        d = pass_(d, axis, 1, "_b", "_b")
        d = pass_(d, axis, -1, "_b", "_b")
    return d.withColumnRenamed("_b", "background")


def shrink_mean(df: DataFrame, f: int, keys: list[str] = IMG) -> DataFrame:
    """Mean over an f x f window sampled every f pixels, reflected borders."""
    w = [1.0 / f if -(f // 2) <= i < f - f // 2 else 0.0 for i in range(-(f // 2), f // 2 + 1)]
    s = st.separable(df, keys, "v", {"_m": (w, w)}, st.REFLECT)
    s = s.filter((F.col("y") % f == 0) & (F.col("x") % f == 0))
    return s.select(*keys, F.expr(f"y div {f}").alias("y"), F.expr(f"x div {f}").alias("x"), F.col("_m").alias("v"))


def enlarge(small: DataFrame, f: int, sizes: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """Bilinear enlargement of `background` back to the original size."""
    s = with_stats(small, keys, _sh=F.max("y") + 1, _sw=F.max("x") + 1).join(sizes, keys)
    for p, n, m in (("y", "_sh", "h"), ("x", "_sw", "w")):
        ratio = F.col(m) / F.col(n)
        lo = F.greatest(F.floor((F.col(p) - 0.5) * ratio - 0.5), F.lit(0))
        hi = F.least(F.ceil((F.col(p) + 1.5) * ratio - 0.5), F.col(m) - 1)
        s = s.withColumn(f"t{p}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
        at = F.least(F.greatest((F.col(f"t{p}") + 0.5) * F.col(n) / F.col(m) - 0.5, F.lit(0.0)), F.col(n) - 1.0)
        s = s.withColumn(f"w{p}", 1.0 - F.abs(at - F.col(p)))
    s = s.filter((F.col("wy") > 0) & (F.col("wx") > 0))
    return s.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("background") * F.col("wy") * F.col("wx")).alias("background"))


# Shrink factor up to each radius before background morphology.
SHRINK = [(10, 1), (30, 2), (100, 4)]


def subtract_background(df: DataFrame, radius: float, paraboloid: bool, keys: list[str] = IMG, light: bool = False) -> DataFrame:
    """Rolling-ball or sliding-paraboloid background removal of values in [0, 1].

    With a `light` background the objects are dark: the image is turned over before and after.
    """
    from gridloom.operators.tiles import ball_background

    f = next((k for top, k in SHRINK if radius <= top), 8)
    value = F.col("v").cast("double")
    base = df.select(*keys, "y", "x", (1.0 - value if light else value).alias("v"))
    small = base if f == 1 else shrink_mean(base, f, keys)
    bg = (paraboloid_background if paraboloid else ball_background)(small, radius / f, keys)
    if f > 1:
        sizes = base.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        bg = enlarge(bg, f, sizes, keys)
    out = base.join(bg.select(*keys, "y", "x", "background"), [*keys, "y", "x"])
    rest = F.least(F.greatest(F.col("v") - F.col("background"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("v", 1.0 - rest if light else rest)


def grey_extreme(df: DataFrame, r: int, how: str, keys: list[str] = IMG) -> DataFrame:
    """Grey dilation ('max') or erosion ('min') with a (2r+1) square."""
    return st.extreme(df, keys, "v", r, how, "v")


def local_peaks(df: DataFrame, d: int, value: str = "v", keys: list[str] = IMG) -> DataFrame:
    """Pixels that equal the maximum of their (2d+1)^2 window."""
    return st.extreme(df, keys, value, d, "max", "_m").filter(F.col(value) == F.col("_m")).drop("_m")


def gradient_orientation(df: DataFrame, fold: bool = True, keys: list[str] = IMG) -> DataFrame:
    """Direction of the gradient turned by 90 degrees in [0, 360) or, with opposite vectors
    equal, in [0, 180); magnitude as a share of the image's largest."""
    s = sobel(df, keys)
    a = F.pmod(F.degrees(F.atan2("gy", "gx")) + 90, F.lit(360.0))
    a = F.pmod(a, F.lit(180.0)) if fold else a
    s = with_stats(s, keys, _top=F.max("magnitude"))
    return s.withColumn("angle", a).withColumn("strength", F.when(F.col("_top") > 0, F.col("magnitude") / F.col("_top")).otherwise(0.0)).drop("_top")


def structure_tensor(df: DataFrame, sigma: float, keys: list[str] = IMG) -> DataFrame:
    s = sobel(df, keys)
    for n, e in (("jxx", "gx * gx"), ("jyy", "gy * gy"), ("jxy", "gx * gy")):
        s = s.withColumn(n, F.expr(e))
    g = st.gaussian_weights(sigma)
    s = st.correlate_axis(s, keys, "y", {f"_{n}": (n, g) for n in ("jxx", "jyy", "jxy")}, st.REFLECT)
    s = st.correlate_axis(s, keys, "x", {n: (f"_{n}", g) for n in ("jxx", "jyy", "jxy")}, st.REFLECT)
    angle = 0.5 * F.degrees(F.atan2(2 * F.col("jxy"), F.col("jxx") - F.col("jyy")))
    return s.drop("_jxx", "_jyy", "_jxy").withColumn("angle", angle)


def sample_vectors(df: DataFrame, step: int, keys: list[str] = IMG) -> DataFrame:
    """Gradient on a coarse grid, turned by 90 degrees and flipped into the upper half-plane."""
    s = sobel(df, keys).filter((F.col("y") % step == step // 2) & (F.col("x") % step == step // 2))
    u, v = -F.col("gy"), F.col("gx")
    sign = F.when(v < 0, -1.0).otherwise(1.0)
    return s.select(*keys, "y", "x", (u * sign).alias("u"), (v * sign).alias("v"), (F.col("magnitude") + 1e-9).alias("magnitude"))


def non_max_suppression(df: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """Gradient magnitude kept only where it is largest along its direction (4 directions)."""
    s = sobel(df, keys)
    a = F.degrees(F.atan2("gy", "gx"))
    a = F.when(a < 0, a + 180).otherwise(a)
    g = st.gather(s, keys, "magnitude", 1, st.ZERO, "nb").withColumn("_a", a)
    nb, m = F.col("nb"), F.col("magnitude")

    def top(p, q):  # offsets as (dx, dy)
        return (m >= nb[p[0] + 1][p[1] + 1]) & (m >= nb[q[0] + 1][q[1] + 1])

    a = F.col("_a")
    keep = (
        F.when((a < 22.5) | (a >= 157.5), top((1, 0), (-1, 0)))
        .when(a < 67.5, top((1, -1), (-1, 1)))
        .when(a < 112.5, top((0, -1), (0, 1)))
        .otherwise(top((-1, -1), (1, 1)))
    )
    return g.withColumn("nms", F.when(keep, m).otherwise(0.0)).drop("nb", "_a")


def hysteresis_classes(df: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """Strong and weak edge pixels: Otsu on the 8-bit suppressed magnitude, half of it as low."""
    s = with_stats(non_max_suppression(df, keys), keys, _top=F.max("nms"))
    s = s.withColumn("_q", F.floor(F.when(F.col("_top") > 0, F.col("nms") / F.col("_top") * 255).otherwise(0.0)).cast("long"))
    t = R.otsu_threshold(s.select(*keys, F.col("_q").alias("v")), keys, eight_bit=True).select(*keys, F.col("bin").alias("_t"))
    s = s.join(t, keys).withColumn("_hi", F.col("_t") / 255.0 * F.col("_top"))
    s = s.withColumn("strong", F.col("nms") >= F.col("_hi"))
    return s.filter(F.col("nms") >= F.col("_hi") * 0.5).select(*keys, "y", "x", "strong")


def hough_lines(edges: DataFrame, n_theta: int, t: int, keys: list[str] = IMG) -> DataFrame:
    """Accumulator cells (theta index, rho) with at least t votes; an edge pixel votes once per
    angle and votes are counted before the shuffle."""
    table = F.array(*[
        F.struct(F.lit(i).alias("theta"), F.lit(math.cos(i * math.pi / n_theta)).alias("c"), F.lit(math.sin(i * math.pi / n_theta)).alias("s"))
        for i in range(n_theta)
    ])
    v = edges.withColumn("_t", F.explode(table))
    rho = F.floor(F.col("x") * F.col("_t.c") + F.col("y") * F.col("_t.s") + 0.5 + 1e-9)
    return v.groupBy(*keys, F.col("_t.theta").alias("theta"), rho.alias("rho")).agg(F.count("*").alias("votes")).filter(F.col("votes") >= t)


def frangi(df: DataFrame, scales: list[float], beta: float = 0.5, c: float = 15.0, keys: list[str] = IMG) -> DataFrame:
    """Vesselness of bright lines: the largest response over scales and the scale that gave it.

    Second derivatives are two passes of first derivatives at sigma/sqrt(2), zero outside.  Passes along y and
    along x commute, so all scales run along y in one go and then along x.
    """
    c = c / 255.0 if c > 1 else c
    out = df.withColumn("v", F.col("v").cast("double"))
    best, scale = F.lit(0.0), F.lit(0.0)
    down, across = [{}, {}], [{}, {}]
    for n, sigma in enumerate(scales):
        s = sigma / math.sqrt(2)
        trunc = 8.0 if sigma > 1 else 100.0
        g, d = st.gaussian_weights(s, trunc), st.gaussian_weights(s, trunc, 1)
        down[0] |= {f"_g{n}": ("v", g), f"_d{n}": ("v", d)}
        down[1] |= {f"_gg{n}": (f"_g{n}", g), f"_gd{n}": (f"_g{n}", d), f"_dd{n}": (f"_d{n}", d)}
        across[0] |= {f"_1{n}": (f"_gg{n}", d), f"_2{n}": (f"_gd{n}", d), f"_3{n}": (f"_dd{n}", g)}
        across[1] |= {f"_hxx{n}": (f"_1{n}", d), f"_hxy{n}": (f"_2{n}", g), f"_hyy{n}": (f"_3{n}", g)}
    out = st.correlate_steps(out, keys, "y", down, st.ZERO).drop(*down[0])
    out = st.correlate_steps(out, keys, "x", across, st.ZERO).drop(*down[1], *across[0])
    for n, sigma in enumerate(scales):
        hxx, hxy, hyy = (F.col(f"_h{k}{n}") for k in ("xx", "xy", "yy"))
        mid = (hxx + hyy) / 2
        half = (hxx - hyy) / 2
        root = F.sqrt(half * half + hxy * hxy)
        l1, l2 = (mid + root) * sigma**2, (mid - root) * sigma**2
        l2 = F.when(l2 == 0, 1e-10).otherwise(l2)
        rb, s2 = (l1 / l2) * (l1 / l2), l1 * l1 + l2 * l2
        v = F.exp(-rb / (2 * beta**2)) * (1 - F.exp(-s2 / (2 * c**2)))
        out = out.withColumn(f"_v{n}", F.when(l2 > 0, 0.0).otherwise(v)).drop(f"_hxx{n}", f"_hxy{n}", f"_hyy{n}")
        scale = F.when(F.col(f"_v{n}") > best, F.lit(float(sigma))).otherwise(scale)
        best = F.greatest(best, F.col(f"_v{n}"))
    return out.withColumn("vesselness", best).withColumn("scale", scale).drop(*[f"_v{n}" for n in range(len(scales))])


def haar_denoise(df: DataFrame, levels: int, keys: list[str] = IMG) -> DataFrame:
    """Soft-threshold denoising in the Haar basis.

    Per level every 2x2 block becomes one approximation and three details (one aggregate); the
    threshold is the universal one with the noise estimated from the finest diagonal details;
    the inverse sends each block back to its four pixels.  Sides must be multiples of 2^levels.
    """
    cur = df.select(*keys, "y", "x", F.col("v").cast("double").alias("v"))
    total = cur.groupBy(*keys).agg(F.count("*").alias("_n"))
    details = []
    for _ in range(levels):
        odd = [(0, 0), (0, 1), (1, 0), (1, 1)]
        picks = [F.max(F.when((F.col("y") % 2 == i) & (F.col("x") % 2 == j), F.col("v"))).alias(f"p{i}{j}") for i, j in odd]
        q = cur.groupBy(*keys, F.expr("y div 2").alias("by"), F.expr("x div 2").alias("bx")).agg(*picks)
        a, b, c, d = (F.col(f"p{i}{j}") for i, j in odd)
        q = q.select(*keys, F.col("by").alias("y"), F.col("bx").alias("x"), ((a + b + c + d) / 2).alias("v"),
                     ((a + b - c - d) / 2).alias("h"), ((a - b + c - d) / 2).alias("w"), ((a - b - c + d) / 2).alias("d"))
        details.append(q.drop("v"))
        cur = q.select(*keys, "y", "x", "v")
    noise = exact_percentile(details[0].select(*keys, F.abs("d").alias("u")), keys, "u", {"_med": 0.5}, 8)
    limit = noise.join(total, keys).select(*keys, (F.col("_med") / 0.6745 * F.sqrt(2 * F.log("_n"))).alias("_t"))

    def soft(c: str) -> Column:
        m = F.abs(c) - F.col("_t")
        return F.when(m > 0, F.signum(c) * m).otherwise(0.0)

    for q in reversed(details):
        j = cur.join(q.join(limit, keys), [*keys, "y", "x"])
        h, w, d = soft("h"), soft("w"), soft("d")
        kids = F.array(*[
            F.struct((F.col("y") * 2 + i).alias("y"), (F.col("x") * 2 + k).alias("x"), ((F.col("v") + (1 - 2 * i) * h + (1 - 2 * k) * w + (1 - 2 * i) * (1 - 2 * k) * d) / 2).alias("v"))
            for i in (0, 1) for k in (0, 1)
        ])
        cur = j.select(*keys, F.explode(kids).alias("k")).select(*keys, "k.y", "k.x", "k.v")
    return cur


# ---- sparse masks: set semantics, one row per foreground pixel ------------------------------


def _offsets(offs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offs]))


def diamond(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n]


def square(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1)]


def dilate(labels: DataFrame, offs: list[tuple[int, int]], sizes: DataFrame, keys: list[str] = ["image_id", "label"]) -> DataFrame:
    """Pixels reached from each object by any offset, inside the image; objects may overlap."""
    d = labels.select(*keys, "y", "x").withColumn("_o", _offsets(offs))
    d = d.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    d = d.join(sizes, "image_id").filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))
    return d.select(*keys, "y", "x").distinct()


def erode_labels(labels: DataFrame, offs: list[tuple[int, int]], keys: list[str] = ["image_id", "label"]) -> DataFrame:
    """Pixels whose whole neighbourhood carries their own label; touching objects part.

    Each pixel announces itself to the pixels that look at it; full announcements survive.
    """
    d = labels.select(*keys, "y", "x").withColumn("_o", _offsets(offs))
    own = (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)
    d = d.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), own.cast("int").alias("_own"))
    g = d.groupBy(*keys, "y", "x").agg(F.count("*").alias("_n"), F.max("_own").alias("_own"))
    return g.filter((F.col("_own") == 1) & (F.col("_n") == len(offs))).drop("_n", "_own")


def remove_small(labels: DataFrame, n: int, keys: list[str] = ["image_id", "label"]) -> DataFrame:
    return with_stats(labels, keys, _n=F.count("*")).filter(F.col("_n") >= n).drop("_n")


def nearest_on_line(df: DataFrame, keys: list[str], axis: str, at: Column, size: int | None = None) -> DataFrame:
    """Add `_n`, the distance along the axis to the nearest position `at` of the same line, null if it has none.

    Running positions inside segments, in both directions; what lies in other segments comes from one
    row a segment.
    """
    line = [*keys, st.across(axis)]
    d = df.withColumn("_s", F.expr(f"{axis} div {size or st.SEGMENT}")).withColumn("_at", at)
    ends = d.groupBy(*line, "_s").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    by = W.partitionBy(*line).orderBy("_s")
    ends = ends.select(*line, "_s", F.max("_last").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_left"), F.min("_first").over(W.partitionBy(*line).orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)).alias("_right"))
    part = W.partitionBy(*line, "_s")
    d = d.withColumn("_back", F.max("_at").over(part.orderBy(axis).rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_ahead", F.min("_at").over(part.orderBy(F.desc(axis)).rowsBetween(W.unboundedPreceding, 0)))
    d = d.join(ends, [*line, "_s"])
    near = F.least(F.col(axis) - F.coalesce("_back", "_left"), F.coalesce("_ahead", "_right") - F.col(axis))
    return d.withColumn("_n", near).drop("_s", "_at", "_back", "_ahead", "_left", "_right")


def _lower(x: list[int], h: list[float], unit: float) -> tuple[list[int], list[float]]:
    """Which parabolas h[i] + (unit * (t - x[i]))^2, by ascending x, are lowest anywhere, and from which t on."""
    keep: list[int] = []
    since: list[float] = []
    for i in range(len(x)):
        t = -math.inf
        while keep:
            k = keep[-1]
            t = ((h[i] - h[k]) / (unit * unit) + x[i] * x[i] - x[k] * x[k]) / (2.0 * (x[i] - x[k]))
            if t > since[-1]:
                break
            keep.pop()
            since.pop()
            t = -math.inf
        keep.append(i)
        since.append(t)
    return keep, since


def distance_transform(df: DataFrame, fg: str, sampling: tuple[float, float] = (1.0, 1.0), keys: list[str] = IMG, size: int | None = None) -> DataFrame:
    """Exact Euclidean distance to the nearest background pixel, anisotropic; null without background.

    Pass one finds the distance g to the nearest background along the column.  In pass two a pixel of a
    row is the parabola g^2 + dx^2, and distances are the lower envelope of the row: every segment keeps
    the parabolas of its own envelope, these are merged to the row's envelope, and a parabola gives the
    pixels of the interval where it is lowest.  The work is linear in the pixels.  Places of the image's
    rectangle without a pixel are no background and get no distance, but are looked across.
    """
    sy, sx = sampling
    site = "array<struct<x: long, g: double, lo: long, hi: long>>"

    def envelope(sites: pa.Array) -> pa.Array:
        out = []
        for row in sites.to_pylist():
            row = sorted(row, key=lambda s: s["x"])
            keep, since = _lower([s["x"] for s in row], [s["g"] * s["g"] for s in row], sx)
            first = [max(math.floor(t) + 1, 0) if t > -math.inf else 0 for t in since]
            out.append([{"x": row[i]["x"], "g": row[i]["g"], "lo": a, "hi": b} for i, a, b in zip(keep, first, [f - 1 for f in first[1:]] + [None], strict=True)])
        return pa.array(out, pa.list_(pa.struct([("x", pa.int64()), ("g", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64())])))

    lowest = F.arrow_udf(envelope, site)
    base = df.select(*keys, "y", "x", F.col(fg).alias("_fg"))
    gaps = st.missing(base, keys)
    full = base if gaps is None else base.unionByName(gaps.withColumn("_fg", F.lit(True)))
    d = nearest_on_line(full, keys, "y", F.when(~F.col("_fg"), F.col("y")), size)
    sites = d.filter("_n is not null").select(*keys, "y", F.expr(f"x div {size or st.SEGMENT}").alias("_s"), F.struct(F.col("x").cast("long").alias("x"), (F.col("_n") * sy).cast("double").alias("g")).alias("p"))
    part = sites.groupBy(*keys, "y", "_s").agg(F.collect_list("p").alias("p")).select(*keys, "y", lowest("p").alias("p"))
    row = part.groupBy(*keys, "y").agg(F.flatten(F.collect_list("p")).alias("p"))
    row = row.join(base.groupBy(*keys).agg(F.max("x").alias("_w")), keys)
    low = row.select(*keys, "y", "_w", F.explode(lowest(F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["g"].alias("g"))))).alias("s"))
    low = low.withColumn("_hi", F.least(F.coalesce("s.hi", "_w"), F.col("_w"))).filter("s.lo <= _hi")
    low = low.select(*keys, "y", "s", F.explode(F.sequence("s.lo", "_hi")).alias("x"))
    dx = (F.col("s.x") - F.col("x")) * sx
    found = low.select(*keys, "y", "x", F.sqrt(dx * dx + F.col("s.g") * F.col("s.g")).alias("dist"))
    if gaps is not None:
        found = found.join(gaps, [*keys, "y", "x"], "left_anti")
    bare = base.groupBy(*keys).agg(F.bool_and("_fg").alias("_all")).filter("_all").drop("_all")
    return found.unionByName(base.join(bare, keys, "left_semi").select(*keys, "y", "x", F.lit(None).cast("double").alias("dist")))


def skeleton_degree(skel: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """8-neighbour count per skeleton pixel with its kind."""
    d = skel.select(*keys, "y", "x").withColumn("_o", _offsets(square(1)))
    own = (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)
    d = d.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), own.cast("int").alias("_own"))
    g = d.groupBy(*keys, "y", "x").agg((F.count("*") - 1).alias("degree"), F.max("_own").alias("_own")).filter("_own = 1").drop("_own")
    kind = F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") >= 3, "branch").when(F.col("degree") == 0, "isolated").otherwise("path")
    return g.withColumn("kind", kind)


def extend_endpoints(skel: DataFrame, mask: DataFrame, n: int, sizes: DataFrame, keys: list[str] = IMG) -> DataFrame:
    """Extrapolate the last segment at every endpoint by up to n steps, up to the border or the
    first occupied pixel, and keep what lies on the mask; returns skeleton and extension."""
    ends = skeleton_degree(skel, keys).filter("kind = 'endpoint'").select(*keys, "y", "x")
    nb = skel.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    look = ends.withColumn("_o", _offsets([o for o in square(1) if o != (0, 0)]))
    look = look.select(*keys, "y", "x", (F.col("y") + F.col("_o.dy")).alias("ny"), (F.col("x") + F.col("_o.dx")).alias("nx"))
    seg = look.join(nb, [*keys, "ny", "nx"]).join(sizes, keys)
    dy, dx = F.col("y") - F.col("ny"), F.col("x") - F.col("nx")
    steps = seg.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.select(*keys, F.col("y").alias("ey"), F.col("x").alias("ex"), "h", "w", "k", (F.col("y") + F.col("k") * dy).alias("y"), (F.col("x") + F.col("k") * dx).alias("x"))
    occ = skel.select(*keys, "y", "x").withColumn("_occ", F.lit(True))
    steps = steps.join(occ, [*keys, "y", "x"], "left")
    out = (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= F.col("h")) | (F.col("x") >= F.col("w"))
    ray = W.partitionBy(*keys, "ey", "ex")  # at most n rows
    steps = steps.withColumn("_stop", F.min(F.when(out | F.col("_occ"), F.col("k"))).over(ray))
    ext = steps.filter(F.col("k") < F.coalesce("_stop", F.lit(n + 1))).select(*keys, "y", "x")
    both = skel.select(*keys, "y", "x").unionByName(ext).distinct()
    return both.join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


#: side of the tiles that segments meet, samples of a segment looked at together
SIDE = 16


def _pixel_tiles(pixels: DataFrame) -> DataFrame:
    """(image_id, ty, tx, px): tiles of SIDE pixels and the first row and column of the next, as rows of values (null: no pixel)."""
    p = pixels.select("image_id", "y", "x", "v")
    for a in ("y", "x"):
        own = F.floor(F.col(a) / SIDE)
        p = p.withColumn(f"t{a}", F.explode(F.when(F.col(a) % SIDE == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    at = ["image_id", "ty", "tx"]
    rows = p.groupBy(*at, "y").agg(*[F.max(F.when(F.col("x") - F.col("tx") * SIDE == k, F.col("v"))).alias(f"v{k}") for k in range(SIDE + 1)])
    rows = rows.select(*at, "y", F.array(*[f"v{k}" for k in range(SIDE + 1)]).alias("r"))
    t = rows.groupBy(*at).agg(*[F.max(F.when(F.col("y") - F.col("ty") * SIDE == k, F.col("r"))).alias(f"r{k}") for k in range(SIDE + 1)])
    return t.select(*at, F.array(*[f"r{k}" for k in range(SIDE + 1)]).alias("px"))


def line_profile(segments: DataFrame, pixels: DataFrame, width: int, sizes: DataFrame) -> DataFrame:
    """Samples along segments (image_id, seg, y0, x0, y1, x1): one per unit length, averaged over
    `width` parallels, bilinear, 0 outside the image.

    Stretches of a segment travel to the tiles they touch; samples are taken there, so none is shuffled alone."""
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    n = F.ceil(F.round(F.sqrt(dy * dy + dx * dx), 9) + 1)
    s = segments.select("image_id", "seg", *[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "y1", "x1")]).join(sizes.select("image_id", "h", "w"), "image_id")
    s = s.withColumn("_n", n).withColumn("_cos", F.cos(F.atan2(dy, dx))).withColumn("_sin", F.sin(F.atan2(dy, dx)))
    s = s.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {SIDE}"))))
    s = s.withColumn("_first", F.col("_k") * SIDE).withColumn("_last", F.least(F.col("_k") * SIDE + SIDE - 1, F.col("_n") - 1))

    def share(i: str) -> Column:
        return F.when(F.col("_n") > 1, F.col(i) / (F.col("_n") - 1)).otherwise(0.0)

    for a, d, turn in (("y", dy, "_cos"), ("x", dx, "_sin")):
        ends, wide = [F.col(f"{a}0") + share(e) * d for e in ("_first", "_last")], F.abs(turn) * ((width - 1) / 2) + 1e-6
        span = F.sequence(F.floor((F.least(*ends) - wide) / SIDE), F.floor((F.greatest(*ends) + wide) / SIDE))
        s = s.withColumn(f"t{a}", F.explode(span))
    s = s.join(_pixel_tiles(pixels), ["image_id", "ty", "tx"], "left")
    s = s.withColumn("i", F.explode(F.sequence("_first", "_last")))
    s = s.withColumn("_j", F.explode(F.array(*[F.lit(j - (width - 1) / 2) for j in range(width)])))
    s = s.withColumn("_y", F.round(F.col("y0") + share("i") * dy + F.col("_j") * F.col("_cos"), 9))
    s = s.withColumn("_x", F.round(F.col("x0") + share("i") * dx - F.col("_j") * F.col("_sin"), 9))
    s = s.filter((F.floor(F.col("_y") / SIDE) == F.col("ty")) & (F.floor(F.col("_x") / SIDE) == F.col("tx")))
    inside = (F.col("_y") >= 0) & (F.col("_x") >= 0) & (F.col("_y") <= F.col("h") - 1) & (F.col("_x") <= F.col("w") - 1)
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    top, left = (F.floor("_y") - F.col("ty") * SIDE).cast("int"), (F.floor("_x") - F.col("tx") * SIDE).cast("int")
    v = F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            v = v + F.coalesce(F.get(F.get("px", top + a), left + b), F.lit(0)) * ((fy if a else 1 - fy) * (fx if b else 1 - fx))
    s = s.select("image_id", "seg", "i", F.when(inside, v).otherwise(0.0).alias("v"))
    return s.groupBy("image_id", "seg", "i").agg((F.sum("v") / width).alias("v"))


def image_sizes(pixels: DataFrame, keys: list[str] = IMG) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
