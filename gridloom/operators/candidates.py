"""Candidate pairs of regions and their geometric and intensity features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.columns import fold_angle, with_stats
from gridloom.functions.ordering import first_by
from gridloom.functions.rounds import materialize
from gridloom.operators.filters import line_profile
from gridloom.operators.neighbours import nearest
from gridloom.operators.vectors import nearest_vectors

P = ["image_id", "i", "j"]


def _grid(points: DataFrame, y: str, x: str) -> DataFrame:
    return points.withColumn("gy", F.floor(F.col(y) / F.col("_s"))).withColumn("gx", F.floor(F.col(x) / F.col("_s")))


def _near(query: DataFrame, points: DataFrame) -> DataFrame:
    """Equi-join of query points with the points of the 3 x 3 grid cells around them."""
    nine = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = _grid(query, "cy", "cx").withColumn("_o", F.explode(nine))
    q = q.select("image_id", "_s", F.col("label").alias("i"), F.col("cy").alias("iy"), F.col("cx").alias("ix"), (F.col("gy") + F.col("_o.a")).alias("gy"), (F.col("gx") + F.col("_o.b")).alias("gx"))
    p = _grid(points, "cy", "cx").select("image_id", "_s", F.col("label").alias("j"), F.col("cy").alias("jy"), F.col("cx").alias("jx"), "gy", "gx")
    d2 = (F.col("iy") - F.col("jy")) * (F.col("iy") - F.col("jy")) + (F.col("ix") - F.col("jx")) * (F.col("ix") - F.col("jx"))
    return q.join(p, ["image_id", "_s", "gy", "gx"]).filter("i <> j").withColumn("d2", d2)


def centroid_knn(regions: DataFrame, m: int) -> DataFrame:
    """The m nearest regions by centroid, exact: (image_id, i, j, d2, rank)."""
    return nearest(regions.select("image_id", "label", "cy", "cx"), m)


def pairs_within(regions: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of distinct centroids at most `radius` apart, by grid buckets."""
    pts = regions.select("image_id", "label", "cy", "cx").withColumn("_s", F.lit(float(radius)))
    near = _near(pts, pts).filter((F.col("i") < F.col("j")) & (F.col("d2") > 0) & (F.col("d2") <= float(radius) ** 2))
    return near.select(*P, F.sqrt("d2").alias("dist"))


def _outline_boxes(boundary: DataFrame, cell: int) -> tuple[DataFrame, DataFrame, int]:
    """Points with their smallest box (`by`, `bx`); boxes of every level with their children; the top level.

    A box of level n covers cell * 2^n pixels from the corner of its outline; the top one covers it all.
    """
    b = with_stats(boundary.select("image_id", "label", "y", "x"), ["image_id", "label"], _y=F.min("y"), _x=F.min("x"), _side=F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")))
    b = b.withColumn("by", F.expr(f"(y - _y) div {cell}")).withColumn("bx", F.expr(f"(x - _x) div {cell}"))
    top = F.ceil(F.log2(F.expr(f"_side div {cell} + 1").cast("double"))).cast("int")
    b, obs = materialize(b.withColumn("top", top).drop("_y", "_x", "_side"), top=F.max("top"))
    side = F.struct("lv", "gy", "gx", "y0", "y1", "x0", "x1")
    small = b.groupBy("image_id", "label", "top", "by", "bx").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    up = small.withColumn("lv", F.explode(F.sequence(F.lit(0), F.col("top"))))
    at = [F.expr("shiftright(by, lv)").alias("gy"), F.expr("shiftright(bx, lv)").alias("gx")]
    box = up.groupBy("image_id", "label", "top", "lv", *at).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    box = box.select("image_id", "label", "top", "lv", "gy", "gx", side.alias("box"))
    parent = box.filter("lv < top").select("image_id", "label", (F.col("lv") + 1).alias("lv"), F.expr("shiftright(gy, 1)").alias("gy"), F.expr("shiftright(gx, 1)").alias("gx"), "box")
    kids = parent.groupBy("image_id", "label", "lv", "gy", "gx").agg(F.collect_list("box").alias("kids"))
    boxes, _ = materialize(box.join(kids, ["image_id", "label", "lv", "gy", "gx"], "left"))
    return b, boxes, obs["top"]


def outline_cell_pairs(pairs: DataFrame, boxes: DataFrame, top: int) -> DataFrame:
    """(image_id, i, j, a, b): the pairs of smallest boxes that may hold the nearest points of a pair of outlines.

    All pairs start with one box a side and are opened level by level, on both sides at once; a pair
    of boxes goes when its smallest distance exceeds the largest one of some other pair of boxes.
    """

    def roots(k: str, name: str) -> DataFrame:
        return boxes.filter("lv = top").select("image_id", F.col("label").alias(k), F.col("box").alias(name))

    low, up = F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in ("y", "x"):
        gap = F.greatest(F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.lit(0))
        far = F.greatest(F.col(f"a.{c}1") - F.col(f"b.{c}0"), F.col(f"b.{c}1") - F.col(f"a.{c}0"))
        low, up = low + gap * gap, up + far * far
    c = pairs.select(*P).distinct().join(roots("i", "a"), ["image_id", "i"]).join(roots("j", "b"), ["image_id", "j"])
    for level in range(top - 1, -1, -1):
        for k, name in (("i", "a"), ("j", "b")):
            wide = boxes.filter(F.col("lv") == level + 1).select("image_id", F.col("label").alias(k), F.col("gy").alias("_y"), F.col("gx").alias("_x"), F.lit(level + 1).alias("_l"), "kids")
            on = c.withColumn("_l", F.col(f"{name}.lv")).withColumn("_y", F.col(f"{name}.gy")).withColumn("_x", F.col(f"{name}.gx"))
            c = on.join(wide, ["image_id", k, "_l", "_y", "_x"], "left").withColumn(name, F.explode(F.coalesce("kids", F.array(name)))).select(*P, "a", "b")
        c, _ = materialize(c.withColumn("low", low).withColumn("up", up))
        c = with_stats(c, P, _best=F.min("up")).filter("low <= _best").select(*P, "a", "b")
    return c


def boundary_distance(pairs: DataFrame, boundary: DataFrame, cell: int = 8) -> DataFrame:
    """Smallest distance between the outlines of two regions and the pair of points there.

    Outlines are hierarchies of boxes (see `outline_cell_pairs`), so far sides of large outlines never
    meet, and only points of the smallest boxes that may decide are compared.  A smallest box travels as
    one row with its points, at most cell * cell; the points meet after the joins, where their distances
    collapse to one number before anything is shuffled again.
    """
    points, boxes, top = _outline_boxes(boundary, cell)
    c = outline_cell_pairs(pairs, boxes, top)
    small = points.groupBy("image_id", "label", "by", "bx").agg(F.min("y").alias("oy"), F.min("x").alias("ox"), F.collect_set(F.struct("y", "x")).alias("pts"))

    def side(k: str, name: str) -> DataFrame:
        return small.select("image_id", F.col("label").alias(k), F.struct("by", "bx").alias(name), *[F.col(v).alias(f"{k}_{v}") for v in ("oy", "ox", "pts")])

    q = c.select(*P, *[F.struct(F.col(f"{n}.gy").alias("by"), F.col(f"{n}.gx").alias("bx")).alias(n) for n in ("a", "b")])
    q = q.join(side("i", "a"), ["image_id", "i", "a"]).join(side("j", "b"), ["image_id", "j", "b"])
    at = [f"{k}_{v}" for k in "ij" for v in ("oy", "ox")]
    q = q.withColumn("p", F.explode("i_pts")).select(*P, *at, "p", F.explode("j_pts").alias("q"))
    dy, dx = F.col("p.y") - F.col("q.y"), F.col("p.x") - F.col("q.x")
    # (d2, iy, ix, jy, jx) as digits of one number: places inside a box are below `cell`
    code = dy * dy + dx * dx
    for k, v in (("i", "p"), ("j", "q")):
        for z in ("y", "x"):
            code = code * cell + (F.col(f"{v}.{z}") - F.col(f"{k}_o{z}"))
    best = q.groupBy(*P, *at).agg(F.min(code).alias("code"))

    def digit(n: int) -> Column:
        return F.expr(f"code div {cell ** n} % {cell}")

    d2 = F.expr(f"code div {cell ** 4}")
    m = F.struct(d2.alias("d2"), *[(F.col(f"{k}_o{z}") + digit(3 - n)).alias(f"{k}{z}") for n, (k, z) in enumerate(("iy", "ix", "jy", "jx"))])
    best = best.groupBy(*P).agg(F.min(m).alias("m"))
    return best.select(*P, F.sqrt("m.d2").alias("dist"), "m.iy", "m.ix", "m.jy", "m.jx")


def knn_edges(regions: DataFrame, boundary: DataFrame, k: int = 6, mult: int = 3, cap: float | None = None) -> DataFrame:
    """Unordered pairs where one is among the other's k nearest by outline distance; candidates
    are the mult*k nearest by centroid; ties go to the nearer centroid.  Each pair's outline
    distance is computed once for both directions."""
    cand, _ = materialize(centroid_knn(regions, mult * k))  # read for the pairs and for their ranks
    und = cand.select("image_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    dist = boundary_distance(und, boundary)
    d = cand.select("image_id", F.col("i").alias("from"), "rank", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(dist, P)
    top = first_by(d, ["image_id", "from"], [F.col("dist"), F.col("rank")], k)
    if cap is not None:
        top = top.filter(F.col("dist") <= cap)
    return top.drop("from", "rank").dropDuplicates(P)


def contact_share(boundary: DataFrame, tau: float) -> DataFrame:
    """For every ordered pair of labels, how many outline points of the first lie within tau of
    the second: (image_id, label, other, n).  Points look up the fixed disc of offsets, so only
    pairs in contact appear."""
    r = int(tau)
    disc = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= tau * tau])
    a = boundary.withColumn("_o", F.explode(disc))
    a = a.select("image_id", "label", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    b = boundary.select("image_id", F.col("label").alias("other"), "y", "x")
    hit = a.join(b, ["image_id", "y", "x"]).filter("label <> other").select("image_id", "label", "other", "py", "px").distinct()
    return hit.groupBy("image_id", "label", "other").agg(F.count("*").alias("n"))


def _inner_mean(prof: DataFrame) -> DataFrame:
    """Mean of a profile without its two ends (with them when it has two samples or fewer)."""
    s = with_stats(prof, ["image_id", "seg"], _n=F.count("*"))
    s = s.filter((F.col("_n") <= 2) | ((F.col("i") > 0) & (F.col("i") < F.col("_n") - 1)))
    return s.groupBy("image_id", "seg").agg(F.avg("v").alias("gap_intensity"))


def edge_features(
    edges: DataFrame, shapes: DataFrame, boundary: DataFrame, pixels: DataFrame, sizes: DataFrame,
    contact_tau: float = 2.0, gap_width: int = 3, reach: float = 5.0,
) -> DataFrame:
    """The ten features of every edge of `knn_edges`; `shapes` has area, major, orientation."""
    s = with_stats(shapes.select("image_id", "label", "area", "major", "orientation"), ["image_id"], _major=F.avg(F.when(F.col("major") > 0, F.col("major"))))
    nb = boundary.groupBy("image_id", "label").agg(F.count("*").alias("nb"))
    s = s.join(nb, ["image_id", "label"])

    def end(k: str) -> DataFrame:
        cols = ["area", "orientation", "nb"] + (["_major"] if k == "i" else [])
        return s.select("image_id", F.col("label").alias(k), *[F.col(c).alias(c if c == "_major" else f"{k}_{c}") for c in cols])

    e = edges.join(end("i"), ["image_id", "i"]).join(end("j"), ["image_id", "j"])
    e = e.withColumn("seg", F.struct("i", "j"))
    dy, dx = (F.col("jy") - F.col("iy")).cast("double"), (F.col("jx") - F.col("ix")).cast("double")
    e = e.withColumn("_len", F.sqrt(dy * dy + dx * dx)).withColumn("_path", F.atan2(dx, dy))
    e, _ = materialize(e)  # read by the gap, the inward profiles and the result
    dy, dx = (F.col("jy") - F.col("iy")).cast("double"), (F.col("jx") - F.col("ix")).cast("double")

    gap = e.select("image_id", "seg", F.col("iy").alias("y0"), F.col("ix").alias("x0"), F.col("jy").alias("y1"), F.col("jx").alias("x1"))
    gaps = _inner_mean(line_profile(gap, pixels, gap_width, sizes))

    uy, ux = dy / F.col("_len") * reach, dx / F.col("_len") * reach
    inward = e.select("image_id", F.explode(F.array(
        F.struct(F.struct("i", "j", F.lit(0).alias("k")).alias("seg"), F.col("iy").cast("double").alias("y0"), F.col("ix").cast("double").alias("x0"), (F.col("iy") - uy).alias("y1"), (F.col("ix") - ux).alias("x1")),
        F.struct(F.struct("i", "j", F.lit(1).alias("k")).alias("seg"), F.col("jy").cast("double").alias("y0"), F.col("jx").cast("double").alias("x0"), (F.col("jy") + uy).alias("y1"), (F.col("jx") + ux).alias("x1")),
    )).alias("s")).select("image_id", "s.*")
    prof = line_profile(inward, pixels, 1, sizes).select("image_id", F.col("seg.i").alias("a"), F.col("seg.j").alias("b"), F.col("seg.k").alias("k"), "i", "v")
    both = prof.groupBy("image_id", "a", "b", "i").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("p"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("q"))
    both = both.filter("p IS NOT NULL AND q IS NOT NULL")  # common length of the two
    ok = (F.count("*") >= 3) & (F.stddev_pop("p") > 1e-9) & (F.stddev_pop("q") > 1e-9)
    cont = both.groupBy("image_id", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.when(ok, F.corr("p", "q")).otherwise(0.0).alias("intensity_continuity"))

    small_i = F.col("i_area") <= F.col("j_area")
    e = e.withColumn("label", F.when(small_i, F.col("i")).otherwise(F.col("j"))).withColumn("other", F.when(small_i, F.col("j")).otherwise(F.col("i")))
    e = e.join(contact_share(boundary, contact_tau), ["image_id", "label", "other"], "left")
    e = e.join(gaps, ["image_id", "seg"]).join(cont, ["image_id", "i", "j"])
    n1, n2 = fold_angle(F.col("_path") - F.col("i_orientation")), fold_angle(F.col("_path") - F.col("j_orientation"))
    turn = F.col("i_orientation") - F.col("j_orientation")
    return e.select(
        *P, "gap_intensity", (F.col("dist") / F.col("_major")).alias("boundary_dist_norm"), n1.alias("node1_angle_diff"), n2.alias("node2_angle_diff"),
        F.least(n1, n2).alias("min_diff_angle"), fold_angle(turn).alias("relative_angle"),
        (F.coalesce("n", F.lit(0)) / F.when(small_i, F.col("i_nb")).otherwise(F.col("j_nb"))).alias("contact_frac"),
        (F.least("i_area", "j_area") / F.greatest("i_area", "j_area")).alias("area_ratio"),
        F.abs(F.cos(turn)).alias("axis_collinearity"), "intensity_continuity",
    )


def path_features(pairs: DataFrame, regions: DataFrame, pixels: DataFrame, mask: DataFrame, sizes: DataFrame, width: int = 3) -> DataFrame:
    """Six features of the straight path between two centroids; masked pixels count as 0 and the
    intensity is the mean of the positive samples."""
    s = with_stats(regions.select("image_id", "label", "cy", "cx", "major", "orientation"), ["image_id"], _major=F.avg("major"))

    def end(k: str) -> DataFrame:
        return s.select("image_id", F.col("label").alias(k), F.col("cy").alias(f"{k}cy"), F.col("cx").alias(f"{k}cx"), F.col("orientation").alias(f"{k}o"), *(["_major"] if k == "i" else []))

    e = pairs.join(end("i"), ["image_id", "i"]).join(end("j"), ["image_id", "j"]).withColumn("seg", F.struct("i", "j"))
    e, _ = materialize(e)  # read by the profiles and the result
    seg = e.select("image_id", "seg", F.col("icy").alias("y0"), F.col("icx").alias("x0"), F.col("jcy").alias("y1"), F.col("jcx").alias("x1"))
    open_px = pixels.select("image_id", "y", "x", "v").join(mask.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")
    prof = line_profile(seg, open_px, width, sizes)
    mean = prof.groupBy("image_id", "seg").agg(F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("average_intensity"))
    e = e.join(mean, ["image_id", "seg"])
    path = F.atan2(F.col("jcx") - F.col("icx"), F.col("jcy") - F.col("icy"))
    n1, n2 = fold_angle(path - F.col("io")), fold_angle(path - F.col("jo"))
    return e.select(
        *P, "average_intensity", (F.col("dist") / F.col("_major")).alias("length"), n1.alias("node1_angle_diff"), n2.alias("node2_angle_diff"),
        F.least(n1, n2).alias("min_diff_angle"), fold_angle(F.col("io") - F.col("jo")).alias("relative_angle"),
    )


def connectivity_score(paths: DataFrame, width: int = 3) -> DataFrame:
    """Path intensity x width x cosine of the smaller angle, min-max per image, times a Gaussian
    prior on the distance (mean 5, deviation 2.5 region lengths)."""
    raw = F.col("average_intensity") * width * F.cos(F.col("min_diff_angle") * (math.pi / 2))
    s = with_stats(paths.withColumn("_raw", raw), ["image_id"], _lo=F.min("_raw"), _hi=F.max("_raw"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    d = F.col("length") - 5.0
    return s.withColumn("score", (F.col("_raw") - F.col("_lo")) / span * F.exp(-(d * d) / (2 * 2.5**2))).drop("_raw", "_lo", "_hi")


def vector_knn(vectors: DataFrame, k: int) -> DataFrame:
    """Exact k nearest vectors inside each graph: (graph_id, i, j, d), d rounded to 9 places."""
    return nearest_vectors(vectors, k)


def dedupe_pairs(directed: DataFrame, value: str) -> DataFrame:
    """Value of one representative per unordered pair (its smaller source) for both directions."""
    lo, hi = F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")
    rep = directed.groupBy("graph_id", lo, hi).agg(F.min_by(value, "src").alias(value))
    d = directed.drop(value).withColumn("_lo", F.least("src", "dst")).withColumn("_hi", F.greatest("src", "dst"))
    return d.join(rep, ["graph_id", "_lo", "_hi"]).drop("_lo", "_hi")


def stitch_tiles(tiles: DataFrame, grid_w: int, tile: int, halo: int, cells: int) -> DataFrame:
    """Feature map from tiles of cells x cells with a halo on every side.

    One cell spans (tile + 2 halo) / cells pixels; the halo cells drop out and the inner cells
    move to their tile's place.  Tiles that do not carry a whole grid are rejected.
    """
    ppf = (tile + 2 * halo) / cells
    h = round(halo / ppf)
    inner = cells - 2 * h
    bad = F.raise_error(F.lit("tile without a full feature grid")).cast("boolean")
    whole = tiles.groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = whole.filter(F.when(F.col("_n") == cells * cells, F.lit(True)).otherwise(bad)).drop("_n")  # a filter sees every tile
    t = tiles.filter((F.col("fy") >= h) & (F.col("fy") < cells - h) & (F.col("fx") >= h) & (F.col("fx") < cells - h))
    t = t.join(whole, ["image_id", "tile_id"])
    return t.select(
        "image_id", (F.expr(f"tile_id div {grid_w}") * inner + F.col("fy") - h).alias("fy"),
        (F.col("tile_id") % grid_w * inner + F.col("fx") - h).alias("fx"), "f", F.lit(float(ppf)).alias("pixels_per_feature"),
    )


def stitch_feature_map(tiles: DataFrame, shapes: DataFrame, tile: int, halo: int, cells: int) -> DataFrame:
    """Feature map of whole images (image_id, h, w) from tiles of any size, as they come at the borders.

    Every tile carries cells x cells features of its outer block: the inner block and a halo, both cut
    at the border.  The features of the inner block go to its slot of the map; where their numbers
    differ they are resized bilinearly, each target cell asking its (up to) four neighbours.
    """
    ppf = (tile + 2 * halo) / cells
    t = tiles.groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("_n")).join(shapes.select("image_id", "h", "w"), "image_id")
    bad = F.raise_error(F.lit("tile without a full feature grid")).cast("bigint")
    t = t.withColumn("tile_id", F.when(F.col("_n") == cells * cells, F.col("tile_id")).otherwise(bad)).withColumn("_gw", F.ceil(F.col("w") / tile))
    for a, side, at in (("y", "h", F.expr("tile_id div _gw")), ("x", "w", F.expr("tile_id % _gw"))):
        begin, full = at * tile, F.col(side)
        end = F.least(begin + tile, full)
        first = F.greatest(begin - halo, F.lit(0))
        outer = F.least(end + halo, full) - first
        t = t.withColumn(f"{a}f", F.bround((begin - first) * cells / outer)).withColumn(f"{a}n", F.bround((end - first) * cells / outer) - F.col(f"{a}f"))
        t = t.withColumn(f"{a}t", F.bround(begin / ppf)).withColumn(f"{a}m", F.least(F.bround(end / ppf), F.ceil(full / ppf)) - F.col(f"{a}t"))
        t = t.filter(F.col(f"{a}m") > 0).withColumn(f"{a}k", F.explode(F.sequence(F.lit(0), F.col(f"{a}m").cast("int") - 1)))
        src = F.greatest((F.col(f"{a}k") + 0.5) * F.col(f"{a}n") / F.col(f"{a}m") - 0.5, F.lit(0.0))
        t = t.withColumn(f"{a}s", src).withColumn(f"{a}w", F.col(f"{a}s") - F.floor(f"{a}s"))
        two = [(F.floor(f"{a}s"), 1 - F.col(f"{a}w")), (F.least(F.floor(f"{a}s") + 1, F.col(f"{a}n") - 1), F.col(f"{a}w"))]
        two = F.array(*[F.struct((F.col(f"{a}f") + p).cast("long").alias("p"), q.alias("q")) for p, q in two])
        t = t.withColumn(f"{a}c", F.explode(F.filter(two, lambda c: c["q"] > 0)))
    t = t.select("image_id", "tile_id", F.col("yc.p").alias("fy"), F.col("xc.p").alias("fx"), (F.col("yt") + F.col("yk")).cast("long").alias("ty"), (F.col("xt") + F.col("xk")).cast("long").alias("tx"), (F.col("yc.q") * F.col("xc.q")).alias("q"))
    j = t.join(tiles.select("image_id", "tile_id", "fy", "fx", "f"), ["image_id", "tile_id", "fy", "fx"])
    g = j.groupBy("image_id", F.col("ty").alias("fy"), F.col("tx").alias("fx")).agg(F.sum(F.col("f") * F.col("q")).alias("f"))
    return g.withColumn("pixels_per_feature", F.lit(float(ppf)))


def roi_pool(features: DataFrame, boxes: DataFrame, n: int, block: int = 8) -> DataFrame:
    """n x n averages of the feature cells inside each box (image_id, box, y1, x1, y2, x2 in
    cells).  A box expands to the blocks of cells it touches, meets their cells in an equi-join and
    keeps those it covers, so no cell of a box is a row before the join."""
    b, f = boxes, features.select("image_id", "fy", "fx", "f")
    for a in ("y", "x"):
        lo, hi = F.floor(F.col(f"{a}1")), F.greatest(F.ceil(F.col(f"{a}2")) - 1, F.floor(F.col(f"{a}1")))
        b = b.withColumn(f"_{a}0", lo.cast("long")).withColumn(f"_{a}1", hi.cast("long"))
        b = b.withColumn(f"_k{a}", F.explode(F.sequence(F.floor(F.col(f"_{a}0") / block), F.floor(F.col(f"_{a}1") / block))))
        f = f.withColumn(f"_k{a}", F.floor(F.col(f"f{a}") / block))
    j = b.join(f, ["image_id", "_ky", "_kx"]).filter("fy between _y0 and _y1 and fx between _x0 and _x1")
    for a in ("y", "x"):
        side = F.greatest(F.col(f"{a}2") - F.col(f"{a}1"), F.lit(1e-9))
        at = F.floor((F.col(f"f{a}") + 0.5 - F.col(f"{a}1")) / side * n)
        j = j.withColumn(f"b{a}", F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int"))
    return j.groupBy("image_id", "box", "by", "bx").agg(F.avg("f").alias("f"))
