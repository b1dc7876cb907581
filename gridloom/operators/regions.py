"""Region properties: group-bys over label pixels (image_id, label, y, x)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import exact_percentile
from gridloom.functions.rounds import dealt
from gridloom.operators.filters import diamond, square

KEYS = ["image_id", "label"]


def _announce(px: DataFrame, offs: list[tuple[int, int]]) -> DataFrame:
    """Each pixel reports to the pixels around it; own report marked."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offs]))
    d = px.select(*KEYS, "y", "x").withColumn("_o", o)
    own = (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)
    near = (F.abs("_o.dy") + F.abs("_o.dx")) == 1
    return d.select(*KEYS, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), own.alias("_own"), near.alias("_near"))


def outline(labels: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour outside their region (the image border counts as outside)."""
    g = _announce(labels, diamond(1)).groupBy(*KEYS, "y", "x").agg(F.count("*").alias("_n"), F.max(F.col("_own").cast("int")).alias("_own"))
    return g.filter("_own = 1 AND _n < 5").drop("_n", "_own")


def inner_boundary(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour of another label inside the image; background is a label too.
    A region without such pixels (it fills the image) falls back to all its pixels."""
    g = _announce(labels, diamond(1)).groupBy(*KEYS, "y", "x").agg(F.count("*").alias("_n"), F.max(F.col("_own").cast("int")).alias("_own"))
    g = g.filter("_own = 1").join(sizes, "image_id")
    def edge(c: Column) -> Column:
        return c.cast("int")

    inside = 5 - edge(F.col("y") == 0) - edge(F.col("x") == 0) - edge(F.col("y") == F.col("h") - 1) - edge(F.col("x") == F.col("w") - 1)
    g = g.withColumn("_b", F.col("_n") < inside)
    g = with_stats(g, KEYS, _any=F.max("_b"))
    return g.filter(F.col("_b") | ~F.col("_any")).select(*KEYS, "y", "x")


def region_basic(labels: DataFrame) -> DataFrame:
    """Area, centroid, half-open bounding box and extent."""
    g = labels.groupBy(*KEYS).agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("y").alias("r0"), F.min("x").alias("c0"), (F.max("y") + 1).alias("r1"), (F.max("x") + 1).alias("c1"),
    )
    return g.withColumn("extent", F.col("area") / ((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))))


def region_moments(labels: DataFrame) -> DataFrame:
    """Axis lengths, eccentricity and orientation of the ellipse with the same second moments.

    Moments come from whole numbers, so a covariance of zero is zero and an upright ellipse stands at pi/2.
    """
    def total(e: str) -> Column:
        return F.sum(F.expr(f"CAST({e} AS DECIMAL(18, 0))"))

    sums = labels.groupBy(*KEYS).agg(
        F.count("*").cast("decimal(14, 0)").alias("n"), *[total(e).alias(a) for a, e in (("sy", "y"), ("sx", "x"), ("syy", "y * y"), ("sxx", "x * x"), ("sxy", "x * y"))]
    )

    def moment(a: str, b: str) -> Column:
        return F.expr(f"CAST(n * s{a}{b} - s{a} * s{b} AS DOUBLE) / CAST(n * n AS DOUBLE)")

    m = sums.select(*KEYS, (moment("y", "y") + 1 / 12).alias("vy"), (moment("x", "x") + 1 / 12).alias("vx"), moment("x", "y").alias("vxy"))
    mid, half = (F.col("vy") + F.col("vx")) / 2, (F.col("vy") - F.col("vx")) / 2
    root = F.sqrt(half * half + F.col("vxy") * F.col("vxy"))
    m = m.withColumn("l1", mid + root).withColumn("l2", F.greatest(mid - root, F.lit(0.0)))
    same = F.abs(F.col("vy") - F.col("vx")) < 1e-9
    flat = F.when(F.col("vxy") > 1e-9, math.pi / 4).otherwise(-math.pi / 4)
    return m.select(
        *KEYS, (4 * F.sqrt("l1")).alias("major"), (4 * F.sqrt("l2")).alias("minor"),
        F.sqrt(1 - F.col("l2") / F.col("l1")).alias("eccentricity"),
        F.when(same, flat).otherwise(0.5 * F.atan2(2 * F.col("vxy"), F.col("vy") - F.col("vx"))).alias("orientation"),
    )


def region_perimeter(labels: DataFrame) -> DataFrame:
    """Perimeter from border-pixel configurations and circularity (0 without perimeter)."""
    b = _announce(outline(labels), square(1)).groupBy(*KEYS, "y", "x").agg(
        F.max(F.col("_own").cast("int")).alias("_own"), F.sum(F.when(F.col("_own"), 1).when(F.col("_near"), 2).otherwise(10)).alias("code")
    ).filter("_own = 1")
    # Length contributed by each configuration code; pixels are counted first, so the sum has one order.
    kinds = {"_a": (1.0, (5, 7, 15, 17, 25, 27)), "_b": (math.sqrt(2), (21, 33)), "_c": ((1 + math.sqrt(2)) / 2, (13, 23))}
    p = b.groupBy(*KEYS).agg(*[F.count_if(F.col("code").isin(*codes)).alias(k) for k, (_, codes) in kinds.items()])
    p = p.select(*KEYS, sum(F.col(k) * w for k, (w, _) in kinds.items()).alias("perimeter"))
    p = p.join(labels.groupBy(*KEYS).agg(F.count("*").alias("area")), KEYS)
    circ = F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0)
    return p.withColumn("circularity", circ).drop("area")


def _hull_area(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Pixels inside the convex hull of pixel diamonds, from the ends a and b of every row y."""
    pts = np.concatenate([np.c_[y, a - 0.5], np.c_[y, b + 0.5]] + [np.c_[y + s, c] for s in (-0.5, 0.5) for c in (a, b)])
    pts = np.unique(pts, axis=0)

    def chain(p):
        out: list = []
        for q in p:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return np.array(out)

    lo, hi = chain(pts), chain(pts[::-1])[::-1]
    rows = np.arange(int(y.min()), int(y.max()) + 1)

    def bound(c, take):
        ys = np.unique(c[:, 0])
        xs = np.array([take(c[c[:, 0] == v, 1]) for v in ys])
        return np.interp(rows, ys, xs)

    left = np.minimum(bound(lo, np.min), bound(hi, np.min))
    right = np.maximum(bound(lo, np.max), bound(hi, np.max))
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def region_solidity(labels: DataFrame) -> DataFrame:
    """Area over convex-hull area.  Rows shrink to the two ends of each region row first, the
    only pixels a hull can touch; the hull itself is a small helper per region, called for many regions at once."""
    ends = labels.groupBy(*KEYS, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))

    @F.arrow_udf("long")
    def hull(rows: pa.Array) -> pa.Array:
        n = np.cumsum(rows.value_lengths().to_numpy())[:-1]
        ends = [np.split(rows.flatten().field(k).to_numpy().astype(float), n) for k in range(3)]
        return pa.array([_hull_area(*r) for r in list(zip(*ends, strict=True))[: len(rows)]], pa.int64())

    r = dealt(ends, *KEYS).groupBy(*KEYS).agg(F.sum("n").alias("area"), F.collect_list(F.struct("y", "x0", "x1")).alias("rows"))
    return r.select(*KEYS, "area", hull("rows").alias("hull_area")).select(*KEYS, "hull_area", (F.col("area") / F.col("hull_area")).alias("solidity"))


def region_intensity(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    return labels.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"]).groupBy(*KEYS).agg(F.avg("v").alias("interior"))


def context_ring(labels: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """Mean over the pixels within `width` steps of a region but not in it; the region's own
    mean when that ring is empty.  Only outline pixels spread, the inside cannot reach further."""
    ring = _announce(outline(labels), diamond(width)).select(*KEYS, "y", "x").distinct()
    ring = ring.join(labels.select(*KEYS, "y", "x"), [*KEYS, "y", "x"], "left_anti")
    ctx = ring.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"]).groupBy(*KEYS).agg(F.avg("v").alias("ring"))
    r = region_intensity(labels, pixels).join(ctx, KEYS, "left")
    return r.select(*KEYS, "interior", F.coalesce("ring", "interior").alias("context"))


def node_features(labels: DataFrame, pixels: DataFrame, ring: int = 5, solidity: bool = True) -> DataFrame:
    """The eight node features, sizes relative to the image's mean area and mean major axis."""
    b = region_basic(labels).join(region_moments(labels), KEYS).join(region_perimeter(labels), KEYS).join(context_ring(labels, pixels, ring), KEYS)
    if solidity:
        b = b.join(region_solidity(labels), KEYS)
    b = with_stats(b, ["image_id"], _area=F.avg("area"), _major=F.avg(F.when(F.col("major") > 0, F.col("major"))))
    cols = [
        "circularity", "eccentricity", *(["solidity"] if solidity else []),
        (F.col("area") / F.col("_area")).alias("area_norm"), (F.col("major") / F.col("_major")).alias("major_axis_norm"),
        (F.col("minor") / F.col("_major")).alias("minor_axis_norm"), F.col("interior").alias("interior_intensity"), F.col("context").alias("context_intensity"),
    ]
    return b.select(*KEYS, *cols)


def nuclei_features(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    b = region_basic(labels).join(region_moments(labels), KEYS).join(region_perimeter(labels), KEYS).join(region_intensity(labels, pixels), KEYS)
    return b.select(*KEYS, "circularity", "eccentricity", "area", F.col("interior").alias("average_intensity"), F.col("major").alias("major_axis_length"), F.col("minor").alias("minor_axis_length"))


def filter_regions(regions: DataFrame, lo: float, hi: float, min_ecc: float) -> DataFrame:
    """Reason per region: kept, small (<= lo x mean area), large (>= hi x mean) or round."""
    s = with_stats(regions, ["image_id"], _m=F.avg("area"))
    reason = (
        F.when(F.col("area") <= F.col("_m") * lo, "small").when(F.col("area") >= F.col("_m") * hi, "large")
        .when(F.col("eccentricity") < min_ecc, "round").otherwise("kept")
    )
    return s.withColumn("reason", reason).drop("_m")


def filter_report(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("image_id", "reason").agg(F.count("*").alias("n"), F.avg("major").alias("mean_major"))


def node_box(regions: DataFrame, sizes: DataFrame, pad: float) -> DataFrame:
    """Bounding box as x1, y1, x2, y2, padded by a share of its sides, clipped to the image."""
    r = regions.join(sizes, "image_id")
    py, px = (F.col("r1") - F.col("r0")) * pad, (F.col("c1") - F.col("c0")) * pad
    return r.select(
        *KEYS, F.greatest(F.col("c0") - px, F.lit(0.0)).alias("x1"), F.greatest(F.col("r0") - py, F.lit(0.0)).alias("y1"),
        F.least(F.col("c1") + px, F.col("w").cast("double")).alias("x2"), F.least(F.col("r1") + py, F.col("h").cast("double")).alias("y2"),
    )


def centre_box(regions: DataFrame, size: float) -> DataFrame:
    h = size / 2
    return regions.select(*KEYS, (F.col("cx") - h).alias("x1"), (F.col("cy") - h).alias("y1"), (F.col("cx") + h).alias("x2"), (F.col("cy") + h).alias("y2"))


def edge_box(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Union of the endpoint boxes; `boxes` has (graph_id, node, x1, y1, x2, y2)."""
    a = boxes.select("graph_id", F.col("node").alias("src"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes.select("graph_id", F.col("node").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    e = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    f = {"x1": F.least, "y1": F.least, "x2": F.greatest, "y2": F.greatest}
    return e.select("graph_id", "src", "dst", *[f[c](f"a_{c}", f"b_{c}").alias(c) for c in f])


def centroid_edge_box(edges: DataFrame, points: DataFrame, margin: float, floor: float) -> DataFrame:
    """Box of two centroids, padded by a share of its longer side, at least `floor`."""
    a = points.select("graph_id", F.col("node").alias("src"), F.col("cy").alias("ay"), F.col("cx").alias("ax"))
    b = points.select("graph_id", F.col("node").alias("dst"), F.col("cy").alias("by"), F.col("cx").alias("bx"))
    e = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    m = F.greatest(F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))) * margin, F.lit(float(floor)))
    return e.select("graph_id", "src", "dst", (F.least("ax", "bx") - m).alias("x1"), (F.least("ay", "by") - m).alias("y1"), (F.greatest("ax", "bx") + m).alias("x2"), (F.greatest("ay", "by") + m).alias("y2"))


def crop_objects(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of every bounding box relative to its corner, 0 outside the object.

    Boxes expand to exactly their cells, so the join stays an equi-join of output size.
    """
    b = region_basic(labels).select(*KEYS, "r0", "c0", "r1", "c1")
    cells = b.withColumn("y", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("x", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    own = labels.select(*KEYS, "y", "x").join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    c = cells.join(own, [*KEYS, "y", "x"], "left")
    return c.select(*KEYS, (F.col("y") - F.col("r0")).alias("y"), (F.col("x") - F.col("c0")).alias("x"), F.coalesce("v", F.lit(0)).alias("v"))


def prompts(regions: DataFrame, mode: str, k: float = 2.0) -> DataFrame:
    """Point (truncated centre), box (bounding box) or square (centre +- k median radii) from region
    rows, or the masks themselves as runs from label pixels (see `mask_runs`)."""
    if mode == "mask":
        return mask_runs(regions)
    if mode == "point":
        return regions.select(*KEYS, F.col("cx").cast("long").alias("x"), F.col("cy").cast("long").alias("y"))
    if mode == "box":
        return regions.select(*KEYS, F.col("c0").alias("x1"), F.col("r0").alias("y1"), F.col("c1").alias("x2"), F.col("r1").alias("y2"))
    if mode == "square":
        r = regions.withColumn("radius", F.sqrt(F.col("area") / math.pi))
        med = exact_percentile(r.select("image_id", "radius"), ["image_id"], "radius", {"_r": 0.5}, 8)
        r = r.join(med, "image_id").withColumn("_s", F.floor(F.col("_r") * k))
        x, y, s = F.col("cx").cast("long"), F.col("cy").cast("long"), F.col("_s")
        return r.select(*KEYS, (x - s).alias("x1"), (y - s).alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"))
    raise ValueError(f"unknown prompt mode {mode}")


def mask_runs(labels: DataFrame) -> DataFrame:
    """Mask prompts as runs of pixels: (image_id, label, y, first_x, last_x).

    A run is what has the same difference between column and place in its row; a window holds one
    row of one object.
    """
    px = labels.select(*KEYS, "y", "x").distinct()
    run = F.col("x") - F.row_number().over(W.partitionBy(*KEYS, "y").orderBy("x"))
    return px.withColumn("_run", run).groupBy(*KEYS, "y", "_run").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x")).drop("_run")


def mask_pixels(runs: DataFrame) -> DataFrame:
    """The pixels of runs, each once."""
    return runs.select(*KEYS, "y", F.explode(F.sequence("first_x", "last_x")).alias("x")).distinct()


def union_runs(runs: DataFrame) -> DataFrame:
    """Runs of the union of masks given under one label: overlapping and touching runs become one."""
    row = W.partitionBy(*KEYS, "y").orderBy("first_x", "last_x")
    before = F.max("last_x").over(row.rowsBetween(W.unboundedPreceding, -1))
    r = runs.withColumn("_new", F.when(F.col("first_x") > before + 1, 1).when(before.isNull(), 1).otherwise(0))
    r = r.withColumn("_run", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*KEYS, "y", "_run").agg(F.min("first_x").alias("first_x"), F.max("last_x").alias("last_x")).drop("_run")


def mask_boxes(runs: DataFrame) -> DataFrame:
    """Box (half-open) and area of every mask, from runs that don't overlap."""
    return runs.groupBy(*KEYS).agg(
        F.min("first_x").alias("x1"), F.min("y").alias("y1"), (F.max("last_x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.sum(F.col("last_x") - F.col("first_x") + 1).alias("area"),
    )


def compose_masks(masks: DataFrame) -> DataFrame:
    """One label map from overlapping object masks; the later id wins."""
    return masks.groupBy("image_id", "y", "x").agg(F.max("label").alias("label"))


def offset_labels(slices: DataFrame, keys: list[str] = ["image_id", "c"]) -> DataFrame:
    """Labels unique over a stack: add the largest labels of the slices before."""
    top = slices.groupBy(*keys, "z").agg(F.max("label").alias("_m"))  # one row per slice
    w = W.partitionBy(*keys).orderBy("z").rowsBetween(W.unboundedPreceding, -1)
    off = top.select(*keys, "z", F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_off"))
    return slices.join(off, [*keys, "z"]).withColumn("label", F.when(F.col("label") > 0, F.col("label") + F.col("_off")).otherwise(0)).drop("_off")


def slice_links(labels: DataFrame, iou: float, keys: list[str] = ["image_id", "c"]) -> DataFrame:
    """Best predecessor in the slice below for every object with overlap ratio >= iou."""
    from gridloom.functions.ordering import first_by

    size = labels.groupBy(*keys, "z", "label").agg(F.count("*").alias("n"))
    below = labels.select(*keys, (F.col("z") + 1).alias("z"), "y", "x", F.col("label").alias("prev"))
    inter = labels.join(below, [*keys, "z", "y", "x"]).groupBy(*keys, "z", "label", "prev").agg(F.count("*").alias("i"))
    p = size.select(*keys, (F.col("z") + 1).alias("z"), F.col("label").alias("prev"), F.col("n").alias("np"))
    j = inter.join(size, [*keys, "z", "label"]).join(p, [*keys, "z", "prev"])
    j = j.withColumn("iou", F.col("i") / (F.col("n") + F.col("np") - F.col("i"))).filter(F.col("iou") >= iou)
    return first_by(j, [*keys, "z", "label"], [F.col("iou").desc(), F.col("prev")]).select(*keys, "z", "label", "prev", "iou")
