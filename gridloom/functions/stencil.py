"""Neighbourhoods on dense pixel grids (coordinates from 0, no gaps).

A two-dimensional window is gathered line by line: first along y, partitioned by (image, x),
then along x, partitioned by (image, y).  A line is cut into segments of fixed length; pixels less
than r away from a segment are its halo and are copied to it.  So no window partition is longer than
a segment and two halos, whatever the image, no pixel is copied (2r+1)^2 times, and both passes stay
inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.rounds import materialize

REFLECT, MIRROR, NEAREST, ZERO = "reflect", "mirror", "nearest", "zero"


#: pixels of a line in one window partition, besides its halos
SEGMENT = 4096
#: radius from which running extremes pay
RUNNING = 6


def missing(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, y, x) of the places of an image's rectangle that hold no pixel, None if there are none;
    only short lines are looked into."""
    at = df.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    per = at.groupBy(*keys, "y").agg(F.count("*").alias("_n"), F.max("x").alias("_w"))
    size = per.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("_w").alias("_w"))
    lines = size.select(*keys, "_w", F.explode(F.sequence(F.lit(0).cast("long"), "_h")).alias("y"))
    lines = lines.join(per.drop("_w"), [*keys, "y"], "left")
    short, seen = materialize(lines.filter("coalesce(_n, 0) <= _w").select(*keys, "y", "_w"), n=F.count("*"))
    if not seen["n"]:
        return None
    held = short.join(at, [*keys, "y"], "left").groupBy(*keys, "y", "_w").agg(F.collect_list("x").alias("_x"))
    return materialize(held.select(*keys, "y", F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), "_w"), "_x")).alias("x")))[0]


def across(axis: str) -> str:
    return "x" if axis == "y" else "y"


def segmented(df: DataFrame, axis: str, r: int, size: int | None = None) -> DataFrame:
    """Every pixel once for each segment (`_s`) of its line that it belongs to or is a halo of."""
    n = size or SEGMENT
    return df.withColumn("_s", F.explode(F.expr(f"sequence(greatest(({axis} - {r}) div {n}, 0), ({axis} + {r}) div {n})")))


def own(df: DataFrame, axis: str, size: int | None = None) -> DataFrame:
    """The pixels of the segments themselves."""
    return df.filter(F.col("_s") == F.expr(f"{axis} div {size or SEGMENT}")).drop("_s")


def segment(keys: list[str], axis: str):
    """The window partition of a segment, in the order of its pixels."""
    return W.partitionBy(*keys, across(axis), "_s").orderBy(axis)


def framed(df: DataFrame, keys: list[str], axis: str, r: int, frames: dict[str, Column], size: int | None = None) -> DataFrame:
    """Lists of the values from r pixels before to r pixels after each pixel of a line."""
    win = segment(keys, axis).rowsBetween(-r, r)
    return own(segmented(df, axis, r, size).withColumns({out: F.collect_list(v).over(win) for out, v in frames.items()}), axis, size)


def _padded(frame: str, axis: str, r: int, border: str, zero: str = "0D") -> Column:
    """The clipped frame completed to 2r+1 values by the border rule.

    Inner pixels keep the frame as it is; only border pixels evaluate the index mapping.
    """
    start = f"greatest({axis} - {r}, 0)"
    last = f"({start} + size({frame}) - 1)"
    i = f"({axis} + k)"
    mapped = {
        REFLECT: f"CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} > {last} THEN 2 * {last} + 1 - {i} ELSE {i} END",
        MIRROR: f"CASE WHEN {i} < 0 THEN -{i} WHEN {i} > {last} THEN 2 * {last} - {i} ELSE {i} END",
        NEAREST: f"least(greatest({i}, 0), {last})",
        ZERO: i,
    }[border]
    value = f"get({frame}, CAST(({mapped}) - {start} AS INT))"
    if border == ZERO:
        value = f"coalesce({value}, {zero})"
    return F.expr(
        f"CASE WHEN size({frame}) = {2 * r + 1} THEN {frame} ELSE transform(sequence(-{r}, {r}), k -> {value}) END"
    )


def correlate_axis(
    df: DataFrame, keys: list[str], axis: str, weights: dict[str, tuple[str, list[float]]], border: str
) -> DataFrame:
    """One-dimensional weighted sums along an axis: {output: (input, 2r+1 weights)}."""
    return correlate_steps(df, keys, axis, [weights], border)


def correlate_steps(
    df: DataFrame, keys: list[str], axis: str, steps: list[dict[str, tuple[str, list[float]]]], border: str, size: int | None = None
) -> DataFrame:
    """Weighted sums of weighted sums along one axis: every step reads the columns of those before it.

    The halos of a segment are as wide as all radii together, so the rows travel once for all steps; what a
    step makes of the outer end of a halo is not used by the pixels of the segment.
    """
    radii = [max(len(w) // 2 for _, w in weights.values()) for weights in steps]
    df = segmented(df, axis, sum(radii), size)
    for r, weights in zip(radii, steps, strict=True):
        frames = {src: f"_f_{src}" for src in dict.fromkeys(s for s, _ in weights.values())}
        if border == ZERO:  # no frame: places beyond the line are the default of the neighbour
            near = {f"{f}_{k}": F.lag(F.col(src).cast("double"), r - k, 0.0).over(segment(keys, axis)) for src, f in frames.items() for k in range(2 * r + 1)}
            df = df.withColumns(near)
            sums = {}
            for out, (src, w) in weights.items():
                at = r - len(w) // 2
                sums[out] = F.expr(" + ".join(f"`{frames[src]}_{at + k}` * {float(c)!r}D" for k, c in enumerate(w) if c != 0))
            df = df.withColumns(sums).drop(*near)
            continue
        win = segment(keys, axis).rowsBetween(-r, r)
        df = df.withColumns({f: F.collect_list(F.col(src).cast("double")).over(win) for src, f in frames.items()})
        df = df.withColumns({f: _padded(f, axis, r, border) for f in frames.values()})
        sums = {}
        for out, (src, w) in weights.items():
            at = r - len(w) // 2
            sums[out] = F.expr(" + ".join(f"{frames[src]}[{at + k}] * {float(c)!r}D" for k, c in enumerate(w) if c != 0))
        df = df.withColumns(sums).drop(*frames.values())
    return own(df, axis, size)


def separable(
    df: DataFrame, keys: list[str], value: str, outs: dict[str, tuple[list[float], list[float]]], border: str
) -> DataFrame:
    """Separable filters {output: (weights along y, weights along x)} in two passes."""
    down = {f"_y_{o}": (value, wy) for o, (wy, _) in outs.items()}
    df = correlate_axis(df, keys, "y", down, border)
    across = {o: (f"_y_{o}", wx) for o, (_, wx) in outs.items()}
    return correlate_axis(df, keys, "x", across, border).drop(*down)


def gather(df: DataFrame, keys: list[str], value: str, r: int, border: str, out: str = "nb") -> DataFrame:
    """Add the (2r+1)^2 window as nested arrays: out[dx + r][dy + r]."""
    n = 2 * r + 1
    df = framed(df, keys, "y", r, {"_f": F.col(value).cast("double")})
    df = df.withColumn("_f", _padded("_f", "y", r, border))
    df = framed(df, keys, "x", r, {out: F.col("_f")})
    return df.withColumn(out, _padded(out, "x", r, border, f"array_repeat(0D, {n})")).drop("_f")


def gather_held(df: DataFrame, keys: list[str], value: str, r: int, out: str = "nb") -> DataFrame:
    """Add the (2r+1)^2 window as nested arrays of records, out[dx + r][dy + r].v, null where no pixel holds a value."""
    n, none = 2 * r + 1, "named_struct('v', CAST(NULL AS DOUBLE))"
    df = framed(df, keys, "y", r, {"_f": F.struct(F.col(value).cast("double").alias("v"))})
    df = df.withColumn("_f", _padded("_f", "y", r, ZERO, none))
    df = framed(df, keys, "x", r, {out: F.col("_f")})
    return df.withColumn(out, _padded(out, "x", r, ZERO, f"array_repeat({none}, {n})")).drop("_f")


def convolve(
    df: DataFrame, keys: list[str], value: str, kernels: dict[str, list[list[float]]], border: str
) -> DataFrame:
    """Correlate with several small 2-D kernels at once; every kernel becomes a column."""
    r = max(len(k) for k in kernels.values()) // 2
    df = gather(df, keys, value, r, border, "_nb")
    sums = {}
    for name, k in kernels.items():
        at = r - len(k) // 2
        sums[name] = F.expr(" + ".join(
            f"_nb[{i + at}][{j + at}] * {float(w)!r}D" for j, row in enumerate(k) for i, w in enumerate(row) if w
        ))
    return df.withColumns(sums).drop("_nb")


def extreme(df: DataFrame, keys: list[str], value: str, r: int, how: str, out: str) -> DataFrame:
    """Maximum or minimum over a square window; the frame simply ends at the border."""
    df = line_extreme(df, keys, "y", value, r, how, "_e")
    return line_extreme(df, keys, "x", "_e", r, how, out).drop("_e")


def line_extreme(
    df: DataFrame, keys: list[str], axis: str, value: str, r: int, how: str, out: str,
    size: int | None = None, running: int | None = None,
) -> DataFrame:
    """Maximum or minimum from r pixels before to r pixels after.

    From a radius of `running` on, a frame isn't scanned for every pixel: lines are also cut into
    blocks of 2r+1 pixels, and a frame is the end of one block and the beginning of the next, so its
    extreme is that of a running extreme towards the end of a block, r pixels back, and of one from
    the beginning of a block, r pixels ahead.
    """
    f, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    d = segmented(df, axis, r, size)
    line = segment(keys, axis)
    if r < (RUNNING if running is None else running):
        return own(d.withColumn(out, f(value).over(line.rowsBetween(-r, r))), axis, size)
    n = 2 * r + 1
    whole = W.partitionBy(*keys, across(axis), "_s")
    block = W.partitionBy(*keys, across(axis), "_s", "_k")
    d = d.withColumn("_last", F.max(axis).over(whole)).withColumn("_k", F.expr(f"{axis} div {n}"))
    d = d.withColumn("_from", f(value).over(block.orderBy(axis).rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_to", f(value).over(block.orderBy(F.col(axis).desc()).rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_end", F.max_by("_from", axis).over(whole))
    # beyond the end of the line the last block counts as a whole, if the frame reaches it from before
    beyond = F.when(F.expr(f"{axis} < {r} or _last div {n} > ({axis} - {r}) div {n}"), F.col("_end"))
    ahead = F.coalesce(F.lead("_from", r).over(line), beyond)
    d = d.withColumn(out, pick(F.lag("_to", r).over(line), ahead))
    return own(d.drop("_last", "_k", "_from", "_to", "_end"), axis, size)


def gaussian_weights(sigma: float, truncate: float = 4.0, order: int = 0) -> list[float]:
    """Sampled Gaussian (normalized) or its first/second derivative factor."""
    r = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    s = sum(g)
    g = [v / s for v in g]
    if order == 0:
        return g
    if order == 1:  # correlation weights of the derivative
        return [v * (i / sigma**2) for i, v in zip(range(-r, r + 1), g)]
    return [v * (i * i / sigma**4 - 1 / sigma**2) for i, v in zip(range(-r, r + 1), g)]


# Standard 3x3 kernels (correlation order, rows are y).
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
