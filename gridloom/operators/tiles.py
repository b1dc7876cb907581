"""Tiles with a halo: the unit of work for operators that need an array of pixels at once.

A tile bounds the rows of one task whatever the image size.  Python sees one tile as numpy
arrays; Spark does the partitioning, the halo exchange and the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.rounds import dealt, materialize

IMG = ["image_id"]


def tile_with_halo(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Every pixel once per tile that covers it (own tile first), with `own` marking its tile.

    With halo < tile/2 a pixel lies in at most four tiles.
    """

    def span(c: str) -> Column:
        lo = F.greatest(F.expr(f"({c} - {halo}) div {tile}"), F.lit(0))
        lo = F.when(F.col(c) < halo, F.lit(0)).otherwise(lo)
        return F.sequence(lo.cast("long"), F.expr(f"({c} + {halo}) div {tile}").cast("long"))

    t = df.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))
    return t.withColumn("own", (F.expr(f"y div {tile}") == F.col("ty")) & (F.expr(f"x div {tile}") == F.col("tx")))


def per_tile(df: DataFrame, tile: int, halo: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = IMG) -> DataFrame:
    t = tile_with_halo(df, tile, halo) if halo else df.withColumn("ty", F.expr(f"y div {tile}")).withColumn("tx", F.expr(f"x div {tile}")).withColumn("own", F.lit(True))
    return dealt(t, *keys, "ty", "tx").groupBy(*keys, "ty", "tx").applyInPandas(fn, schema)


def per_object_tile(df: DataFrame, tile: int, halo: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = IMG) -> DataFrame:
    """`per_tile` for keys that may hold an object's `label`: the objects of a tile are worked on together, so
    there are as many groups as tiles, however many objects.  Where objects overlap, `fn` sees one at a time."""
    area = [k for k in keys if k != "label"]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.duplicated(["y", "x"]).any():
            return pd.concat([fn(one) for _, one in pdf.groupby("label")])
        return fn(pdf)

    return per_tile(df, tile, halo, each if "label" in keys else fn, schema, area if area else keys)


def _same(pdf: pd.DataFrame, shifts: list[tuple[int, int]], border: int = 0) -> list[np.ndarray | bool]:
    """For each shift, where the neighbour there belongs to the same object; a tile without labels is one object."""
    if "label" not in pdf:
        return [True] * len(shifts)
    g, _, _ = _grid(pdf.assign(_o=pd.factorize(pdf["label"])[0]), "_o", -1.0)
    g = np.pad(g, border, constant_values=-1.0)
    return [moved_view(g, dy, dx, -1.0) == g for dy, dx in shifts]


def key_schema(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _grid(pdf: pd.DataFrame, value: str, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = (pdf["y"] - pdf["y"].min()).to_numpy()
    x = (pdf["x"] - pdf["x"].min()).to_numpy()
    g = np.full((y.max() + 1, x.max() + 1), fill, dtype=float)
    g[y, x] = pdf[value].to_numpy()
    return g, y, x


def ball_background(df: DataFrame, radius: float, keys: list[str] = IMG, tile: int = 256) -> DataFrame:
    """Grey erosion then dilation with a ball; a disc of heights is not separable, so each tile
    (halo of two radii) takes running extremes over the offsets.  Borders are reflected."""
    r = math.ceil(radius)
    offs = [(j, i, math.sqrt(radius**2 - i * i - j * j) / 255.0) for j in range(-r, r + 1) for i in range(-r, r + 1) if i * i + j * j <= radius**2]
    ks = list(keys)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        g, y, x = _grid(pdf, "v", 0.0)
        for op, sign in ((np.minimum, -1), (np.maximum, 1)):
            p = np.pad(g, r, mode="symmetric")
            parts = None
            for j, i, h in offs:
                q = p[r + j : r + j + g.shape[0], r + i : r + i + g.shape[1]] + sign * h
                parts = q if parts is None else op(parts, q)
            g = parts
        out = pdf[[*ks, "y", "x"]].assign(background=g[y, x])
        return out[pdf["own"].to_numpy()]

    return per_tile(df, tile, 2 * r, fn, key_schema(df, keys) + ", y long, x long, background double", keys)


def relax(
    state: DataFrame, local: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], keys: list[str] = IMG, tile: int = 256, halo: int = 1,
) -> DataFrame:
    """Repeat a tile-local fixed point with halo exchange until no tile changes.

    Each round lets information cross a whole tile, so the number of rounds follows the number
    of tiles a path crosses, not its pixels.  Rounds are written tables.
    """
    schema = key_schema(state, keys) + ", y long, x long, " + ", ".join(f"{c} {dict(state.dtypes)[c]}" for c in columns) + ", moved long"
    ks = list(keys)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        before = pdf[columns].copy()
        out = local(pdf)
        moved = (out[columns].fillna(-9e18).to_numpy() != before.fillna(-9e18).to_numpy()).any(axis=1)
        out = out[[*ks, "y", "x", *columns]].assign(moved=moved.astype("int64"))
        return out[pdf["own"].to_numpy()]

    cur = state
    while True:
        cur, obs = materialize(per_object_tile(cur, tile, halo, fn, schema, keys), moved=F.sum("moved"))
        cur = cur.drop("moved")
        if not obs["moved"]:
            return cur


SHIFTS4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
SHIFTS8 = SHIFTS4 + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def moved_view(g: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """g shifted so that position (y, x) holds the neighbour at (y + dy, x + dx)."""
    out = np.full_like(g, fill)
    h, w = g.shape
    ys, xs = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
    yd, xd = slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx))
    out[ys, xs] = g[yd, xd]
    return out


def geodesic_distance(mask: DataFrame, source: DataFrame, pixel_size: float = 1.0, keys: list[str] = IMG, tile: int = 256) -> DataFrame:
    """Shortest 8-connected path length (1 and sqrt 2 per step) from the source pixels inside
    the mask; unreachable pixels are 0.  `keys` may include an object label: paths stay inside their object."""
    src = source.select(*keys, "y", "x").distinct().withColumn("_s", F.lit(0.0))
    state = mask.select(*keys, "y", "x").join(src, [*keys, "y", "x"], "left")
    state = state.select(*keys, "y", "x", F.coalesce("_s", F.lit(float("inf"))).alias("dist"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        g, y, x = _grid(pdf, "dist", np.nan)
        on = ~np.isnan(g)
        g[~on] = np.inf
        same = _same(pdf, SHIFTS8)
        while True:
            best = g.copy()
            for (dy, dx), own in zip(SHIFTS8, same, strict=True):
                np.minimum(best, moved_view(g, dy, dx, np.inf) + math.hypot(dy, dx), out=best, where=own)
            best[~on] = np.inf
            if not (best < g - 1e-12).any():
                break
            g = best
        return pdf.assign(dist=g[y, x])

    out = relax(state, local, ["dist"], keys, tile)
    return out.withColumn("dist", F.when(F.col("dist") == float("inf"), 0.0).otherwise(F.col("dist") * pixel_size))


def seeded_watershed(df: DataFrame, seeds: DataFrame, keys: list[str] = IMG, tile: int = 256) -> DataFrame:
    """Every pixel of (.., y, x, height) joins the seed reachable over the lowest pass.

    First the pass height: the smallest possible maximum along a 4-connected path to any seed.
    Then labels flow along steps that keep that height; the smaller seed wins ties and seed
    pixels keep their own.  Both are fixed points with a unique result.
    """
    s = seeds.select(*keys, "y", "x", F.col("seed").cast("double").alias("seed"))
    inf = F.lit(float("inf"))
    state = df.select(*keys, "y", "x", F.col("height").cast("double").alias("height")).join(s, [*keys, "y", "x"], "left")
    is_seed = F.col("seed").isNotNull()
    state = state.select(*keys, "y", "x", "height", F.when(is_seed, F.col("height")).otherwise(inf).alias("cost"),
                         F.coalesce("seed", inf).alias("seed"), is_seed.cast("double").alias("fixed"))

    def cost(pdf: pd.DataFrame) -> pd.DataFrame:
        h, y, x = _grid(pdf, "height", np.inf)
        c, _, _ = _grid(pdf, "cost", np.inf)
        while True:
            best = c.copy()
            for dy, dx in SHIFTS4:
                np.minimum(best, np.maximum(moved_view(c, dy, dx, np.inf), h), out=best)
            if np.array_equal(best, c):
                return pdf.assign(cost=c[y, x])
            c = best

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        h, y, x = _grid(pdf, "height", np.inf)
        c, _, _ = _grid(pdf, "cost", np.inf)
        q, _, _ = _grid(pdf, "seed", np.inf)
        f, _, _ = _grid(pdf, "fixed", 1.0)
        feeds = [(f == 0) & (np.maximum(moved_view(c, dy, dx, np.inf), h) == c) & np.isfinite(c) for dy, dx in SHIFTS4]
        while True:
            best = q.copy()
            for (dy, dx), ok in zip(SHIFTS4, feeds):
                np.minimum(best, np.where(ok, moved_view(q, dy, dx, np.inf), np.inf), out=best)
            if np.array_equal(best, q):
                return pdf.assign(seed=q[y, x])
            q = best

    columns = ["height", "cost", "seed", "fixed"]
    out = relax(relax(state, cost, columns, keys, tile), label, columns, keys, tile)
    return out.filter(F.col("seed") < inf).select(*keys, "y", "x", F.col("seed").cast("long").alias("seed"))


def thin(mask: DataFrame, keys: list[str] = IMG, tile: int = 256, steps: int = 8) -> DataFrame:
    """Zhang-Suen thinning, of each object by itself if `keys` holds a label.  A tile with a halo of 2*steps rows runs `steps` full iterations
    exactly, so only every steps-th iteration exchanges halos."""
    schema = key_schema(mask, keys) + ", y long, x long"
    ks = list(keys)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        y, x = (pdf["y"] - y0).to_numpy() + 1, (pdf["x"] - x0).to_numpy() + 1
        g = np.zeros((y.max() + 2, x.max() + 2), dtype=np.int8)
        g[y, x] = 1
        ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        same = _same(pdf, ring, 1)
        for _ in range(steps):
            start = g.copy()
            for first in (True, False):
                n = [moved_view(g, a, b, 0) * own for (a, b), own in zip(ring, same, strict=True)]
                total = sum(v.astype(np.int16) for v in n)
                turns = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(np.int16) for i in range(8))
                p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
                rule = (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0) if first else (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)
                g[(g == 1) & (total >= 2) & (total <= 6) & (turns == 1) & rule] = 0
            if (g == start).all():
                break
        kept = g[y, x] == 1
        return pdf[[*ks, "y", "x"]][pdf["own"].to_numpy() & kept]

    cur, before = mask.select(*keys, "y", "x"), None
    while True:  # pixels only ever go, so an equal count is the end
        cur, obs = materialize(per_object_tile(cur, tile, 2 * steps, fn, schema, keys), n=F.count(F.lit(1)))
        if obs["n"] == before:
            return cur
        before = obs["n"]
