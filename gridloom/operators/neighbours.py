"""Exact nearest neighbours of points by a quadtree that follows their density.

A cell splits while it holds more than `LEAF` points, so leaves are small wherever points crowd and
large where they don't.  The tree is walked with itself, level by level: a pair of cells (query side,
data side) is opened on both sides, and stays only if the data cell may hold one of the m nearest of
some point of the query cell.  The bound comes from counts: the m-th distance of any point of a query
cell is at most the smallest distance within which its data cells surely hold m + 1 points (one is the
point itself).  So an even image, a dense cluster and a far outlier all compare a number of points
that is about in proportion to their own number, and no task holds more than the candidates of one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import first_by
from gridloom.functions.rounds import dealt, materialize

LEAF, DEPTH = 8, 50
#: levels looked at in one round of building, turns of the walk between two written rounds
STEP, WALK = 5, 3
_KEY = ["lv", "ky", "kx"]


def quadtree(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(image_id, label, cy, cx, lv, ky, kx): every point with its leaf cell."""
    p = with_stats(points.select("image_id", "label", "cy", "cx"), ["image_id"], _y=F.min("cy"), _x=F.min("cx"), _side=F.greatest(F.max("cy") - F.min("cy"), F.max("cx") - F.min("cx")))
    top = 1 << DEPTH

    def place(c: str, low: str) -> Column:
        return F.least(F.floor((F.col(c) - F.col(low)) / F.greatest(F.col("_side"), F.lit(1e-9)) * top), F.lit(top - 1)).cast("long")

    p = p.select("image_id", "label", "cy", "cx", place("cy", "_y").alias("fy"), place("cx", "_x").alias("fx"))
    done, first = [], 0
    todo, obs = materialize(p, n=F.count(F.lit(1)))
    while obs["n"] or not done:
        last = min(first + STEP, DEPTH)
        each = todo.withColumn("lv", F.explode(F.sequence(F.lit(first), F.lit(last))))
        each = each.withColumn("ky", F.expr(f"shiftright(fy, {DEPTH} - lv)")).withColumn("kx", F.expr(f"shiftright(fx, {DEPTH} - lv)"))
        n = each.groupBy("image_id", *_KEY).agg(F.count(F.lit(1)).alias("n"))
        small = each.join(n, ["image_id", *_KEY]).filter((F.col("n") <= leaf) | (F.col("lv") == DEPTH))
        small = small.groupBy("image_id", "label", "cy", "cx", "fy", "fx").agg(F.min("lv").alias("lv"))
        state = todo.join(small.select("image_id", "label", "lv"), ["image_id", "label"], "left")
        state, obs = materialize(state, n=F.count_if(F.col("lv").isNull()))
        found = state.filter("lv is not null")
        done.append(found.select("image_id", "label", "cy", "cx", "lv", F.expr(f"shiftright(fy, {DEPTH} - lv)").alias("ky"), F.expr(f"shiftright(fx, {DEPTH} - lv)").alias("kx")))
        todo, first = state.filter("lv is null").drop("lv"), last + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _cells(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(image_id, lv, ky, kx, cell, kids): leaves and the cells that branch, with the box and count of their
    points and the next such cells below (a leaf is its own only child); and how many follow each other at most."""
    leaf = leaves.groupBy("image_id", *_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.min("cx").alias("x0"), F.max("cx").alias("x1"))
    up = leaf.withColumn("leaf", F.struct(*_KEY)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("lv"))))

    def above(k: str, at: str) -> Column:
        return F.expr(f"shiftright({k}, lv - {at})")

    child = F.when(F.col("at") < F.col("lv"), F.struct(above("ky", "(at + 1)").alias("y"), above("kx", "(at + 1)").alias("x")))
    up = up.select("image_id", "leaf", F.col("at").alias("lv"), above("ky", "at").alias("ky"), above("kx", "at").alias("kx"), child.alias("child"), "n", "y0", "y1", "x0", "x1")
    key = ["image_id", *_KEY]
    box = [F.sum("n").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")]
    kept = up.groupBy(*key).agg(*box, F.min("child").alias("a"), F.max("child").alias("b")).filter("a is null or a <> b or lv = 0")
    kept = kept.select(*key, F.col("a").isNull().alias("is_leaf"), F.struct(*_KEY, "n", "y0", "y1", "x0", "x1").alias("cell"))
    path = up.select("leaf", *key).join(kept, key)
    way = W.partitionBy("image_id", "leaf").orderBy("lv")  # one row a level
    path = path.withColumn("above", F.lag(F.struct(*_KEY)).over(way)).withColumn("turn", F.row_number().over(way))
    path, obs = materialize(path, turns=F.max("turn"))
    below = path.filter("above is not null").select("image_id", "above.*", "cell").distinct()
    own = path.filter("is_leaf").select(*key, "cell")
    kids = below.unionByName(own).groupBy(*key).agg(F.collect_list("cell").alias("kids"))
    return kept.drop("is_leaf").join(kids, key), obs["turns"] - 1


def _square_gap(near: bool) -> Column:
    """Squared smallest or largest distance between points of the boxes q and c."""
    out = F.lit(0.0)
    for a in ("y", "x"):
        one, two = F.col(f"q.{a}0") - F.col(f"c.{a}1"), F.col(f"c.{a}0") - F.col(f"q.{a}1")
        gap = F.greatest(one, two, F.lit(0.0)) if near else F.greatest(-one, -two)
        out = out + gap * gap
    return out


def _open(pairs: DataFrame, cells: DataFrame, m: int) -> DataFrame:
    """Pairs of the children of both sides that may hold one of the m nearest."""
    for side in ("q", "c"):
        k = cells.select("image_id", F.col("lv").alias("_l"), F.col("ky").alias("_y"), F.col("kx").alias("_x"), "kids")
        on = pairs.withColumn("_l", F.col(f"{side}.lv")).withColumn("_y", F.col(f"{side}.ky")).withColumn("_x", F.col(f"{side}.kx"))
        pairs = on.join(k, ["image_id", "_l", "_y", "_x"]).withColumn(side, F.explode("kids")).select("image_id", "q", "c")
    p = pairs.withColumn("_far", _square_gap(False)).withColumn("_near", _square_gap(True))
    mine = W.partitionBy("image_id", "q.lv", "q.ky", "q.kx")
    upto = F.sum("c.n").over(mine.orderBy("_far").rangeBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_upto", upto).withColumn("_reach", F.min(F.when(F.col("_upto") > m, F.col("_far"))).over(mine))
    return p.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))).select("image_id", "q", "c")


def leaf_pairs(points: DataFrame, m: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(image_id, q, c): the pairs of leaf cells whose points must be compared, and the points with their cells."""
    leaves = quadtree(points, leaf)  # written tables already
    cells, turns = _cells(leaves)
    cells, _ = materialize(cells)
    pairs = cells.filter("lv = 0").select("image_id", F.col("cell").alias("q"), F.col("cell").alias("c"))
    for turn in range(1, turns + 1):
        pairs = _open(pairs, cells, m)
        if turn % WALK == 0 and turn < turns:
            pairs, _ = materialize(pairs)
    return pairs, leaves


def nearest(points: DataFrame, m: int, leaf: int = LEAF) -> DataFrame:
    """(image_id, i, j, d2, rank): the m nearest other points of each point (image_id, label, cy, cx);
    ties go to the smaller label."""
    pairs, leaves = leaf_pairs(points, m, leaf)

    def side(s: str, name: str) -> DataFrame:
        return leaves.select("image_id", F.struct(*_KEY).alias(s), F.col("label").alias(name), F.col("cy").alias(f"{name}y"), F.col("cx").alias(f"{name}x"))

    p = pairs.select("image_id", F.struct("q.lv", "q.ky", "q.kx").alias("q"), F.struct("c.lv", "c.ky", "c.kx").alias("c"))
    j = dealt(p.join(side("q", "i"), ["image_id", "q"]), "image_id", "c").join(side("c", "j"), ["image_id", "c"]).filter("i <> j")
    dy, dx = F.col("iy") - F.col("jy"), F.col("ix") - F.col("jx")
    near = first_by(j.select("image_id", "i", "j", (dy * dy + dx * dx).alias("d2")), ["image_id", "i"], [F.col("d2"), F.col("j")], m)
    order = W.partitionBy("image_id", "i").orderBy("d2", "j")  # at most m rows
    return near.withColumn("rank", F.row_number().over(order)).select("image_id", "i", "j", "d2", "rank")
