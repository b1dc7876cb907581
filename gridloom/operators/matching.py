"""Overlap of fragments with ground-truth cells, rules over cells, and what follows from both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.ordering import first_by
from gridloom.operators.raster import two_means_whole, whole_units


def overlaps(px: DataFrame) -> DataFrame:
    """Shared pixels per (fragment, cell) and fragment area from pixels with both labels."""
    c = px.filter("frag > 0").groupBy("image_id", "frag", "gt").agg(F.count("*").alias("n"))
    area = c.groupBy("image_id", "frag").agg(F.sum("n").alias("area"))
    return area.join(c.filter("gt > 0"), ["image_id", "frag"], "left")


def best_overlap(px: DataFrame) -> DataFrame:
    """Best cell (smaller id on ties) and its share of the fragment's area, 0 when none."""
    o = first_by(overlaps(px), ["image_id", "frag"], [F.col("n").desc_nulls_last(), F.col("gt")])
    return o.select("image_id", "frag", "area", "gt", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("area")).alias("overlap"))


def assign_to_gt(px: DataFrame, min_frac: float) -> DataFrame:
    o = best_overlap(px)
    ok = F.col("gt").isNotNull() & (F.col("n") >= F.col("area") * min_frac)
    return o.select("image_id", "frag", F.when(ok, F.col("gt")).otherwise(-1).alias("gt"))


def threshold_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """Background share per threshold, per image and overall (image NULL); the thresholds are an
    array of constants exploded per fragment, then counted before the shuffle."""
    t = best.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    t = t.withColumn("_bg", (F.col("overlap") < F.col("threshold")).cast("int"))
    g = t.groupBy("threshold", "image_id").agg(F.count("*").alias("n"), F.sum("_bg").alias("background"))
    r = g.groupingSets([["threshold", "image_id"], ["threshold"]], "threshold", "image_id").agg(F.sum("n").alias("n"), F.sum("background").alias("background"))
    return r.withColumn("background_pct", 100.0 * F.col("background") / F.col("n"))


def disputed(best: DataFrame, lo: float, hi: float) -> DataFrame:
    return best.filter((F.col("overlap") >= lo) & (F.col("overlap") < hi)).orderBy("overlap", "image_id", "frag")


def cell_metrics(regions: DataFrame) -> DataFrame:
    """The seven shape metrics a rule may name."""
    p2 = F.col("perimeter") * F.col("perimeter")
    return regions.select(
        "image_id", "label",
        (F.col("area") / F.greatest("major", F.lit(1e-9))).alias("mean_width"), F.col("minor").alias("minor_axis"), "extent",
        (F.col("major") / F.greatest("minor", F.lit(1e-9))).alias("axis_ratio"), "solidity",
        (4 * math.pi * F.col("area") / F.greatest(p2, F.lit(1e-9))).alias("circularity"), "eccentricity",
    )


# Which side of the threshold is the elongated class.
HIGH_SIDE = {"mean_width": False, "minor_axis": False, "extent": False, "axis_ratio": True, "solidity": False, "circularity": False, "eccentricity": True}


def _pick(metric: Column) -> Column:
    value = F.raise_error(F.concat(F.lit("unknown metric "), metric)).cast("double")
    for name in HIGH_SIDE:
        value = F.when(metric == name, F.col(name)).otherwise(value)
    return value


def classify_cells(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Per-image rule (image_id, all_type, metric, threshold): one type for all, or a metric on
    its declared side of the threshold; an unknown metric fails."""
    m = metrics.join(rules, "image_id")
    high = F.col("metric").isin([n for n, h in HIGH_SIDE.items() if h])
    v = _pick(F.col("metric"))
    hit = F.when(high, v > F.col("threshold")).otherwise(v < F.col("threshold"))
    kind = F.when(F.col("all_type").isNotNull(), F.col("all_type")).when(hit, "hyphal").otherwise("epithelial")
    return m.select("image_id", "label", kind.alias("cell_type"))


def compare_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Class of every cell under each metric with that metric's own two-cluster cut per image.

    Values count in millionths; a metric with one value in an image has no cut there, and its cells no class."""
    long = metrics.unpivot(["image_id", "label"], names, "metric", "value").withColumn("_u", whole_units("value"))
    cut = two_means_whole(long, ["image_id", "metric"], "_u")
    j = long.join(cut, ["image_id", "metric"], "left")
    above = F.col("_u") > F.col("low_max")
    high = F.col("metric").isin([n for n, h in HIGH_SIDE.items() if h])
    kind = F.when(F.when(high, above).otherwise(~above), "hyphal").otherwise("epithelial")
    return j.select("image_id", "label", "metric", F.when(F.col("low_max").isNotNull(), kind).alias("cell_type"))


# Class numbers.
CLASSES = {"background": 0, "epithelial": 1, "hyphal": 2}


def node_types(assign: DataFrame, cell_types: DataFrame) -> DataFrame:
    """A fragment has the type of the cell it belongs to, background otherwise."""
    t = cell_types.select("image_id", F.col("label").alias("gt"), "cell_type")
    num = F.lit(None).cast("int")
    for name, n in CLASSES.items():
        num = F.when(F.col("cell_type") == name, n).otherwise(num)
    return assign.join(t, ["image_id", "gt"], "left").select("image_id", "frag", F.coalesce(num, F.lit(0)).alias("node_type"))
