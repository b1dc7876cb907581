"""Intensity against distance: tables (label, distance, intensity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import exact_percentile, running_sums
from gridloom.operators.raster import otsu_threshold


def bright_centroid(labels: DataFrame, pixels: DataFrame, pct: float = 75) -> DataFrame:
    """Mean coordinate of the pixels above the object's own percentile."""
    keys = ["image_id", "label"]
    p = with_stats(labels.join(pixels, ["image_id", "y", "x"]), keys, _t=F.percentile("v", F.lit(pct / 100)))
    return p.filter(F.col("v") > F.col("_t")).groupBy(*keys).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n"))


def bin_profile(df: DataFrame, bin_size: float, keys: list[str] = []) -> DataFrame:
    """Mean value per distance bin.  Bins share one grid per image (`keys`); empty bins are
    absent, and values exactly on the last grid edge belong to no bin."""
    group = [*keys, "label"]
    s = with_stats(df, keys, _max=F.max("distance"))
    b = F.floor(F.col("distance") / bin_size)
    s = s.withColumn("b", b).filter(F.col("b") < F.ceil(F.col("_max") / bin_size))
    return s.groupBy(*group, ((F.col("b") + 0.5) * bin_size).alias("distance")).agg(F.avg("intensity").alias("intensity"))


def normalize_profiles(df: DataFrame) -> DataFrame:
    s = with_stats(df, ["label"], _m=F.max("intensity"))
    return s.withColumn("intensity", F.try_divide("intensity", "_m")).drop("_m")


def flip_profiles(df: DataFrame, flip: DataFrame) -> DataFrame:
    """Mirror the distance axis of the listed labels."""
    s = with_stats(df, ["label"], _m=F.max("distance"))
    s = s.join(flip.select("label").distinct().withColumn("_f", F.lit(True)), "label", "left")
    return s.withColumn("distance", F.when(F.col("_f"), F.col("_m") - F.col("distance")).otherwise(F.col("distance"))).drop("_m", "_f")


def unknown_labels(df: DataFrame, flip: DataFrame) -> DataFrame:
    return flip.select("label").join(df.select("label"), "label", "left_anti")


def spread_and_centroid(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Distance range above a threshold (NULL up to one bin) and weighted mean distance (NULL
    without positive weight); the threshold defaults to Otsu over all values."""
    if threshold is None:
        t = otsu_threshold(df, [], "intensity").select("threshold")
        df = df.crossJoin(F.broadcast(t))  # one row
    else:
        df = df.withColumn("threshold", F.lit(float(threshold)))
    above = F.when(F.col("intensity") > F.col("threshold"), F.col("distance"))
    return df.groupBy("label").agg(
        F.when(F.count(above) > 1, F.max(above) - F.min(above)).alias("spread"),
        F.when(F.sum("intensity") > 0, F.sum(F.col("distance") * F.col("intensity")) / F.sum("intensity")).alias("centroid"),
        F.first("threshold").alias("threshold"),
    )


def zone_ratio(df: DataFrame, tip: tuple[float, float] = (0, 5), body: tuple[float, float] = (5, 10)) -> DataFrame:
    """Mean of the tip zone over mean of the body zone, closed intervals; objects with an empty
    zone or a body mean of at most 0 drop out."""
    def zone(z):
        return F.avg(F.when(F.col("distance").between(*z), F.col("intensity")))

    g = df.groupBy("label").agg(zone(tip).alias("tip_mean"), zone(body).alias("body_mean"))
    g = g.filter(F.col("tip_mean").isNotNull() & (F.col("body_mean") > 0))
    return g.withColumn("ratio", F.col("tip_mean") / F.col("body_mean"))


def zone_counts(df: DataFrame, ratios: DataFrame) -> DataFrame:
    total = df.agg(F.count_distinct("label").alias("total"))
    kept = ratios.agg(F.count("*").alias("included"))
    return total.crossJoin(kept).withColumn("excluded", F.col("total") - F.col("included"))


def searchsorted_uniform(df: DataFrame, value: str, bin_size: float, out: str = "bin") -> DataFrame:
    """Left-side position of a value among uniform bin centres."""
    return df.withColumn(out, F.greatest(F.ceil(F.col(value) / bin_size - 0.5), F.lit(0)).cast("long"))


def searchsorted_join(df: DataFrame, value: str, edges: DataFrame, edge: str, out: str = "bin") -> DataFrame:
    """Left-side position of a value among arbitrary sorted edges, for edge tables of any size.

    Values and edges meet in one running count instead of a range join: position = number of
    edges below the value.
    """
    vals = df.select(F.col(value).cast("double").alias("u")).filter("u IS NOT NULL").distinct().withColumn("e", F.lit(0))
    both = vals.unionByName(edges.select(F.col(edge).cast("double").alias("u"), F.lit(1).alias("e")))
    per = both.groupBy("u").agg(F.sum("e").alias("e"))
    pos = running_sums(per, [], "u", {"upto": "e"}).select(F.col("u").alias(value), (F.col("upto") - F.col("e")).alias(out))
    return df.join(pos, value, "left")


def _profile_cells(df: DataFrame, bin_size: float) -> DataFrame:
    """(label, bin, intensity, n_bins): the farthest value of every bin that an object has; bin is NULL
    for objects whose values all lie past the last centre."""
    s = with_stats(df, [], _max=F.max("distance"))
    s = searchsorted_uniform(s.withColumn("n_bins", F.ceil(F.col("_max") / bin_size)), "distance", bin_size)
    s = s.withColumn("bin", F.when(F.col("bin") < F.col("n_bins"), F.col("bin")))
    return s.groupBy("label", "bin").agg(F.max_by("intensity", "distance").alias("intensity"), F.first("n_bins").alias("n_bins"))


def profile_runs(df: DataFrame, bin_size: float) -> DataFrame:
    """Object x bin matrix as runs (label, length, first_bin, last_bin, intensity): one row for every value,
    and one for each stretch of bins without a value, where intensity is NULL.

    An object has at most two rows for each of its values and one more, however far the farthest
    distance of all lies.
    """
    cells = _profile_cells(df, bin_size)
    whole = cells.groupBy("label").agg(F.count("bin").alias("length"), F.first("n_bins").alias("n_bins"), F.min("bin").alias("_lowest"))
    bins = W.partitionBy("label").orderBy("bin")
    v = cells.filter("bin is not null").select("label", "bin", "intensity", F.lead("bin").over(bins).alias("_next")).join(whole, "label")
    none = F.lit(None).cast("double")
    after = F.when(F.coalesce("_next", "n_bins") > F.col("bin") + 1, F.struct((F.col("bin") + 1).alias("a"), (F.coalesce("_next", "n_bins") - 1).alias("b"), none.alias("v")))
    rows = F.array_compact(F.array(F.struct(F.col("bin").alias("a"), F.col("bin").alias("b"), F.col("intensity").cast("double").alias("v")), after))
    first = whole.filter("n_bins > 0").withColumn("_upto", F.coalesce("_lowest", "n_bins") - 1).filter("_upto >= 0")
    every = v.select("label", "length", F.explode(rows).alias("r")).select("label", "length", F.col("r.a").alias("first_bin"), F.col("r.b").alias("last_bin"), F.col("r.v").alias("intensity"))
    return every.unionByName(first.select("label", "length", F.lit(0).cast("long").alias("first_bin"), F.col("_upto").alias("last_bin"), none.alias("intensity")))


def profile_matrix(df: DataFrame, bin_size: float) -> DataFrame:
    """Object x bin matrix in long form, NULL where an object has no value, with the row
    length.  Position is the left-side search among bin centres; the farthest value wins a
    cell; positions past the last centre are left out.  `profile_runs` has the same without the
    rows of empty bins."""
    runs = profile_runs(df, bin_size)
    long = runs.select("label", "length", F.explode(F.sequence("first_bin", "last_bin")).alias("bin"), "intensity")
    return long.orderBy("length", "label", "bin")


def column_percentiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    return exact_percentile(df.select(value), [], value, probs)


def profile_stats(df: DataFrame, bin_size: float) -> DataFrame:
    """Medians of the object metrics, maximum and 95th percentile of the matrix values."""
    sc = spread_and_centroid(df)
    m = _profile_cells(df, bin_size).filter("bin IS NOT NULL AND intensity IS NOT NULL")
    parts = [
        column_percentiles(sc, "spread", {"median_spread": 0.5}),
        column_percentiles(sc, "centroid", {"median_centroid": 0.5}),
        column_percentiles(zone_ratio(df), "ratio", {"median_ratio": 0.5}),
        m.agg(F.max("intensity").alias("matrix_max")),
        column_percentiles(m, "intensity", {"matrix_p95": 0.95}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def chain_metrics(chains: DataFrame, min_length: int, min_linearity: float) -> DataFrame:
    """Per chain of ordered points (chain, pos, y, x, score to the previous point): length, path
    and end-to-end distance, linearity, mean score and whether it passes both limits.

    `prev_y`, `prev_x` come from an equi-join on the position, so a chain of any length stays
    distributed.
    """
    prev = chains.select("chain", (F.col("pos") + 1).alias("pos"), F.col("y").alias("py"), F.col("x").alias("px"))
    s = chains.join(prev, ["chain", "pos"], "left")
    step = F.hypot(F.col("y") - F.col("py"), F.col("x") - F.col("px"))
    g = s.groupBy("chain").agg(
        F.count("*").alias("length"),
        F.sum(step).alias("path_distance"),
        F.avg(F.when(F.col("py").isNotNull(), F.col("score"))).alias("mean_score"),
        F.min_by(F.struct("y", "x"), "pos").alias("a"),
        F.max_by(F.struct("y", "x"), "pos").alias("b"),
    ).filter("length >= 2")
    end = F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x"))
    g = g.withColumn("end_distance", end)
    g = g.withColumn("linearity", F.when(F.col("path_distance") > 0, F.col("end_distance") / F.col("path_distance")).otherwise(0.0))
    return g.withColumn("valid", (F.col("length") >= min_length) & (F.col("linearity") >= min_linearity)).drop("a", "b")


def spacing_ratio(chains: DataFrame) -> DataFrame:
    """Mean gap between consecutive members over mean member length, per chain and over all
    chains (chain NULL)."""
    prev = chains.select("chain", (F.col("pos") + 1).alias("pos"), F.col("y").alias("py"), F.col("x").alias("px"))
    s = with_stats(chains, ["chain"], _n=F.count("*")).filter("_n >= 2").join(prev, ["chain", "pos"], "left")
    gap = F.hypot(F.col("y") - F.col("py"), F.col("x") - F.col("px"))
    g = s.withColumn("gap", gap).rollup("chain").agg(F.avg("gap").alias("mean_gap"), F.avg("length").alias("mean_length"))
    return g.withColumn("ratio", F.when(F.col("mean_length") > 0, F.col("mean_gap") / F.col("mean_length")).otherwise(0.0))
