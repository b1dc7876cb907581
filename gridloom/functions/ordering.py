"""Exact ranks, running sums and percentiles that never gather one group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every group.

    The rank filter is pushed below the shuffle by Spark (window group limit), so at most n
    rows per group and map task travel.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-group statistics; without keys they are one row, which is broadcast."""
    return df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))


def bucketed(df: DataFrame, keys: list[str], order: str, buckets: int = 32, fine: int = 256) -> DataFrame:
    """Add `_b`, an order-preserving bucket of `order` inside each group.

    Cut points come from a mergeable quantile sketch, so slices hold similar numbers of rows
    whatever the distribution; a slice splits again linearly into up to `fine` parts.  A group
    of any size becomes buckets * fine pieces at the price of one small aggregate.
    """
    probs = [i / buckets for i in range(buckets + 1)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, probs, 1000).alias("_cuts"))
    at = F.size(F.filter(F.slice("_cuts", 2, buckets - 1), lambda c: c < F.col(order)))
    d = attach(df, cuts, keys).withColumn("_b", at)
    lo, hi = F.get("_cuts", F.col("_b")).cast("double"), F.get("_cuts", F.col("_b") + 1).cast("double")
    part = F.when(hi > lo, F.floor((F.col(order).cast("double") - lo) / (hi - lo) * fine)).otherwise(0)
    part = F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1))
    return d.withColumn("_b", (F.col("_b") * fine + part).cast("long")).drop("_cuts")


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, str], buckets: int = 32, bucket: Column | None = None
) -> DataFrame:
    """Inclusive running sums of columns by ascending `order` inside each group.

    `order` must be unique inside a group (aggregate ties first).  Sums run inside buckets and
    are shifted by the totals of the buckets before them, so no task sees more than one bucket.
    `bucket` may give an order-preserving bucket directly when the range of `order` is known.
    """
    group = keys
    b = bucketed(df, group, order, buckets) if bucket is None else df.withColumn("_b", bucket)
    totals = b.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_t_{o}") for o, s in sums.items()])
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_b", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    inside = W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = b.join(offsets, [*group, "_b"])
    for o, s in sums.items():
        out = out.withColumn(o, F.sum(s).over(inside) + F.col(f"_o_{o}"))
    return out.drop("_b", *[f"_o_{o}" for o in sums])


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket: Column) -> DataFrame:
    """Maximum of the rows before each row, by ascending `order`, computed per bucket."""
    b = df.withColumn("_b", bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).select(*keys, "_b", F.max("_m").over(before).alias("_o"))
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return b.join(tops, [*keys, "_b"]).withColumn(out, F.greatest(F.max(value).over(inside), F.col("_o"))).drop("_b", "_o")


def exact_percentile(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 32
) -> DataFrame:
    """Percentiles with linear interpolation, exact for any number of distinct values.

    Rows collapse to distinct values with counts first; the two order statistics around each
    position are then picked by their rank interval.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(distinct, keys, value, {"_to": "_n"}, buckets)
    total = ranked.groupBy(*keys).agg(F.max("_to").alias("_total"))
    r = attach(ranked, total, keys)
    picks = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        start, stop = F.col("_to") - F.col("_n"), F.col("_to")

        def at(i: Column) -> Column:
            return F.max(F.when((start <= i) & (i < stop), F.col(value)))

        frac = F.max(pos - lo)
        a, b = at(lo), at(hi)
        picks.append((a + (b - a) * frac).alias(name))
    return r.groupBy(*keys).agg(*picks)


def hash_order(id_col: str | Column, seed: int | str) -> Column:
    """Pseudo-random but reproducible order key: md5 of the id and a seed."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}")))


def hash_rank(df: DataFrame, keys: list[str], id_col: str | Column, seed: int | str, out: str = "rank") -> DataFrame:
    """Exact 1-based rank by hash order inside each group.

    The first three hex digits split every group into 4,096 even buckets; ranks inside a bucket
    are shifted by the sizes of earlier buckets, so a group of any size spreads over the cluster.
    """
    h = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = h.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_b").orderBy("_h")
    return (
        h.join(sizes, [*keys, "_b"])
        .withColumn(out, F.row_number().over(inside) + F.col("_off"))
        .drop("_h", "_b", "_off")
    )
