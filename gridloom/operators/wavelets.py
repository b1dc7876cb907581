"""Wavelet analysis, synthesis and denoising with any orthogonal filter bank.

A level is a strided convolution along y and one along x.  Lines are extended by half-sample
symmetry, cut into segments with halos (see functions.stencil), and every second place is kept; the
inverse gathers half a filter of coefficients around each place and gives two values.  All of it are
line windows, whatever the image size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import stencil as st
from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import exact_percentile

IMG = ["image_id"]
_S = math.sqrt(0.5)

# Low-pass analysis filters of the banks.
BANKS = {
    "haar": [_S, _S],
    "sym8": [
        -0.0033824159510061256, -0.0005421323317911481, 0.03169508781149298, 0.007607487324917605,
        -0.1432942383508097, -0.061273359067658524, 0.4813596512583722, 0.7771857517005235,
        0.3644418948353314, -0.05194583810770904, -0.027219029917056003, 0.049137179673607506,
        0.003808752013890615, -0.01495225833704823, -0.0003029205147213668, 0.0018899503327594609,
    ],
}


def high_pass(low: list[float]) -> list[float]:
    """The mirror filter of an orthogonal bank."""
    return [(-1) ** (k + 1) * c for k, c in enumerate(reversed(low))]


def _size(axis: str) -> str:
    return {"y": "_h", "x": "_w"}[axis]


def _weighted(values: str, weights: list[float]) -> Column:
    return F.expr(" + ".join(f"{values}[{i}] * {w!r}D" for i, w in enumerate(weights)))


def analyse(df: DataFrame, axis: str, bands: dict[str, tuple[str, str]], low: list[float], keys: list[str] = IMG, size: int | None = None) -> DataFrame:
    """One level along an axis: {value: (approximation, detail)}.  Rows carry the image size `_h`, `_w`."""
    n, length = F.col(_size(axis)), len(low)
    i = F.col(axis)
    turns = F.sequence(-F.expr(f"{length} div (2 * {_size(axis)})") - 1, F.expr(f"{length} div (2 * {_size(axis)})") + 1)
    places = F.concat(F.transform(turns, lambda m: i + 2 * n * m), F.transform(turns, lambda m: 2 * n * m - 1 - i))
    places = F.filter(places, lambda p: (p >= 2 - length) & (p <= n + (length - 2)))
    d = df.withColumn("_p", F.explode(places)).withColumn(axis, F.col("_p") + length).drop("_p")
    d = st.segmented(d, axis, length, size)
    win = st.segment(keys, axis).rowsBetween(-(length - 1), 0)
    d = st.own(d.withColumns({f"_f_{v}": F.collect_list(v).over(win) for v in bands}), axis, size)
    at = F.col(axis) - length  # the last place of the frame
    d = d.filter((at >= 1) & (at % 2 == 1) & (at <= n + (length - 2)))
    high = high_pass(low)
    out = {}
    for v, (a, b) in bands.items():
        out[a], out[b] = _weighted(f"_f_{v}", low[::-1]), _weighted(f"_f_{v}", high[::-1])
    other = st.across(axis)
    return d.select(
        *keys, ((at - 1) / 2).cast("long").alias(axis), other, *[c.alias(o) for o, c in out.items()],
        F.expr(f"({_size(axis)} + {length - 1}) div 2").alias(_size(axis)), _size(other),
    )


def synthesize(df: DataFrame, axis: str, bands: dict[str, tuple[str, str]], low: list[float], n: Column, keys: list[str] = IMG, size: int | None = None) -> DataFrame:
    """Inverse of `analyse` along an axis: {value: (approximation, detail)}, cut to n places; other columns stay."""
    half, high = len(low) // 2, high_pass(low)
    used = {c for ab in bands.values() for c in ab}
    rest = [c for c in df.columns if c not in used | {axis}]
    d = st.segmented(df, axis, half, size)
    win = st.segment(keys, axis).rowsBetween(0, half - 1)
    d = st.own(d.withColumns({f"_f_{c}": F.collect_list(c).over(win) for c in used}), axis, size)
    d = d.filter(F.size(f"_f_{next(iter(used))}") == half)

    def value(a: str, b: str, odd: int) -> Column:
        at = range(0 if odd else 1, len(low), 2)
        return _weighted(f"_f_{a}", [low[k] for k in at]) + _weighted(f"_f_{b}", [high[k] for k in at])

    two = [F.struct((2 * F.col(axis) + odd).cast("long").alias("at"), *[value(a, b, odd).alias(v) for v, (a, b) in bands.items()]) for odd in (0, 1)]
    d = d.withColumn("_two", F.explode(F.array(*two))).select(*rest, F.col("_two.at").alias(axis), *[f"_two.{v}" for v in bands])
    return d.filter(F.col(axis) < n)


def decompose(df: DataFrame, bank: str, levels: int, keys: list[str] = IMG, size: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Approximation (keys, y, x, v) and, per level, details (keys, y, x, lh, hl, hh); rows carry the sizes
    `_h`, `_w` of their band, details also `_ph`, `_pw` of what they came from."""
    low = BANKS[bank]
    cur = df.select(*keys, "y", "x", F.col("v").cast("double").alias("v"))
    cur = with_stats(cur, keys, _h=F.max("y") + 1, _w=F.max("x") + 1)
    details = []
    for _ in range(levels):
        rows = analyse(cur, "y", {"v": ("l", "h")}, low, keys, size)
        both = analyse(rows, "x", {"l": ("ll", "lh"), "h": ("hl", "hh")}, low, keys, size)
        sizes = cur.select(*keys, F.col("_h").alias("_ph"), F.col("_w").alias("_pw")).distinct()
        both = both.join(sizes, keys)
        details.append(both.drop("ll"))
        cur = both.select(*keys, "y", "x", F.col("ll").alias("v"), "_h", "_w")
    return cur, details


def compose(approximation: DataFrame, details: list[DataFrame], bank: str, keys: list[str] = IMG, size: int | None = None) -> DataFrame:
    """(keys, y, x, v): the image that `decompose` came from."""
    low, cur = BANKS[bank], approximation
    for d in reversed(details):
        j = d.drop("_h", "_w").join(cur.select(*keys, "y", "x", "v"), [*keys, "y", "x"])
        j = synthesize(j, "x", {"l": ("v", "lh"), "h": ("hl", "hh")}, low, F.col("_pw"), keys, size)
        cur = synthesize(j, "y", {"v": ("l", "h")}, low, F.col("_ph"), keys, size)
    return cur.select(*keys, "y", "x", "v")


def denoise(df: DataFrame, bank: str = "sym8", levels: int = 3, keys: list[str] = IMG, size: int | None = None) -> DataFrame:
    """Soft thresholding of all details at sigma * sqrt(2 ln pixels), sigma from the median of the finest
    diagonal details.  Places of the image's rectangle without a pixel count as 0 and aren't returned."""
    gaps = st.missing(df, keys)
    full = df.select(*keys, "y", "x", F.col("v").cast("double").alias("v"))
    full = full if gaps is None else full.unionByName(gaps.withColumn("v", F.lit(0.0)))
    approximation, details = decompose(full, bank, levels, keys, size)
    noise = exact_percentile(details[0].withColumn("_d", F.abs("hh")), keys, "_d", {"_m": 0.5})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = noise.join(sizes, keys).select(*keys, (F.col("_m") / 0.6745 * F.sqrt(2 * F.log(F.col("_n").cast("double")))).alias("_t"))

    def soft(c: str) -> Column:
        return (F.signum(c) * F.greatest(F.abs(c) - F.col("_t"), F.lit(0.0))).alias(c)

    shrunk = [d.join(limit, keys).select(*[soft(c) if c in ("lh", "hl", "hh") else c for c in d.columns]) for d in details]
    out = compose(approximation, shrunk, bank, keys, size)
    return out if gaps is None else out.join(gaps, [*keys, "y", "x"], "left_anti")
