"""Queries over distance profiles and chains of positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.operators import profiles as P
from gridloom.plans.rasters import otsu_sql
from gridloom.plans.registry import query
from gridloom.sources import views as V


@query("j1_bright_centroid", "region", """q AS (SELECT image_id, frag, quantile_cont(v, 0.75) AS t FROM region WHERE frag>0 GROUP BY 1,2)
SELECT image_id, frag AS label, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, count(*) AS n FROM region JOIN q USING (image_id, frag) WHERE v > t GROUP BY 1,2""")
def _(s, d):
    c = P.bright_centroid(V.frags(s, d), V.region(s, d).select("image_id", "y", "x", "v"))
    return c.withColumn("cy", rnd("cy")).withColumn("cx", rnd("cx"))


@query("j3_bin_profile", "profile", """m AS (SELECT max(distance) AS m FROM profile)
SELECT label, (floor(distance/24)+0.5)*24::DOUBLE AS distance, round(avg(intensity), 6) AS intensity FROM profile, m WHERE floor(distance/24) < ceil(m/24) GROUP BY 1,2""")
def _(s, d):
    return P.bin_profile(V.profile(s, d), 24.0).withColumn("intensity", rnd("intensity"))


@query("j5_normalize_profiles", "profile", "m AS (SELECT label, max(intensity) AS m FROM profile GROUP BY 1) SELECT label, round(distance, 6) AS distance, round(intensity/m, 6) AS intensity FROM profile JOIN m USING (label)")
def _(s, d):
    return P.normalize_profiles(V.profile(s, d)).select("label", rnd("distance").alias("distance"), rnd("intensity").alias("intensity"))


def flips(s, d):
    lab = V.profile(s, d).select("label").distinct().filter(F.col("label").cast("int") % 10 == 0)
    return lab.unionByName(V.table(s, d, "region").select(F.concat(F.lit("ghost_"), F.col("r_regionkey").cast("string")).alias("label")))


@query("j6_flip_profiles", "profile", "m AS (SELECT label, max(distance) AS m FROM profile GROUP BY 1) SELECT label, round(CASE WHEN CAST(label AS INT)%10=0 THEN m-distance ELSE distance END, 6)+0.0 AS distance, intensity FROM profile JOIN m USING (label)")
def _(s, d):
    return P.flip_profiles(V.profile(s, d), flips(s, d)).withColumn("distance", rnd("distance"))


@query("j6_unknown_labels", "", "SELECT 'ghost_' || CAST(r_regionkey AS VARCHAR) AS label FROM region")
def _(s, d):
    return P.unknown_labels(V.profile(s, d), flips(s, d))


SC = "pk AS (SELECT 0 AS k, * FROM profile), " + otsu_sql("pk", "k", "intensity") + """, sc AS (SELECT label,
CASE WHEN count(*) FILTER (intensity>threshold) > 1 THEN max(distance) FILTER (intensity>threshold)-min(distance) FILTER (intensity>threshold) END AS spread,
CASE WHEN sum(intensity)>0 THEN sum(distance*intensity)/sum(intensity) END AS centroid, any_value(threshold) AS threshold FROM profile, ot GROUP BY 1)"""
ZR = """zr AS (SELECT label, tip_mean, body_mean, tip_mean/body_mean AS ratio FROM (SELECT label, avg(intensity) FILTER (distance BETWEEN 0 AND 60) AS tip_mean, avg(intensity) FILTER (distance BETWEEN 60 AND 120) AS body_mean FROM profile GROUP BY 1) WHERE tip_mean IS NOT NULL AND body_mean > 0)"""
TIP, BODY = (0, 60), (60, 120)


@query("j7_spread_and_centroid", "profile", SC + " SELECT label, round(spread, 6) AS spread, round(centroid, 6) AS centroid, round(threshold, 6) AS threshold FROM sc")
def _(s, d):
    t = P.spread_and_centroid(V.profile(s, d))
    return t.select("label", *[rnd(c).alias(c) for c in ("spread", "centroid", "threshold")])


@query("j7_spread_fixed_threshold", "profile", """SELECT label, CASE WHEN count(*) FILTER (intensity>150) > 1 THEN round(max(distance) FILTER (intensity>150)-min(distance) FILTER (intensity>150), 6) END AS spread,
CASE WHEN sum(intensity)>0 THEN round(sum(distance*intensity)/sum(intensity), 6) END AS centroid FROM profile GROUP BY 1""")
def _(s, d):
    t = P.spread_and_centroid(V.profile(s, d), 150)
    return t.select("label", *[rnd(c).alias(c) for c in ("spread", "centroid")])


@query("j8_zone_ratio", "profile", ZR + " SELECT label, round(tip_mean, 6) AS tip_mean, round(body_mean, 6) AS body_mean, round(ratio, 6) AS ratio FROM zr")
def _(s, d):
    z = P.zone_ratio(V.profile(s, d), TIP, BODY)
    return z.select("label", *[rnd(c).alias(c) for c in ("tip_mean", "body_mean", "ratio")])


@query("j8_zone_counts", "profile", """zn AS (SELECT label, avg(intensity) FILTER (distance BETWEEN 0 AND 2) AS tip_mean, avg(intensity) FILTER (distance BETWEEN 2 AND 4) AS body_mean FROM profile GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (tip_mean IS NOT NULL AND body_mean>0) AS included, count(*) - count(*) FILTER (tip_mean IS NOT NULL AND body_mean>0) AS excluded FROM zn""")
def _(s, d):
    p = V.profile(s, d)
    return P.zone_counts(p, P.zone_ratio(p, (0, 2), (2, 4)))


MAT = """mx AS (SELECT max(distance) AS m FROM profile), pb AS (SELECT label, distance, intensity, greatest(CAST(ceil(distance/24-0.5) AS BIGINT), 0) AS bin, CAST(ceil(m/24) AS BIGINT) AS nb FROM profile, mx),
cell AS (SELECT label, bin, arg_max(intensity, distance) AS intensity FROM pb WHERE bin < nb GROUP BY 1,2),
ln AS (SELECT label, count(DISTINCT bin) FILTER (bin<nb) AS length, any_value(nb) AS nb FROM pb GROUP BY 1),
mat AS (SELECT g.label, g.length, g.bin, intensity FROM (SELECT label, length, unnest(range(nb)) AS bin FROM ln) g LEFT JOIN cell ON cell.label=g.label AND cell.bin=g.bin)"""


@query("j9_profile_runs", "profile", MAT + """, nr AS (SELECT label, length, bin, bin-row_number() OVER (PARTITION BY label ORDER BY bin) AS g FROM mat WHERE intensity IS NULL)
SELECT label, length, bin AS first_bin, bin AS last_bin, intensity FROM mat WHERE intensity IS NOT NULL UNION ALL SELECT label, length, min(bin), max(bin), NULL FROM nr GROUP BY label, length, g""")
def _(s, d):
    return P.profile_runs(V.profile(s, d), 24.0)


@query("j9_profile_matrix", "profile", MAT + " SELECT label, length, bin, intensity FROM mat")
def _(s, d):
    return P.profile_matrix(V.profile(s, d), 24.0)


@query("j10_profile_stats", "profile", SC + ", " + ZR.replace("60 AND 120", "5 AND 10").replace("0 AND 60", "0 AND 5") + ", " + MAT + """
SELECT (SELECT round(median(spread), 6) FROM sc) AS median_spread, (SELECT round(median(centroid), 6) FROM sc) AS median_centroid, (SELECT round(median(ratio), 6) FROM zr) AS median_ratio,
(SELECT max(intensity) FROM mat) AS matrix_max, (SELECT round(quantile_cont(intensity, 0.95), 6) FROM mat) AS matrix_p95""")
def _(s, d):
    r = P.profile_stats(V.profile(s, d), 24.0)
    return r.select(*[rnd(c).alias(c) if c != "matrix_max" else c for c in r.columns])


@query("f12_searchsorted_uniform", "profile", "SELECT label, round(distance, 6) AS distance, greatest(CAST(ceil(distance/24-0.5) AS BIGINT), 0) AS bin FROM profile")
def _(s, d):
    p = P.searchsorted_uniform(V.profile(s, d), "distance", 24.0)
    return p.select("label", rnd("distance").alias("distance"), "bin")


@query("f12_searchsorted_join", "profile", """ed AS (SELECT DISTINCT p_retailprice-890 AS u FROM part)
SELECT label, round(distance, 6) AS distance, (SELECT count(*) FROM ed WHERE ed.u < profile.distance) AS bin FROM profile""")
def _(s, d):
    edges = V.table(s, d, "part").select((F.col("p_retailprice") - 890).alias("u")).distinct()
    p = P.searchsorted_join(V.profile(s, d), "distance", edges, "u")
    return p.select("label", rnd("distance").alias("distance"), "bin")


def chains(s, d):
    """Ordered points out of profiles: one chain per label, position by distance."""
    from gridloom.functions.ordering import running_sums

    p = V.profile(s, d)
    per = p.groupBy("label", "distance").agg(F.max("intensity").alias("intensity"), F.lit(1).alias("one"))
    pos = running_sums(per, ["label"], "distance", {"pos": "one"}, 8)
    return pos.select(
        F.col("label").alias("chain"), "pos", F.col("distance").alias("y"), (F.col("intensity") / 10).alias("x"),
        (F.col("intensity") / 500).alias("score"), (F.col("intensity") / 100 + 1).alias("length"),
    )


CH = """pd AS (SELECT label, distance, max(intensity) AS intensity FROM profile GROUP BY 1,2),
ch AS (SELECT label AS chain, row_number() OVER (PARTITION BY label ORDER BY distance) AS pos, distance AS y, intensity/10 AS x, intensity/500 AS score, intensity/100+1 AS length FROM pd),
st AS (SELECT *, sqrt(pow(y-lag(y) OVER w, 2)+pow(x-lag(x) OVER w, 2)) AS gap FROM ch WINDOW w AS (PARTITION BY chain ORDER BY pos))"""


@query("g9_chain_metrics", "profile", CH + """, g AS (SELECT chain, count(*) AS length, sum(gap) AS pd, avg(score) FILTER (gap IS NOT NULL) AS ms, arg_min(y, pos) AS ay, arg_min(x, pos) AS ax, arg_max(y, pos) AS by_, arg_max(x, pos) AS bx FROM st GROUP BY 1 HAVING count(*)>=2),
h AS (SELECT *, sqrt(pow(ay-by_,2)+pow(ax-bx,2)) AS ed FROM g)
SELECT chain, length, round(pd, 5) AS path_distance, round(ms, 6) AS mean_score, round(ed, 5) AS end_distance, round(CASE WHEN pd>0 THEN ed/pd ELSE 0 END, 6) AS linearity, length>=60 AND CASE WHEN pd>0 THEN ed/pd ELSE 0 END >= 0.5 AS valid FROM h""")
def _(s, d):
    m = P.chain_metrics(chains(s, d), 60, 0.5)
    return m.select("chain", "length", rnd("path_distance", 5).alias("path_distance"), rnd("mean_score").alias("mean_score"), rnd("end_distance", 5).alias("end_distance"), rnd("linearity").alias("linearity"), "valid")


@query("g10_spacing_ratio", "profile", CH + """ SELECT chain, round(avg(gap), 6) AS mean_gap, round(avg(length), 6) AS mean_length, round(avg(gap)/avg(length), 6) AS ratio FROM st WHERE chain IN (SELECT chain FROM ch GROUP BY 1 HAVING count(*)>=2) GROUP BY ROLLUP (chain)""")
def _(s, d):
    r = P.spacing_ratio(chains(s, d))
    return r.select("chain", *[rnd(c).alias(c) for c in ("mean_gap", "mean_length", "ratio")])
