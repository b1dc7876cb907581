"""Queries for neighbourhood filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import stencil as st
from gridloom.functions.columns import rnd
from gridloom.operators import filters as N, wavelets as WV
from gridloom.plans import sqlkit as K
from gridloom.plans.registry import query
from gridloom.sources import views as V

KERNELS = {
    "sharpen": [[0, -1, 0], [-1, 5, -1], [0, -1, 0]],
    "emboss": [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]],
    "box5": [[0.04] * 5 for _ in range(5)],
}
SOB = K.conv("sb", "{0}", {"gx": st.SOBEL_X, "gy": st.SOBEL_Y}, "mirror")


def sobel_sql(src: str) -> str:
    return SOB.replace("{0}", src) + ", so AS (SELECT *, sqrt(gx*gx+gy*gy) AS magnitude FROM sb)"


def out(df, *cols, places=4, keep=("image_id", "y", "x")):
    return df.select(*keep, *[rnd(c, places).alias(c) for c in cols])


def r4(*cols, places=4):
    return ", ".join(f"round({c}, {places})+0.0 AS {c}" for c in cols)


@query("c1_convolve", "pix", K.conv("cv", "pix", KERNELS, "mirror") + f" SELECT image_id, y, x, {r4(*KERNELS)} FROM cv")
def _(s, d):
    return out(N.convolve(V.pix(s, d), KERNELS), *KERNELS)


@query("c2_gaussian_blur", "pix", K.gauss("g", "pix", 1.0, "reflect") + f" SELECT image_id, y, x, {r4('v', places=3)} FROM g")
def _(s, d):
    return out(N.gaussian_blur(V.pix(s, d), 1.0), "v", places=3)


@query("c3_sobel", "pix", sobel_sql("pix") + f" SELECT image_id, y, x, {r4('gx', 'gy', 'magnitude')} FROM so")
def _(s, d):
    return out(N.sobel(V.pix(s, d)), "gx", "gy", "magnitude")


G1, D1 = st.gaussian_weights(1.2), st.gaussian_weights(1.2, order=1)


@query("c4_gaussian_gradient", "pix", K.gauss("a1", "pix", 0, "nearest", out="gx", wy=G1, wx=D1) + ", " + K.gauss("a2", "pix", 0, "nearest", out="gy", wy=D1, wx=G1) + " SELECT image_id, y, x, round(gx, 3)+0.0 AS gx, round(gy, 3)+0.0 AS gy, round(sqrt(gx*gx+gy*gy), 3)+0.0 AS magnitude FROM a1 JOIN a2 USING (image_id, y, x)")
def _(s, d):
    return out(N.gaussian_gradient(V.pix(s, d), 1.2), "gx", "gy", "magnitude", places=3)


@query("c5_laplacian", "pix", K.conv("l", "pix", {"lap": st.LAPLACIAN}, "mirror") + f" SELECT image_id, y, x, {r4('lap')} FROM l")
def _(s, d):
    return out(N.laplacian(V.pix(s, d)), "lap")


LOG = K.gauss("lb", "pix", 1.0, "mirror") + ", " + K.conv("lg", "lb", {"log": st.LAPLACIAN}, "mirror")


@query("c6_log_filter", "pix", LOG + f" SELECT image_id, y, x, {r4('log', places=3)} FROM lg")
def _(s, d):
    return out(N.log_filter(V.pix(s, d), 1.0), "log", places=3)


@query("c7_marr_hildreth", "pix", LOG + ", " + K.window("mh", "lg", 1, "nearest", "any_value(a.log) AS log, min(b.log) AS lo, max(abs(b.log-a.log)) FILTER (t.dy=0 OR t.dx=0) AS step", "log") + """, tp AS (SELECT image_id, max(abs(log)) AS top FROM lg GROUP BY 1)
SELECT image_id, y, x, CAST(log>0 AND lo<=0 AND step>0.4*top AS INT) AS edge FROM mh JOIN tp USING (image_id)""")
def _(s, d):
    return N.marr_hildreth(V.pix(s, d), 1.0, 0.4).select("image_id", "y", "x", "edge")


MED = K.window("md", "{0}", 1, "nearest", "median(b.v) AS v")


@query("c8_difference_of_gaussians", "mosaics", MED.replace("{0}", "mosaics") + ", " + K.gauss("da", "md", 1.5, "mirror") + ", " + K.gauss("db", "md", 2.4, "mirror") + """,
dd AS (SELECT da.image_id, da.y, da.x, abs(da.v-db.v) AS v FROM da JOIN db ON da.image_id=db.image_id AND da.y=db.y AND da.x=db.x), dm AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM dd GROUP BY 1),
du AS (SELECT image_id, y, x, floor(65535.0::DOUBLE*(v-lo)/(hi-lo)) AS v FROM dd JOIN dm USING (image_id)), dn AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM du GROUP BY 1),
de AS (SELECT image_id, y, x, CAST(floor(255*(v-lo)/(hi-lo)) AS BIGINT) AS v FROM du JOIN dn USING (image_id)), """ + K.otsu8("ot", "de", "v") + " SELECT image_id, y, x, CAST(v>t AS INT) AS edge FROM de JOIN ot USING (image_id)")
def _(s, d):
    return N.difference_of_gaussians(V.mosaics(s, d).select("image_id", "y", "x", "v"), 1.5, 2.4)


@query("c9_median_filter", "pix", K.window("md", "pix", 1, "nearest", "median(b.v) AS v") + " SELECT image_id, y, x, v FROM md")
def _(s, d):
    return N.median_filter(V.pix(s, d), 3)


@query("c10_bilateral_filter", "pix", K.window("bf", "pix", 2, "mirror", "sum(exp(-(t.dy*t.dy+t.dx*t.dx)/8.0::DOUBLE)*exp(-pow(b.v-a.v, 2)/(2*5000.0::DOUBLE*5000))*b.v)/sum(exp(-(t.dy*t.dy+t.dx*t.dx)/8.0::DOUBLE)*exp(-pow(b.v-a.v, 2)/(2*5000.0::DOUBLE*5000))) AS v", disc=True) + f" SELECT image_id, y, x, {r4('v', places=3)} FROM bf")
def _(s, d):
    return out(N.bilateral_filter(V.pix(s, d), 5, 5000.0, 2.0), "v", places=3)


def _sig(size):
    return math.sqrt(2) * size / math.pi


@query("c11_bandpass", "pix", K.gauss("bs", "pix", _sig(1.5), "reflect") + ", " + K.gauss("bl", "bs", _sig(4), "reflect") + """, bd AS (SELECT bs.image_id, bs.y, bs.x, bs.v-bl.v AS v FROM bs JOIN bl ON bs.image_id=bl.image_id AND bs.y=bl.y AND bs.x=bl.x), bm AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM bd GROUP BY 1)
SELECT image_id, y, x, round(CASE WHEN hi-lo>1e-10 THEN (v-lo)/(hi-lo) ELSE 0 END, 7)+0.0 AS v FROM bd JOIN bm USING (image_id)""")
def _(s, d):
    return out(N.bandpass(V.pix(s, d), 4, 1.5), "v", places=7)


@query("c12_local_threshold", "pix", K.gauss("lt", "pix", (7 - 1) / 6.0, "reflect", out="m") + " SELECT image_id, y, x, round(m, 3)+0.0 AS local_mean, v>m AS fg FROM pix JOIN lt USING (image_id, y, x)")
def _(s, d):
    return N.local_threshold(V.pix(s, d), 7).select("image_id", "y", "x", rnd("local_mean", 3).alias("local_mean"), "fg")


@query("c13_clahe", "mosaic", """ct AS (SELECT image_id, y, x, CAST(floor(v*64/65536) AS INT) AS b FROM mosaic), cd AS (SELECT CAST(ceil((max(y)+1)/32) AS BIGINT) AS ny, CAST(ceil((max(x)+1)/32) AS BIGINT) AS nx FROM mosaic),
ch AS (SELECT image_id, y//32 AS ty, x//32 AS tx, b, count(*) AS n FROM ct GROUP BY ALL), cs AS (SELECT image_id, ty, tx, sum(n) AS area FROM ch GROUP BY ALL),
cf AS (SELECT g.image_id, g.ty, g.tx, g.b, area, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(64)) AS b FROM cs) g LEFT JOIN ch USING (image_id, ty, tx, b)),
cc AS (SELECT *, least(n, greatest(floor(area*3.0::DOUBLE/64), 1)) AS cut FROM cf), ce AS (SELECT *, sum(n-cut) OVER (PARTITION BY image_id, ty, tx)/64 AS share FROM cc),
cm AS (SELECT image_id, ty, tx, b, sum(cut+share) OVER (PARTITION BY image_id, ty, tx ORDER BY b)/area AS m FROM ce),
py AS (SELECT y, least(greatest(CAST(floor((y+0.5::DOUBLE)/32-0.5) AS BIGINT)+k, 0), ny-1) AS ty, CASE k WHEN 0 THEN 1-((y+0.5::DOUBLE)/32-0.5-floor((y+0.5::DOUBLE)/32-0.5)) ELSE (y+0.5::DOUBLE)/32-0.5-floor((y+0.5::DOUBLE)/32-0.5) END AS w FROM (SELECT DISTINCT y FROM mosaic), (VALUES (0),(1)) t(k), cd),
px AS (SELECT x, least(greatest(CAST(floor((x+0.5::DOUBLE)/32-0.5) AS BIGINT)+k, 0), nx-1) AS tx, CASE k WHEN 0 THEN 1-((x+0.5::DOUBLE)/32-0.5-floor((x+0.5::DOUBLE)/32-0.5)) ELSE (x+0.5::DOUBLE)/32-0.5-floor((x+0.5::DOUBLE)/32-0.5) END AS w FROM (SELECT DISTINCT x FROM mosaic), (VALUES (0),(1)) t(k), cd)
SELECT ct.image_id, ct.y, ct.x, round(sum(py.w*px.w*m), 8)+0.0 AS v FROM ct JOIN py ON py.y=ct.y JOIN px ON px.x=ct.x JOIN cm ON cm.image_id=ct.image_id AND cm.ty=py.ty AND cm.tx=px.tx AND cm.b=ct.b GROUP BY 1,2,3""")
def _(s, d):
    return out(N.clahe(V.mosaic(s, d).select("image_id", "y", "x", "v"), 32, 3.0, 64), "v", places=8)


SIZES = "sz AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM {0} GROUP BY 1)"


@query("c14_dilate", "frags", SIZES.format("region") + ", " + """o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2,3)) AS i) a, (SELECT unnest(range(-2,3)) AS i) b WHERE abs(a.i)+abs(b.i)<=2)
SELECT DISTINCT f.image_id, label, y+dy AS y, x+dx AS x FROM frags f, o JOIN sz ON sz.image_id=f.image_id WHERE y+dy BETWEEN 0 AND h-1 AND x+dx BETWEEN 0 AND w-1""")
def _(s, d):
    return N.dilate(V.frags(s, d), N.diamond(2), N.image_sizes(V.region(s, d)))


@query("c14_erode_labels", "frags", """o(dy, dx) AS (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1))
SELECT a.image_id, a.label, a.y, a.x FROM frags a, o JOIN frags b ON b.image_id=a.image_id AND b.label=a.label AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY ALL HAVING count(*)=5""")
def _(s, d):
    return N.erode_labels(V.frags(s, d), N.diamond(1))


@query("c14_grey_dilation", "pix", K.window("gd", "pix", 2, "zero", "max(b.v) AS v") + " SELECT image_id, y, x, v FROM gd")
def _(s, d):
    return N.grey_extreme(V.pix(s, d), 2, "max")


def unit(s, d):
    return V.mosaics(s, d).select("image_id", "y", "x", (F.col("v") / 65535.0).alias("v"))


UNIT = "un AS (SELECT image_id, y, x, v/65535.0::DOUBLE AS v FROM mosaics)"


def para_sql(src: str, radius: float) -> str:
    r = math.ceil(radius)
    vals = ",".join(f"({u},{u * u / (radius * radius)!r}::DOUBLE)" for u in range(-r, r + 1))
    parts, cur = [], src
    for n, (axis, sign) in enumerate((("x", 1), ("x", -1), ("y", 1), ("y", -1))):
        o = "y" if axis == "x" else "x"
        f, op = ("min", "+") if sign > 0 else ("max", "-")
        parts.append(f"ps{n} AS MATERIALIZED (SELECT a.image_id, a.y, a.x, t.h, a.{axis}+t.d AS q FROM {cur} a CROSS JOIN (VALUES {vals}) t(d, h)), pb{n} AS (SELECT a.image_id, a.y, a.x, {f}(b.v {op} a.h) AS v FROM ps{n} a JOIN {cur} b ON b.image_id=a.image_id AND b.{o}=a.{o} AND b.{axis}=a.q GROUP BY 1,2,3)")
        cur = f"pb{n}"
    return ", ".join(parts)


@query("c15_sliding_paraboloid", "mosaics", UNIT + ", " + para_sql("un", 4) + " SELECT u.image_id, u.y, u.x, round(least(greatest(u.v-p.v, 0), 1), 8)+0.0 AS v FROM un u JOIN pb3 p ON p.image_id=u.image_id AND p.y=u.y AND p.x=u.x")
def _(s, d):
    return out(N.subtract_background(unit(s, d), 4, True), "v", places=8)


@query("c15_light_background", "mosaics", UNIT + ", ul AS (SELECT image_id, y, x, 1-v AS v FROM un), " + para_sql("ul", 4) + " SELECT u.image_id, u.y, u.x, round(1-least(greatest(u.v-p.v, 0), 1), 8)+0.0 AS v FROM ul u JOIN pb3 p ON p.image_id=u.image_id AND p.y=u.y AND p.x=u.x")
def _(s, d):
    return out(N.subtract_background(unit(s, d), 4, True, light=True), "v", places=8)


def ball_sql(src: str, radius: float) -> str:
    r = math.ceil(radius)
    offs = ",".join(f"({j},{i},{math.sqrt(radius**2 - i * i - j * j) / 255!r}::DOUBLE)" for j in range(-r, r + 1) for i in range(-r, r + 1) if i * i + j * j <= radius**2)
    def one(name, cur, f, op):
        return f"{name}_s AS MATERIALIZED (SELECT a.image_id, a.y, a.x, t.h, {K._map('(a.y+t.dy)', 'a.ly', 'reflect')} AS ny, {K._map('(a.x+t.dx)', 'a.lx', 'reflect')} AS nx FROM (SELECT *, max(y) OVER (PARTITION BY image_id) AS ly, max(x) OVER (PARTITION BY image_id) AS lx FROM {cur}) a CROSS JOIN (VALUES {offs}) t(dy, dx, h)), {name} AS (SELECT a.image_id, a.y, a.x, {f}(b.v {op} a.h) AS v FROM {name}_s a JOIN {cur} b ON b.image_id=a.image_id AND b.y=a.ny AND b.x=a.nx GROUP BY 1,2,3)"
    return one("ba", src, "min", "-") + ", " + one("bb", "ba", "max", "+")


@query("c15_rolling_ball", "mosaics", UNIT + ", " + ball_sql("un", 4) + " SELECT u.image_id, u.y, u.x, round(least(greatest(u.v-p.v, 0), 1), 8)+0.0 AS v FROM un u JOIN bb p ON p.image_id=u.image_id AND p.y=u.y AND p.x=u.x")
def _(s, d):
    return out(N.subtract_background(unit(s, d), 4, False), "v", places=8)


SHRUNK = UNIT + ", " + K.line("s1", "un", "y", [0.5, 0.5, 0.0], "reflect") + ", " + K.line("s2", "s1", "x", [0.5, 0.5, 0.0], "reflect") + ", sm AS (SELECT image_id, y//2 AS y, x//2 AS x, v FROM s2 WHERE y%2=0 AND x%2=0)"


@query("c15_rolling_ball_shrunk", "mosaics", SHRUNK + ", " + ball_sql("sm", 6) + """, d1 AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM un GROUP BY 1), d2 AS (SELECT image_id, max(y)+1 AS sh, max(x)+1 AS sw FROM sm GROUP BY 1),
fy AS (SELECT image_id, y, least(greatest((y+0.5::DOUBLE)*sh/h-0.5, 0), sh-1) AS f FROM (SELECT DISTINCT image_id, y FROM un) JOIN d1 USING (image_id) JOIN d2 USING (image_id)), fx AS (SELECT image_id, x, least(greatest((x+0.5::DOUBLE)*sw/w-0.5, 0), sw-1) AS f FROM (SELECT DISTINCT image_id, x FROM un) JOIN d1 USING (image_id) JOIN d2 USING (image_id)),
wy AS (SELECT image_id, y, CAST(floor(f) AS BIGINT)+k AS sy, CASE k WHEN 0 THEN 1-(f-floor(f)) ELSE f-floor(f) END AS wt FROM fy, (VALUES (0),(1)) t(k)), wx AS (SELECT image_id, x, CAST(floor(f) AS BIGINT)+k AS sx, CASE k WHEN 0 THEN 1-(f-floor(f)) ELSE f-floor(f) END AS wt FROM fx, (VALUES (0),(1)) t(k)),
bg AS (SELECT b.image_id, wy.y, wx.x, sum(b.v*wy.wt*wx.wt) AS v FROM bb b JOIN wy ON wy.image_id=b.image_id AND wy.sy=b.y JOIN wx ON wx.image_id=b.image_id AND wx.sx=b.x WHERE wy.wt>0 AND wx.wt>0 GROUP BY 1,2,3)
SELECT u.image_id, u.y, u.x, round(least(greatest(u.v-p.v, 0), 1), 8)+0.0 AS v FROM un u JOIN bg p ON p.image_id=u.image_id AND p.y=u.y AND p.x=u.x""")
def _(s, d):
    return out(N.subtract_background(unit(s, d), 12, False), "v", places=8)


@query("c18_remove_small", "frags", "SELECT image_id, label, y, x FROM frags WHERE (image_id, label) IN (SELECT (image_id, label) FROM frags GROUP BY image_id, label HAVING count(*)>=33)")
def _(s, d):
    return N.remove_small(V.frags(s, d), 33).select("image_id", "label", "y", "x")


@query("c19_distance_transform", "mosaics", """o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-7,8)) AS i) a, (SELECT unnest(range(-7,8)) AS i) b), bg AS (SELECT image_id, y AS ny, x AS nx FROM mosaics WHERE NOT fg), sp AS MATERIALIZED (SELECT image_id, y, x, dy, dx, y+dy AS ny, x+dx AS nx FROM mosaics a CROSS JOIN o)
SELECT image_id, y, x, round(min(sqrt(pow(dy*2.0::DOUBLE, 2)+pow(dx*1.0::DOUBLE, 2))), 6) AS dist FROM sp JOIN bg USING (image_id, ny, nx) GROUP BY 1,2,3""")
def _(s, d):
    return out(N.distance_transform(V.mosaics(s, d).select("image_id", "y", "x", "fg"), "fg", (2.0, 1.0)), "dist", places=6)


@query("c20_local_peaks", "mosaics", K.window("lp", "mosaics", 3, "zero", "max(b.v) AS m, any_value(a.v) AS v") + " SELECT image_id, y, x, v FROM lp WHERE v=m")
def _(s, d):
    return N.local_peaks(V.mosaics(s, d).select("image_id", "y", "x", "v"), 3)


@query("c23_gradient_orientation", "pix", sobel_sql("pix") + """, tp AS (SELECT image_id, max(magnitude) AS top FROM so GROUP BY 1), an AS (SELECT image_id, y, x, magnitude, degrees(atan2(gy, gx))+90 AS a FROM so)
SELECT image_id, y, x, round(((a%360)+360)%360%180, 6)+0.0 AS angle, round(CASE WHEN top>0 THEN magnitude/top ELSE 0 END, 8) AS strength FROM an JOIN tp USING (image_id)""")
def _(s, d):
    g = N.gradient_orientation(V.pix(s, d))
    return g.select("image_id", "y", "x", rnd("angle", 6).alias("angle"), rnd("strength", 8).alias("strength"))


@query("c24_structure_tensor", "pix", sobel_sql("pix") + ", sq AS (SELECT image_id, y, x, gx*gx AS a, gy*gy AS b, gx*gy AS c FROM so), " + ", ".join(K.gauss(f"t{k}", "sq", 1.0, "reflect", val=k, out=k) for k in "abc") + """
SELECT image_id, y, x, round(0.5*degrees(atan2(2*c, a-b)), 5)+0.0 AS angle FROM ta JOIN tb USING (image_id, y, x) JOIN tc USING (image_id, y, x)""")
def _(s, d):
    return out(N.structure_tensor(V.pix(s, d), 1.0), "angle", places=5)


@query("c25_sample_vectors", "pix", sobel_sql("pix") + " SELECT image_id, y, x, round(CASE WHEN gx<0 THEN gy ELSE -gy END, 4)+0.0 AS u, round(abs(gx), 4)+0.0 AS v, round(magnitude+1e-9, 4) AS magnitude FROM so WHERE y%3=1 AND x%3=1")
def _(s, d):
    return out(N.sample_vectors(V.pix(s, d), 3), "u", "v", "magnitude")


@query("c27_hough_lines", "mosaic", f"""th AS (SELECT i AS theta, cos(i*{math.pi!r}::DOUBLE/36) AS c, sin(i*{math.pi!r}::DOUBLE/36) AS s FROM (SELECT unnest(range(36)) AS i))
SELECT image_id, CAST(theta AS INT) AS theta, CAST(floor(x*c+y*s+0.5+1e-9) AS BIGINT) AS rho, count(*) AS votes FROM mosaic, th WHERE fg GROUP BY 1,2,3 HAVING count(*)>=60""")
def _(s, d):
    return N.hough_lines(V.mosaic(s, d).filter("fg"), 36, 60)


def frangi_sql(scales) -> str:
    parts = ["fu AS (SELECT image_id, y, x, v/65535.0::DOUBLE AS v FROM pix)"]
    for n, sg in enumerate(scales):
        s = sg / math.sqrt(2)
        g, dd = st.gaussian_weights(s, 8.0), st.gaussian_weights(s, 8.0, 1)
        for nm, src, wy, wx in ((f"dx{n}", "fu", g, dd), (f"dy{n}", "fu", dd, g), (f"hxx{n}", f"dx{n}", g, dd), (f"hxy{n}", f"dx{n}", dd, g), (f"hyy{n}", f"dy{n}", dd, g)):
            parts.append(K.gauss(nm, src, 0, "zero", wy=wy, wx=wx))
        parts.append(f"""ei{n} AS (SELECT image_id, y, x, ((p.v+r.v)/2+sqrt(pow((p.v-r.v)/2, 2)+q.v*q.v))*{sg**2!r}::DOUBLE AS l1, ((p.v+r.v)/2-sqrt(pow((p.v-r.v)/2, 2)+q.v*q.v))*{sg**2!r}::DOUBLE AS l2 FROM hxx{n} p JOIN hxy{n} q USING (image_id, y, x) JOIN hyy{n} r USING (image_id, y, x))""")
        parts.append(f"""ve{n} AS (SELECT image_id, y, x, CASE WHEN l2>0 THEN 0.0::DOUBLE ELSE exp(-pow(l1/CASE WHEN l2=0 THEN 1e-10 ELSE l2 END, 2)/0.5::DOUBLE)*(1-exp(-(l1*l1+l2*l2)/(2*pow({15 / 255!r}::DOUBLE, 2)))) END AS v FROM ei{n})""")
    return ", ".join(parts)


FR = (1.2, 1.6)


@query("c28_frangi", "pix", frangi_sql(FR) + " SELECT image_id, y, x, round(greatest(a.v, b.v), 8)+0.0 AS vesselness, CASE WHEN b.v>a.v THEN 1.6::DOUBLE WHEN a.v>0 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END AS scale FROM ve0 a JOIN ve1 b USING (image_id, y, x)")
def _(s, d):
    f = N.frangi(V.pix(s, d).withColumn("v", F.col("v") / 65535.0), list(FR))
    return f.select("image_id", "y", "x", rnd("vesselness", 8).alias("vesselness"), "scale")


HAAR = """w{n} AS (SELECT image_id, y//2 AS y, x//2 AS x, sum(v)/2 AS a, sum(CASE WHEN y%2=0 THEN v ELSE -v END)/2 AS h, sum(CASE WHEN x%2=0 THEN v ELSE -v END)/2 AS w, sum(CASE WHEN (x+y)%2=0 THEN v ELSE -v END)/2 AS d FROM {src} GROUP BY 1,2,3), v{n} AS (SELECT image_id, y, x, a AS v FROM w{n})"""
IHAAR = """i{n} AS (SELECT r.image_id, w.y*2+k AS y, w.x*2+l AS x, (r.v+(1-2*k)*sign(h)*greatest(abs(h)-t, 0)+(1-2*l)*sign(w.w)*greatest(abs(w.w)-t, 0)+(1-2*k)*(1-2*l)*sign(d)*greatest(abs(d)-t, 0))/2 AS v FROM {src} r JOIN w{n} w ON w.image_id=r.image_id AND w.y=r.y AND w.x=r.x JOIN th ON th.image_id=r.image_id, (VALUES (0),(1)) p(k), (VALUES (0),(1)) q(l))"""


@query("c29_wavelet_denoise", "pix", "v0 AS (SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM pix), " + HAAR.format(n=1, src="v0") + ", " + HAAR.format(n=2, src="v1") + ", " + HAAR.format(n=3, src="v2") + """,
th AS (SELECT image_id, median(abs(d))/0.6745*sqrt(2*ln(64)) AS t FROM w1 GROUP BY 1), """ + IHAAR.format(n=3, src="v3") + ", " + IHAAR.format(n=2, src="i3") + ", " + IHAAR.format(n=1, src="i2") + f" SELECT image_id, y, x, {r4('v', places=3)} FROM i1")
def _(s, d):
    return out(N.haar_denoise(V.pix(s, d), 3), "v", places=3)


def _dwt(name: str, src: str, axis: str, bands: dict[str, tuple[str, str]]) -> str:
    """One analysis level along an axis, straight from its definition: place 2k+1-j under symmetric extension."""
    o = "x" if axis == "y" else "y"
    low = WV.BANKS["sym8"]
    vals = ",".join(f"({j},{a!r}::DOUBLE,{b!r}::DOUBLE)" for j, (a, b) in enumerate(zip(low, WV.high_pass(low))))
    sums = ", ".join(f"sum(lo*s.{v}) AS {a}, sum(hi*s.{v}) AS {b}" for v, (a, b) in bands.items())
    return f"""{name}_k AS (SELECT image_id, n, unnest(range((n+15)//2)) AS k FROM (SELECT image_id, max({axis})+1 AS n FROM {src} GROUP BY 1)),
{name}_i AS MATERIALIZED (SELECT image_id, k, lo, hi, CASE WHEN 2*k+1-j<0 THEN j-2*k-2 WHEN 2*k+1-j>=n THEN 2*n-2-2*k+j ELSE 2*k+1-j END AS p FROM {name}_k, (VALUES {vals}) t(j, lo, hi)),
{name} AS MATERIALIZED (SELECT s.image_id, k AS {axis}, s.{o}, {sums} FROM {name}_i i JOIN {src} s ON s.image_id=i.image_id AND s.{axis}=p GROUP BY 1,2,3)"""


def _idwt(name: str, src: str, axis: str, bands: dict[str, tuple[str, str]], like: str) -> str:
    """The inverse: value i gathers coefficients k with the filter's place 2k+1-i, cut to the size of `like`."""
    o = "x" if axis == "y" else "y"
    low = WV.BANKS["sym8"]
    vals = ",".join(f"({j},{a!r}::DOUBLE,{b!r}::DOUBLE)" for j, (a, b) in enumerate(zip(low, WV.high_pass(low))))
    sums = ", ".join(f"sum(lo*s.{a}+hi*s.{b}) AS {v}" for v, (a, b) in bands.items())
    return f"""{name}_k AS (SELECT image_id, unnest(range(n)) AS i FROM (SELECT image_id, max({axis})+1 AS n FROM {like} GROUP BY 1)),
{name}_i AS MATERIALIZED (SELECT image_id, i, lo, hi, (i+j-1)//2 AS k FROM {name}_k, (VALUES {vals}) t(j, lo, hi) WHERE (i+j)%2=1),
{name} AS MATERIALIZED (SELECT s.image_id, i AS {axis}, s.{o}, {sums} FROM {name}_i i JOIN {src} s ON s.image_id=i.image_id AND s.{axis}=k GROUP BY 1,2,3)"""


_ROWS, _BANDS = {"v": ("l", "h")}, {"l": ("ll", "lh"), "h": ("hl", "hh")}
SYM8 = ", ".join([
    "sz AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM mosaics GROUP BY 1)",
    "w0 AS (SELECT g.image_id, g.y, g.x, coalesce(CAST(m.v AS DOUBLE), 0.0::DOUBLE) AS v FROM (SELECT image_id, y, unnest(range(w)) AS x FROM (SELECT image_id, w, unnest(range(h)) AS y FROM sz)) g LEFT JOIN mosaics m USING (image_id, y, x))", _dwt("wa", "w0", "y", _ROWS), _dwt("w1", "wa", "x", _BANDS), "w1v AS (SELECT image_id, y, x, ll AS v FROM w1)",
    _dwt("wb", "w1v", "y", _ROWS), _dwt("w2", "wb", "x", _BANDS),
    "th AS (SELECT image_id, median(abs(hh))/0.6745*sqrt(2*ln(n)) AS t FROM w1 JOIN (SELECT image_id, count(*)::DOUBLE AS n FROM mosaics GROUP BY 1) USING (image_id) GROUP BY image_id, n)",
    "s2 AS (SELECT image_id, y, x, ll, sign(lh)*greatest(abs(lh)-t, 0) AS lh, sign(hl)*greatest(abs(hl)-t, 0) AS hl, sign(hh)*greatest(abs(hh)-t, 0) AS hh FROM w2 JOIN th USING (image_id))",
]) + ", " + _idwt("ra", "s2", "x", {"l": ("ll", "lh"), "h": ("hl", "hh")}, "w1v") + ", " + _idwt("r1", "ra", "y", _ROWS, "w1v") + """,
s1 AS (SELECT image_id, y, x, r1.v AS ll, sign(lh)*greatest(abs(lh)-t, 0) AS lh, sign(hl)*greatest(abs(hl)-t, 0) AS hl, sign(hh)*greatest(abs(hh)-t, 0) AS hh FROM w1 JOIN th USING (image_id) JOIN r1 USING (image_id, y, x)), """ + _idwt("rb", "s1", "x", {"l": ("ll", "lh"), "h": ("hl", "hh")}, "w0") + ", " + _idwt("r0", "rb", "y", _ROWS, "w0")


@query("c29_wavelet_sym8", "mosaics", SYM8 + f" SELECT image_id, y, x, {r4('v', places=3)} FROM r0 SEMI JOIN mosaics USING (image_id, y, x)")
def _(s, d):
    return out(WV.denoise(V.mosaics(s, d).select("image_id", "y", "x", "v"), "sym8", 2), "v", places=3)


SEG = "sg AS (SELECT image_id, image_id*4+k AS seg, CAST(k AS DOUBLE) AS y0, (image_id%5)*1.0::DOUBLE AS x0, 7-k*1.5::DOUBLE AS y1, 3.0::DOUBLE+k AS x1 FROM (SELECT DISTINCT image_id FROM pix), (VALUES (0),(1),(2),(3)) t(k))"


def segments(s, d):
    im = V.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    k = F.col("k")
    return im.select("image_id", (F.col("image_id") * 4 + k).alias("seg"), k.cast("double").alias("y0"), (F.col("image_id") % 5).cast("double").alias("x0"), (7 - k * 1.5).alias("y1"), (3.0 + k).alias("x1"))


def profile_sql(seg: str, pix: str, width: int, last: str = "7", last_x: str | None = None, carry: str = "") -> str:
    offs = ",".join(f"({j - (width - 1) / 2}::DOUBLE)" for j in range(width))
    lx = last_x or last
    return f"""pn AS (SELECT *, CAST(ceil(round(sqrt(pow(y1-y0, 2)+pow(x1-x0, 2)), 9)+1) AS BIGINT) AS n, atan2(y1-y0, x1-x0) AS th FROM {seg}),
pi AS (SELECT *, unnest(range(n)) AS i FROM pn), pj AS (SELECT image_id, seg, i{carry}, round(y0+CASE WHEN n>1 THEN i/(n-1) ELSE 0 END*(y1-y0)+j*cos(th), 9) AS py, round(x0+CASE WHEN n>1 THEN i/(n-1) ELSE 0 END*(x1-x0)-j*sin(th), 9) AS px FROM pi, (VALUES {offs}) t(j)),
pc AS (SELECT *, py-floor(py) AS fy, px-floor(px) AS fx FROM pj),
pw AS (SELECT image_id, seg, i, CAST(floor(py) AS BIGINT)+a AS y, CAST(floor(px) AS BIGINT)+b AS x, CASE WHEN py BETWEEN 0 AND {last} AND px BETWEEN 0 AND {lx} THEN (CASE a WHEN 0 THEN 1-fy ELSE fy END)*(CASE b WHEN 0 THEN 1-fx ELSE fx END) ELSE 0 END AS wt FROM pc, (VALUES (0),(1)) t(a), (VALUES (0),(1)) u(b)),
lp AS (SELECT pw.image_id, seg, i, sum(coalesce(p.v, 0)*wt)/{width} AS v FROM pw LEFT JOIN {pix} p ON p.image_id=pw.image_id AND p.y=pw.y AND p.x=pw.x GROUP BY 1,2,3)"""


@query("c33_line_profile", "pix", SEG + ", " + profile_sql("sg", "pix", 3) + " SELECT image_id, seg, i, round(v, 4)+0.0 AS v FROM lp")
def _(s, d):
    p = V.pix(s, d)
    return out(N.line_profile(segments(s, d), p, 3, N.image_sizes(p)), "v", keep=("image_id", "seg", "i"))
