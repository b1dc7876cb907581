"""Queries for candidate pairs and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.operators import candidates as C, regions as G, tiles as T
from gridloom.plans.filters import profile_sql
from gridloom.plans.regions import BASIC, INNER, INNER_SIZED, MOM, px, sizes
from gridloom.plans.registry import query
from gridloom.sources import views as V

KNN = """cd AS (SELECT a.image_id, a.label AS i, b.label AS j, pow(a.cy-b.cy, 2)+pow(a.cx-b.cx, 2) AS d2, row_number() OVER (PARTITION BY a.image_id, a.label ORDER BY pow(a.cy-b.cy, 2)+pow(a.cx-b.cx, 2), b.label) AS rank FROM bs a JOIN bs b ON a.image_id=b.image_id AND a.label<>b.label),
kn AS (SELECT * FROM cd WHERE rank<={m})"""
BD = """un AS (SELECT DISTINCT image_id, least(i,j) AS i, greatest(i,j) AS j FROM kn),
bd AS (SELECT un.image_id, i, j, min({'d2': (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x), 'iy': a.y, 'ix': a.x, 'jy': b.y, 'jx': b.x}) AS m FROM un JOIN ib a ON a.image_id=un.image_id AND a.label=i JOIN ib b ON b.image_id=un.image_id AND b.label=j GROUP BY 1,2,3)"""
EDGES = BASIC + ", " + INNER + ", " + KNN.format(m=9) + ", " + BD + """, dk AS (SELECT kn.image_id, kn.i AS src, rank, bd.i, bd.j, m, row_number() OVER (PARTITION BY kn.image_id, kn.i ORDER BY m.d2, rank) AS rk FROM kn JOIN bd ON bd.image_id=kn.image_id AND bd.i=least(kn.i,kn.j) AND bd.j=greatest(kn.i,kn.j)),
ed AS (SELECT DISTINCT image_id, i, j, sqrt(m.d2) AS dist, m.iy AS iy, m.ix AS ix, m.jy AS jy, m.jx AS jx FROM dk WHERE rk<=3{cap})"""


def shapes(s, d):
    f = V.frags(s, d)
    return G.region_basic(f).join(G.region_moments(f), G.KEYS)


def edges(s, d, cap=None):
    f = V.frags(s, d)
    return C.knn_edges(G.region_basic(f), G.inner_boundary(f, sizes(s, d)), 3, 3, cap)


@query("f1_centroid_knn", "frags", BASIC + ", " + KNN.format(m=7) + " SELECT image_id, i, j, round(d2, 6) AS d2, rank FROM kn")
def _(s, d):
    return C.centroid_knn(G.region_basic(V.frags(s, d)), 7).withColumn("d2", rnd("d2"))


@query("f2_boundary_distance", "frags", BASIC + ", " + INNER + ", " + KNN.format(m=4) + ", " + BD + " SELECT image_id, i, j, round(sqrt(m.d2), 6) AS dist, m.iy AS iy, m.ix AS ix, m.jy AS jy, m.jx AS jx FROM bd")
def _(s, d):
    f = V.frags(s, d)
    k = C.centroid_knn(G.region_basic(f), 4)
    u = k.select("image_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return C.boundary_distance(u, G.inner_boundary(f, sizes(s, d))).withColumn("dist", rnd("dist"))


@query("f3_knn_edges", "frags", EDGES.replace("{cap}", " AND sqrt(m.d2)<=1.2") + " SELECT image_id, i, j, round(dist, 6) AS dist FROM ed")
def _(s, d):
    return edges(s, d, 1.2).select(*C.P, rnd("dist").alias("dist"))


WITHIN = "pw0 AS (SELECT a.image_id, a.label AS i, b.label AS j, sqrt(pow(a.cy-b.cy, 2)+pow(a.cx-b.cx, 2)) AS dist FROM bs a JOIN bs b ON a.image_id=b.image_id AND a.label<b.label WHERE pow(a.cy-b.cy, 2)+pow(a.cx-b.cx, 2) BETWEEN 1e-12 AND {r2})"


@query("f4_pairs_within", "frags", BASIC + ", " + WITHIN.format(r2=400) + " SELECT image_id, i, j, round(dist, 6) AS dist FROM pw0")
def _(s, d):
    return C.pairs_within(G.region_basic(V.frags(s, d)), 20.0).withColumn("dist", rnd("dist"))


def fold(a: str) -> str:
    return f"(CASE WHEN abs({a})%pi()>pi()/2 THEN pi()-abs({a})%pi() ELSE abs({a})%pi() END/(pi()/2))"


EF = EDGES.replace("{cap}", "").replace(INNER, INNER_SIZED) + ", " + MOM + """, sh AS (SELECT bs.image_id, bs.label, area, orientation, avg(major) OVER (PARTITION BY bs.image_id) AS mj, nb FROM bs JOIN mo USING (image_id, label) JOIN (SELECT image_id, label, count(*) AS nb FROM ib GROUP BY 1,2) USING (image_id, label)),
ee AS (SELECT ed.*, i*1000+j AS seg, a.area AS ia, b.area AS ja, a.orientation AS io, b.orientation AS jo, a.nb AS inb, b.nb AS jnb, a.mj AS mj, sqrt(pow(jy-iy, 2)+pow(jx-ix, 2)) AS len, atan2(CAST(jx-ix AS DOUBLE), CAST(jy-iy AS DOUBLE)) AS path FROM ed JOIN sh a ON a.image_id=ed.image_id AND a.label=i JOIN sh b ON b.image_id=ed.image_id AND b.label=j),
gs AS (SELECT image_id, seg, iy AS y0, ix AS x0, jy AS y1, jx AS x1, h, w FROM ee JOIN sz USING (image_id)), """ + profile_sql("gs", "region", 3, "h-1", "w-1", ", h, w") + """, gn AS (SELECT *, count(*) OVER (PARTITION BY image_id, seg) AS ns FROM lp), gi AS (SELECT image_id, seg, avg(v) AS gap FROM gn WHERE ns<=2 OR (i>0 AND i<ns-1) GROUP BY 1,2),
cs AS (SELECT image_id, seg*2 AS seg, iy::DOUBLE AS y0, ix::DOUBLE AS x0, iy-(jy-iy)/len*5 AS y1, ix-(jx-ix)/len*5 AS x1, h, w FROM ee JOIN sz USING (image_id) UNION ALL SELECT image_id, seg*2+1, jy::DOUBLE, jx::DOUBLE, jy+(jy-iy)/len*5, jx+(jx-ix)/len*5, h, w FROM ee JOIN sz USING (image_id)), """ + profile_sql("cs", "region", 1, "h-1", "w-1", ", h, w").replace("pn AS", "qn AS").replace("FROM pn", "FROM qn").replace("pi AS", "qi AS").replace("FROM pi,", "FROM qi,").replace("pj AS", "qj AS").replace("FROM pj", "FROM qj").replace("pc AS", "qc AS").replace("FROM pc,", "FROM qc,").replace("pw AS", "qw AS").replace("FROM pw ", "FROM qw ").replace("pw.", "qw.").replace("lp AS", "lq AS") + """,
cc AS (SELECT a.image_id, a.seg//2 AS seg, CASE WHEN count(*)>=3 AND stddev_pop(a.v)>1e-9 AND stddev_pop(b.v)>1e-9 THEN corr(a.v, b.v) ELSE 0 END AS cont FROM lq a JOIN lq b ON a.image_id=b.image_id AND b.seg=a.seg+1 AND a.i=b.i WHERE a.seg%2=0 GROUP BY 1,2),
di AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2,3)) AS i) a, (SELECT unnest(range(-2,3)) AS i) b WHERE a.i*a.i+b.i*b.i<=4),
sp AS MATERIALIZED (SELECT image_id, label, y, x, y+dy AS ny, x+dx AS nx FROM ib, di), ct AS (SELECT image_id, label, other, count(*) AS n FROM (SELECT DISTINCT sp.image_id, sp.label, b.label AS other, sp.y, sp.x FROM sp JOIN ib b ON b.image_id=sp.image_id AND b.y=ny AND b.x=nx WHERE b.label<>sp.label) GROUP BY 1,2,3)"""


@query("f5_edge_features", "frags", EF + f""" SELECT ee.image_id, i, j, round(gap, 4)+0.0 AS gap_intensity, round(dist/mj, 6) AS boundary_dist_norm, round({fold('path-io')}, 6)+0.0 AS node1_angle_diff, round({fold('path-jo')}, 6)+0.0 AS node2_angle_diff, round(least({fold('path-io')}, {fold('path-jo')}), 6)+0.0 AS min_diff_angle, round({fold('io-jo')}, 6)+0.0 AS relative_angle,
round(coalesce(n, 0)/CASE WHEN ia<=ja THEN inb ELSE jnb END, 6)+0.0 AS contact_frac, round(least(ia,ja)/greatest(ia,ja), 6) AS area_ratio, round(abs(cos(io-jo)), 6)+0.0 AS axis_collinearity, round(cont, 5)+0.0 AS intensity_continuity
FROM ee JOIN gi USING (image_id, seg) JOIN cc USING (image_id, seg) LEFT JOIN ct ON ct.image_id=ee.image_id AND ct.label=CASE WHEN ia<=ja THEN i ELSE j END AND ct.other=CASE WHEN ia<=ja THEN j ELSE i END""")
def _(s, d):
    f = V.frags(s, d)
    e = C.edge_features(edges(s, d), shapes(s, d), G.inner_boundary(f, sizes(s, d)), px(s, d), sizes(s, d))
    places = {"gap_intensity": 4, "intensity_continuity": 5}
    return e.select(*C.P, *[rnd(c, places.get(c, 6)).alias(c) for c in e.columns[3:]])


PF = BASIC + ", " + MOM + ", " + WITHIN.format(r2=256) + """, rr AS (SELECT bs.image_id, bs.label, cy, cx, orientation, avg(major) OVER (PARTITION BY bs.image_id) AS mj FROM bs JOIN mo USING (image_id, label)),
pe AS (SELECT w.*, i*1000+j AS seg, a.cy AS y0, a.cx AS x0, b.cy AS y1, b.cx AS x1, a.orientation AS io, b.orientation AS jo, a.mj FROM pw0 w JOIN rr a ON a.image_id=w.image_id AND a.label=i JOIN rr b ON b.image_id=w.image_id AND b.label=j),
op AS (SELECT image_id, y, x, v FROM region WHERE frag=0), """ + profile_sql("pe", "op", 3, "79").replace("pi AS (SELECT *, unnest(range(n)) AS i FROM pn)", "pi AS (SELECT * EXCLUDE (i, j), unnest(range(n)) AS i FROM pn)") + f""", pm AS (SELECT image_id, seg, coalesce(avg(v) FILTER (v>0), 0) AS ai FROM lp GROUP BY 1,2),
pf AS (SELECT pe.image_id, i, j, ai, dist/mj AS length, {fold('atan2(x1-x0, y1-y0)-io')} AS a1, {fold('atan2(x1-x0, y1-y0)-jo')} AS a2, {fold('io-jo')} AS ra FROM pe JOIN pm USING (image_id, seg))"""


def paths(s, d):
    f = V.frags(s, d)
    return C.path_features(C.pairs_within(G.region_basic(f), 16.0), shapes(s, d), px(s, d), f, sizes(s, d))


@query("f6_path_features", "frags", PF + " SELECT image_id, i, j, round(ai, 3)+0.0 AS average_intensity, round(length, 6) AS length, round(a1, 6)+0.0 AS node1_angle_diff, round(a2, 6)+0.0 AS node2_angle_diff, round(least(a1, a2), 6)+0.0 AS min_diff_angle, round(ra, 6)+0.0 AS relative_angle FROM pf")
def _(s, d):
    p = paths(s, d)
    return p.select(*C.P, rnd("average_intensity", 3).alias("average_intensity"), *[rnd(c).alias(c) for c in p.columns[4:]])


@query("g7_connectivity_score", "frags", PF + """, rw AS (SELECT *, ai*3*cos(least(a1, a2)*(pi()/2)) AS raw FROM pf), rx AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM rw WINDOW w AS (PARTITION BY image_id))
SELECT image_id, i, j, round((raw-lo)/CASE WHEN hi>lo THEN hi-lo ELSE 1 END*exp(-pow(length-5, 2)/12.5::DOUBLE), 7)+0.0 AS score FROM rx""")
def _(s, d):
    return C.connectivity_score(paths(s, d)).select(*C.P, rnd("score", 7).alias("score"))


@query("f7_vector_knn", "nodes", """dd AS (SELECT a.graph_id, a.node AS i, b.node AS j, round(sqrt(list_sum([pow(a.vec[k]-b.vec[k], 2) FOR k IN range(1, 65)])), 9) AS d FROM nodes a JOIN nodes b ON a.graph_id=b.graph_id AND a.node<>b.node)
SELECT graph_id, i, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM dd) WHERE rn<=5""")
def _(s, d):
    return C.vector_knn(V.nodes(s, d), 5).withColumn("d", rnd("d"))


@query("f8_dedupe_pairs", "pairs", """dv AS (SELECT graph_id, src, dst, round(prob*1.5, 9) AS u FROM pairs UNION ALL SELECT graph_id, dst, src, round(prob*2.5, 9) FROM pairs)
SELECT graph_id, src, dst, arg_min(u, src) OVER (PARTITION BY graph_id, least(src,dst), greatest(src,dst)) AS u FROM dv""")
def _(s, d):
    p = V.pairs(s, d)
    dirs = p.select("graph_id", "src", "dst", rnd(F.col("prob") * 1.5, 9).alias("u")).unionByName(p.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), rnd(F.col("prob") * 2.5, 9).alias("u")))
    return C.dedupe_pairs(dirs, "u").select("graph_id", "src", "dst", "u")


@query("f9_tile_with_halo", "mosaic", """tl AS (SELECT DISTINCT y//32 AS ty FROM mosaic), tc AS (SELECT DISTINCT x//32 AS tx FROM mosaic)
SELECT image_id, y, x, ty, tx, y//32=ty AND x//32=tx AS own FROM mosaic JOIN tl ON y>=ty*32-4 AND y<ty*32+36 JOIN tc ON x>=tx*32-4 AND x<tx*32+36""")
def _(s, d):
    t = T.tile_with_halo(V.mosaic(s, d).select("image_id", "y", "x"), 32, 4)
    top = V.mosaic(s, d).agg(F.expr("max(y) div 32").alias("my"), F.expr("max(x) div 32").alias("mx"))
    return t.crossJoin(F.broadcast(top)).filter("ty <= my AND tx <= mx").select("image_id", "y", "x", "ty", "tx", "own")


@query("f10_stitch_tiles", "tiles", "SELECT image_id, tile_id//2*6+fy-1 AS fy, tile_id%2*6+fx-1 AS fx, round(f, 6)+0.0 AS f, 8.0::DOUBLE AS pixels_per_feature FROM tiles WHERE fy BETWEEN 1 AND 6 AND fx BETWEEN 1 AND 6")
def _(s, d):
    return C.stitch_tiles(V.tiles(s, d), 2, 48, 8, 8).withColumn("f", rnd("f"))


def _odd(a: str, side: int) -> str:
    """Slot and source places of tiles of 12 pixels with a halo of 2 along one axis, 8 features each."""
    return f"""{a}0 AS (SELECT k, k*12 AS b, least(k*12+12, {side}) AS e, greatest(k*12-2, 0) AS o, least(least(k*12+12, {side})+2, {side})-greatest(k*12-2, 0) AS n FROM (VALUES (0),(1)) t(k)),
{a}1 AS (SELECT k, round_even((b-o)*8.0::DOUBLE/n, 0) AS f, round_even((e-o)*8.0::DOUBLE/n, 0)-round_even((b-o)*8.0::DOUBLE/n, 0) AS c, round_even(b/2.0::DOUBLE, 0) AS t, least(round_even(e/2.0::DOUBLE, 0), ceil({side}/2.0::DOUBLE))-round_even(b/2.0::DOUBLE, 0) AS m FROM {a}0),
{a}2 AS (SELECT *, greatest((i+0.5::DOUBLE)*c/m-0.5, 0) AS s FROM (SELECT *, unnest(range(CAST(m AS BIGINT))) AS i FROM {a}1)),
{a}3 AS (SELECT k, CAST(t+i AS BIGINT) AS t, CAST(f+least(floor(s)+z, c-1) AS BIGINT) AS p, CASE z WHEN 0 THEN 1-(s-floor(s)) ELSE s-floor(s) END AS q FROM {a}2, (VALUES (0),(1)) u(z))"""


@query("f10_stitch_odd_tiles", "tiles", _odd("ya", 20) + ", " + _odd("xa", 23) + """
SELECT image_id, ya3.t AS fy, xa3.t AS fx, round(sum(f*ya3.q*xa3.q), 6)+0.0 AS f, 2.0::DOUBLE AS pixels_per_feature FROM tiles JOIN ya3 ON ya3.k=tile_id//2 AND ya3.p=fy JOIN xa3 ON xa3.k=tile_id%2 AND xa3.p=fx GROUP BY 1,2,3""")
def _(s, d):
    t = V.tiles(s, d)
    shapes = t.select("image_id").distinct().select("image_id", F.lit(20).cast("long").alias("h"), F.lit(23).cast("long").alias("w"))
    return C.stitch_feature_map(t, shapes, 12, 2, 8).withColumn("f", rnd("f"))


@query("f11_roi_pool", "tiles", """ft AS (SELECT image_id, tile_id//2*6+fy-1 AS fy, tile_id%2*6+fx-1 AS fx, f FROM tiles WHERE fy BETWEEN 1 AND 6 AND fx BETWEEN 1 AND 6),
bx AS (SELECT image_id, k AS box, k*1.5::DOUBLE AS y1, (image_id%4)*1.0::DOUBLE AS x1, k*1.5::DOUBLE+6.5 AS y2, (image_id%4)+7.25::DOUBLE AS x2 FROM (SELECT DISTINCT image_id FROM tiles), (VALUES (0),(1),(2)) t(k)),
jn AS (SELECT bx.image_id, box, least(greatest(CAST(floor((fy+0.5-y1)/(y2-y1)*3) AS INT), 0), 2) AS by_, least(greatest(CAST(floor((fx+0.5-x1)/(x2-x1)*3) AS INT), 0), 2) AS bx_, f FROM bx JOIN ft ON ft.image_id=bx.image_id AND fy>=floor(y1) AND fy<=greatest(ceil(y2)-1, floor(y1)) AND fx>=floor(x1) AND fx<=greatest(ceil(x2)-1, floor(x1)))
SELECT image_id, box, by_ AS "by", bx_ AS bx, round(avg(f), 6)+0.0 AS f FROM jn GROUP BY 1,2,3,4""")
def _(s, d):
    ft = C.stitch_tiles(V.tiles(s, d), 2, 48, 8, 8)
    im = V.tiles(s, d).select("image_id").distinct().withColumn("box", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    y, x = F.col("box") * 1.5, (F.col("image_id") % 4).cast("double")
    return C.roi_pool(ft, im.select("image_id", "box", y.alias("y1"), x.alias("x1"), (y + 6.5).alias("y2"), (x + 7.25).alias("x2")), 3).withColumn("f", rnd("f"))
