"""Queries for region properties, matching and rules."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.operators import filters as N, labels as LB, matching as M, regions as G
from gridloom.plans.registry import query
from gridloom.sources import views as V

NB4 = "o4(dy, dx) AS (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1))"
OUTLINE = NB4 + """, nc AS (SELECT a.image_id, a.label, a.y, a.x, count(b.y) AS n FROM frags a CROSS JOIN o4 LEFT JOIN frags b ON b.image_id=a.image_id AND b.label=a.label AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY ALL),
ol AS (SELECT image_id, label, y, x FROM nc WHERE n<5)"""
INNER = OUTLINE + """, ib AS (SELECT image_id, label, y, x FROM nc WHERE n < 5-(y=0)::INT-(x=0)::INT-(y=79)::INT-(x=79)::INT)"""
SIZES = "sz AS (SELECT image_id, max(y)+1 AS h, max(x)+1 AS w FROM region GROUP BY 1)"
INNER_SIZED = OUTLINE + ", " + SIZES + """, ib AS (SELECT image_id, label, y, x FROM nc JOIN sz USING (image_id) WHERE n < 5-(y=0)::INT-(x=0)::INT-(y=h-1)::INT-(x=w-1)::INT)"""
BASIC = "bs AS (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS r0, min(x) AS c0, max(y)+1 AS r1, max(x)+1 AS c1 FROM frags GROUP BY 1,2)"
MOM = """mm AS (SELECT image_id, label, var_pop(y)+1/12::DOUBLE AS vy, var_pop(x)+1/12::DOUBLE AS vx, covar_pop(y, x) AS vxy FROM frags GROUP BY 1,2),
ml AS (SELECT *, (vy+vx)/2+sqrt(pow((vy-vx)/2, 2)+vxy*vxy) AS l1, greatest((vy+vx)/2-sqrt(pow((vy-vx)/2, 2)+vxy*vxy), 0) AS l2 FROM mm),
mo AS (SELECT image_id, label, 4*sqrt(l1) AS major, 4*sqrt(l2) AS minor, sqrt(1-l2/l1) AS eccentricity, CASE WHEN abs(vy-vx)<1e-9 THEN CASE WHEN vxy>1e-9 THEN pi()/4 ELSE -pi()/4 END ELSE 0.5*atan2(2*vxy, vy-vx) END AS orientation FROM ml)"""
# the same with moments from whole numbers
MOM_EXACT = """mm AS (SELECT image_id, label, CAST(n*syy-sy*sy AS DOUBLE)/CAST(n*n AS DOUBLE)+1/12::DOUBLE AS vy, CAST(n*sxx-sx*sx AS DOUBLE)/CAST(n*n AS DOUBLE)+1/12::DOUBLE AS vx, CAST(n*sxy-sx*sy AS DOUBLE)/CAST(n*n AS DOUBLE) AS vxy FROM (SELECT image_id, label, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(y*y) AS syy, sum(x*x) AS sxx, sum(x*y) AS sxy FROM frags GROUP BY 1,2)),
ml AS""" + MOM.split("ml AS", 1)[1]
PERIM = OUTLINE + """, o8 AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest([-1,0,1]) AS i) a, (SELECT unnest([-1,0,1]) AS i) b),
pc AS (SELECT a.image_id, a.label, a.y, a.x, sum(CASE abs(dy)+abs(dx) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code FROM ol a CROSS JOIN o8 JOIN ol b ON b.image_id=a.image_id AND b.label=a.label AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3,4),
pr AS (SELECT image_id, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1 WHEN code IN (21,33) THEN sqrt(2) WHEN code IN (13,23) THEN (1+sqrt(2))/2 ELSE 0 END) AS perimeter FROM pc GROUP BY 1,2)"""
RING = """dm AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-3,4)) AS i) a, (SELECT unnest(range(-3,4)) AS i) b WHERE abs(a.i)+abs(b.i)<=3),
rs AS (SELECT DISTINCT image_id, label, y+dy AS y, x+dx AS x FROM frags, dm), rg AS (SELECT rs.* FROM rs ANTI JOIN frags f ON f.image_id=rs.image_id AND f.label=rs.label AND f.y=rs.y AND f.x=rs.x),
rm AS (SELECT rg.image_id, label, avg(v) AS ring FROM rg JOIN region p ON p.image_id=rg.image_id AND p.y=rg.y AND p.x=rg.x GROUP BY 1,2),
it AS (SELECT image_id, frag AS label, avg(v) AS interior FROM region WHERE frag>0 GROUP BY 1,2), cx AS (SELECT it.image_id, it.label, interior, coalesce(ring, interior) AS context FROM it LEFT JOIN rm ON rm.image_id=it.image_id AND rm.label=it.label)"""
CIRC = "CASE WHEN perimeter>0 THEN 4*pi()*area/(perimeter*perimeter) ELSE 0 END"


def px(s, d):
    return V.region(s, d).select("image_id", "y", "x", "v")


def sizes(s, d):
    return N.image_sizes(V.region(s, d))


def r(df, *cols, places=6):
    return df.select("image_id", "label", *[rnd(c, places).alias(c) for c in cols])


def rq(*cols, places=6):
    return ", ".join(f"round({c}, {places})+0.0 AS {c}" for c in cols)


@query("c22_inner_boundary", "frags", INNER_SIZED + " SELECT image_id, label, y, x FROM ib")
def _(s, d):
    return G.inner_boundary(V.frags(s, d), sizes(s, d))


@query("d1_region_basic", "frags", BASIC + " SELECT image_id, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, r0, c0, r1, c1, round(area/((r1-r0)*(c1-c0)), 6) AS extent FROM bs")
def _(s, d):
    b = G.region_basic(V.frags(s, d))
    return b.withColumn("cy", rnd("cy")).withColumn("cx", rnd("cx")).withColumn("extent", rnd("extent"))


@query("d2_region_moments", "frags", MOM_EXACT + f" SELECT image_id, label, {rq('major', 'minor', 'eccentricity', 'orientation')} FROM mo")
def _(s, d):
    return r(G.region_moments(V.frags(s, d)), "major", "minor", "eccentricity", "orientation")


@query("d3_region_perimeter", "frags", PERIM + f", ar AS (SELECT image_id, label, count(*) AS area FROM frags GROUP BY 1,2) SELECT image_id, label, round(perimeter, 6)+0.0 AS perimeter, round({CIRC}, 6)+0.0 AS circularity FROM pr JOIN ar USING (image_id, label)")
def _(s, d):
    return r(G.region_perimeter(V.frags(s, d)), "perimeter", "circularity")


@query("d4_region_solidity")
def _(s, d):
    return r(G.region_solidity(V.frags(s, d)), "solidity")


@query("d5_region_intensity", "region", "SELECT image_id, frag AS label, round(avg(v), 6) AS interior FROM region WHERE frag>0 GROUP BY 1,2")
def _(s, d):
    return r(G.region_intensity(V.frags(s, d), px(s, d)), "interior")


@query("d6_context_ring", "frags", RING + f" SELECT image_id, label, {rq('interior', 'context')} FROM cx")
def _(s, d):
    return r(G.context_ring(V.frags(s, d), px(s, d), 3), "interior", "context")


@query("d7_node_features", "frags", ", ".join([BASIC, MOM, PERIM, RING]) + f""", al AS (SELECT bs.image_id, bs.label, area, major, minor, eccentricity, perimeter, interior, context, avg(area) OVER (PARTITION BY bs.image_id) AS ma, avg(major) OVER (PARTITION BY bs.image_id) AS mj FROM bs JOIN mo USING (image_id, label) JOIN pr USING (image_id, label) JOIN cx USING (image_id, label))
SELECT image_id, label, round({CIRC}, 6)+0.0 AS circularity, {rq('eccentricity')}, round(area/ma, 6) AS area_norm, round(major/mj, 6) AS major_axis_norm, round(minor/mj, 6) AS minor_axis_norm, round(interior, 6) AS interior_intensity, round(context, 6) AS context_intensity FROM al""")
def _(s, d):
    f = G.node_features(V.frags(s, d), px(s, d), 3, solidity=False)
    return r(f, *f.columns[2:])


@query("d7_node_features_full")
def _(s, d):
    f = G.node_features(V.frags(s, d), px(s, d))
    return r(f, *f.columns[2:])


@query("d8_nuclei_features", "frags", ", ".join([BASIC, MOM, PERIM]) + f""", it AS (SELECT image_id, frag AS label, avg(v) AS interior FROM region WHERE frag>0 GROUP BY 1,2)
SELECT image_id, label, round({CIRC}, 6)+0.0 AS circularity, {rq('eccentricity')}, area, round(interior, 6) AS average_intensity, round(major, 6) AS major_axis_length, round(minor, 6) AS minor_axis_length FROM bs JOIN mo USING (image_id, label) JOIN pr USING (image_id, label) JOIN it USING (image_id, label)""")
def _(s, d):
    f = G.nuclei_features(V.frags(s, d), px(s, d))
    return f.select(*G.KEYS, rnd("circularity").alias("circularity"), rnd("eccentricity").alias("eccentricity"), "area", *[rnd(c).alias(c) for c in f.columns[5:]])


FILT = ", ".join([BASIC, MOM]) + """, fl AS (SELECT image_id, label, major, CASE WHEN area<=0.8*avg(area) OVER w THEN 'small' WHEN area>=1.2*avg(area) OVER w THEN 'large' WHEN eccentricity<0.4 THEN 'round' ELSE 'kept' END AS reason FROM bs JOIN mo USING (image_id, label) WINDOW w AS (PARTITION BY image_id))"""


def filtered(s, d):
    f = V.frags(s, d)
    return G.filter_regions(G.region_basic(f).join(G.region_moments(f), G.KEYS), 0.8, 1.2, 0.4)


@query("d9_filter_regions", "frags", FILT + " SELECT image_id, label, reason FROM fl")
def _(s, d):
    return filtered(s, d).select(*G.KEYS, "reason")


@query("d9_filter_report", "frags", FILT + " SELECT image_id, reason, count(*) AS n, round(avg(major), 6) AS mean_major FROM fl GROUP BY 1,2")
def _(s, d):
    return G.filter_report(filtered(s, d)).withColumn("mean_major", rnd("mean_major"))


BOX = SIZES + """, bx AS (SELECT image_id, label, greatest(c0-0.1::DOUBLE*(c1-c0), 0) AS x1, greatest(r0-0.1::DOUBLE*(r1-r0), 0) AS y1, least(c1+0.1::DOUBLE*(c1-c0), w) AS x2, least(r1+0.1::DOUBLE*(r1-r0), h) AS y2 FROM bs JOIN sz USING (image_id))"""


@query("d10_node_box", "frags", BASIC + ", " + BOX + f" SELECT image_id, label, {rq('x1', 'y1', 'x2', 'y2')} FROM bx")
def _(s, d):
    return r(G.node_box(G.region_basic(V.frags(s, d)), sizes(s, d), 0.1), "x1", "y1", "x2", "y2")


@query("d10_centre_box", "frags", BASIC + " SELECT image_id, label, round(cx-4, 6)+0.0 AS x1, round(cy-4, 6)+0.0 AS y1, round(cx+4, 6) AS x2, round(cy+4, 6) AS y2 FROM bs")
def _(s, d):
    return r(G.centre_box(G.region_basic(V.frags(s, d)), 8), "x1", "y1", "x2", "y2")


def graph_boxes(s, d):
    """The region of a vector's own tile gives the node of the same number its box."""
    b = G.node_box(G.region_basic(V.frags(s, d)), sizes(s, d), 0.1)
    return b.select(F.col("image_id").alias("graph_id"), (F.col("image_id") * 100 + F.col("label") - 1).alias("node"), "x1", "y1", "x2", "y2")


@query("d11_edge_box", "pairs frags", BASIC + ", " + BOX + """, gb AS (SELECT image_id*100+label-1 AS node, * FROM bx)
SELECT graph_id, src, dst, round(least(a.x1, b.x1), 6) AS x1, round(least(a.y1, b.y1), 6) AS y1, round(greatest(a.x2, b.x2), 6) AS x2, round(greatest(a.y2, b.y2), 6) AS y2 FROM pairs JOIN gb a ON a.node=src JOIN gb b ON b.node=dst""")
def _(s, d):
    e = G.edge_box(V.pairs(s, d), graph_boxes(s, d))
    return e.select("graph_id", "src", "dst", *[rnd(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("d11_centroid_edge_box", "pairs frags", BASIC + """, gp AS (SELECT image_id*100+label-1 AS node, cy, cx FROM bs), e AS (SELECT graph_id, src, dst, a.cy AS ay, a.cx AS ax, b.cy AS byy, b.cx AS bx, greatest(greatest(abs(a.cx-b.cx), abs(a.cy-b.cy))*0.25, 6) AS m FROM pairs JOIN gp a ON a.node=src JOIN gp b ON b.node=dst)
SELECT graph_id, src, dst, round(least(ax, bx)-m, 6)+0.0 AS x1, round(least(ay, byy)-m, 6)+0.0 AS y1, round(greatest(ax, bx)+m, 6) AS x2, round(greatest(ay, byy)+m, 6) AS y2 FROM e""")
def _(s, d):
    b = G.region_basic(V.frags(s, d))
    pts = b.select(F.col("image_id").alias("graph_id"), (F.col("image_id") * 100 + F.col("label") - 1).alias("node"), "cy", "cx")
    e = G.centroid_edge_box(V.pairs(s, d), pts, 0.25, 6)
    return e.select("graph_id", "src", "dst", *[rnd(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("d12_crop_objects", "frags", BASIC + """ SELECT bs.image_id, bs.label, p.y-r0 AS y, p.x-c0 AS x, CASE WHEN p.frag=bs.label THEN p.v ELSE 0 END AS v FROM bs JOIN region p ON p.image_id=bs.image_id AND p.y>=r0 AND p.y<r1 AND p.x>=c0 AND p.x<c1""")
def _(s, d):
    return G.crop_objects(V.frags(s, d), px(s, d))


RUNS = "mr AS (SELECT image_id, label, y, x, x-row_number() OVER (PARTITION BY image_id, label, y ORDER BY x) AS g FROM frags), ru AS (SELECT image_id, label, y, min(x) AS first_x, max(x) AS last_x FROM mr GROUP BY image_id, label, y, g)"


@query("d13_mask_prompts", "frags", RUNS + " SELECT image_id, label, y, first_x, last_x FROM ru")
def _(s, d):
    return G.prompts(V.frags(s, d), "mask")


@query("d13_mask_boxes", "frags", """cl AS (SELECT image_id, (label-1)//10+1 AS label, y, x FROM frags) SELECT image_id, label, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2, count(*) AS area FROM cl GROUP BY 1,2""")
def _(s, d):
    runs = G.prompts(V.frags(s, d), "mask").withColumn("label", F.expr("(label-1) div 10 + 1"))  # masks of a row of fragments as one
    return G.mask_boxes(G.union_runs(runs))


@query("d13_point_prompts", "frags", BASIC + " SELECT image_id, label, CAST(floor(cx) AS BIGINT) AS x, CAST(floor(cy) AS BIGINT) AS y FROM bs")
def _(s, d):
    return G.prompts(G.region_basic(V.frags(s, d)), "point")


@query("d13_box_prompts", "frags", BASIC + " SELECT image_id, label, c0 AS x1, r0 AS y1, c1 AS x2, r1 AS y2 FROM bs")
def _(s, d):
    return G.prompts(G.region_basic(V.frags(s, d)), "box")


@query("d13_square_prompts", "frags", BASIC + """, md AS (SELECT image_id, CAST(floor(2*median(sqrt(area/pi()))) AS BIGINT) AS s FROM bs GROUP BY 1)
SELECT image_id, label, CAST(floor(cx) AS BIGINT)-s AS x1, CAST(floor(cy) AS BIGINT)-s AS y1, CAST(floor(cx) AS BIGINT)+s AS x2, CAST(floor(cy) AS BIGINT)+s AS y2 FROM bs JOIN md USING (image_id)""")
def _(s, d):
    return G.prompts(G.region_basic(V.frags(s, d)), "square", 2.0)


@query("d14_compose_masks", "frags", SIZES + """, o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2,3)) AS i) a, (SELECT unnest(range(-2,3)) AS i) b WHERE abs(a.i)+abs(b.i)<=2)
SELECT image_id, y+dy AS y, x+dx AS x, max(label) AS label FROM frags JOIN sz USING (image_id), o WHERE y+dy BETWEEN 0 AND h-1 AND x+dx BETWEEN 0 AND w-1 GROUP BY 1,2,3""")
def _(s, d):
    return G.compose_masks(N.dilate(V.frags(s, d), N.diamond(2), sizes(s, d)))


LAB = "lb AS (SELECT image_id, c, z, y, x, CASE WHEN v>30000 THEN (y//4)*2+x//4+1 ELSE 0 END AS label FROM stack)"


def slice_labels(s, d):
    lab = F.when(F.col("v") > 30000, F.expr("(y div 4)*2 + x div 4 + 1")).otherwise(0)
    return V.stack(s, d).select("image_id", "c", "z", "y", "x", lab.alias("label"))


@query("d15_offset_labels", "stack", LAB + """, tp AS (SELECT image_id, c, z, max(label) AS m FROM lb GROUP BY 1,2,3), of AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY image_id, c ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM tp)
SELECT image_id, c, z, y, x, CAST(CASE WHEN label>0 THEN label+off ELSE 0 END AS BIGINT) AS label FROM lb JOIN of USING (image_id, c, z)""")
def _(s, d):
    return G.offset_labels(slice_labels(s, d))


OV = """ov AS (SELECT image_id, frag, gt, count(*) AS n FROM region WHERE frag>0 GROUP BY 1,2,3), ar AS (SELECT image_id, frag, sum(n) AS area FROM ov GROUP BY 1,2),
bo AS (SELECT ar.image_id, ar.frag, area, gt, coalesce(n, 0) AS n, coalesce(n, 0)/area AS overlap FROM ar LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, frag ORDER BY n DESC, gt) AS rn FROM ov WHERE gt>0) o ON o.image_id=ar.image_id AND o.frag=ar.frag AND rn=1)"""
TH = [0.01, 0.1, 0.3, 0.5, 0.7, 0.9]


@query("e1_assign_to_gt", "region", OV + " SELECT image_id, frag, CASE WHEN gt IS NOT NULL AND n>=0.5*area THEN gt ELSE -1 END AS gt FROM bo")
def _(s, d):
    return M.assign_to_gt(V.region(s, d), 0.5)


@query("e2_best_overlap", "region", OV + " SELECT image_id, frag, gt, round(overlap, 6) AS overlap FROM bo")
def _(s, d):
    return M.best_overlap(V.region(s, d)).select("image_id", "frag", "gt", rnd("overlap").alias("overlap"))


@query("e3_threshold_sweep", "region", OV + f", th AS (SELECT unnest({TH}::DOUBLE[]) AS threshold) SELECT threshold, image_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (overlap<threshold) AS BIGINT) AS background, round(100.0::DOUBLE*count(*) FILTER (overlap<threshold)/count(*), 6) AS background_pct FROM bo, th GROUP BY GROUPING SETS ((threshold, image_id), (threshold))")
def _(s, d):
    return M.threshold_sweep(M.best_overlap(V.region(s, d)), TH).withColumn("background_pct", rnd("background_pct"))


@query("e4_disputed", "region", OV + " SELECT image_id, frag, gt, round(overlap, 6) AS overlap FROM bo WHERE overlap>=0.3 AND overlap<0.7")
def _(s, d):
    return M.disputed(M.best_overlap(V.region(s, d)), 0.3, 0.7).select("image_id", "frag", "gt", rnd("overlap").alias("overlap"))


def cells(s, d):
    return V.region(s, d).filter("gt > 0").select("image_id", F.col("gt").alias("label"), "y", "x")


def shape_metrics(s, d, solidity=False):
    c = cells(s, d)
    b = G.region_basic(c).join(G.region_moments(c), G.KEYS).join(G.region_perimeter(c), G.KEYS)
    b = b.join(G.region_solidity(c), G.KEYS) if solidity else b.withColumn("solidity", F.lit(None).cast("double"))
    return M.cell_metrics(b)


def rules(s, d):
    im = V.table(s, d, "embeddings").select(F.expr("vec_id div 100").alias("image_id")).distinct()
    k = F.col("image_id") % 4
    return im.select(
        "image_id", F.when(k == 0, "hyphal").alias("all_type"), F.when(k == 1, "mean_width").when(k == 2, "axis_ratio").when(k == 3, "eccentricity").alias("metric"),
        F.when(k == 1, 8.0).when(k == 2, 1.6).when(k == 3, 0.7).alias("threshold"),
    )


CELLS = "gc AS (SELECT image_id, gt AS label, y, x FROM region WHERE gt>0), "
CELLM = CELLS + ", ".join([BASIC, MOM, PERIM]).replace("frags", "gc") + f""", me AS (SELECT image_id, label, area/greatest(major, 1e-9) AS mean_width, minor AS minor_axis, area/((r1-r0)*(c1-c0)) AS extent, major/greatest(minor, 1e-9) AS axis_ratio, 4*pi()*area/greatest(perimeter*perimeter, 1e-9) AS circularity, eccentricity FROM bs JOIN mo USING (image_id, label) JOIN pr USING (image_id, label))"""
TYPES = CELLM + """, ct AS (SELECT image_id, label, CASE image_id%4 WHEN 0 THEN 'hyphal' WHEN 1 THEN CASE WHEN mean_width<8 THEN 'hyphal' ELSE 'epithelial' END WHEN 2 THEN CASE WHEN axis_ratio>1.6 THEN 'hyphal' ELSE 'epithelial' END ELSE CASE WHEN eccentricity>0.7 THEN 'hyphal' ELSE 'epithelial' END END AS cell_type FROM me)"""


@query("e5_classify_cells", "region", TYPES + " SELECT image_id, label, cell_type FROM ct")
def _(s, d):
    return M.classify_cells(shape_metrics(s, d), rules(s, d))


NAMES = ["mean_width", "minor_axis", "extent", "axis_ratio", "circularity", "eccentricity"]


# the same with moments and perimeters from whole numbers
PERIM_EXACT = PERIM[: PERIM.index("pr AS (")] + """pr AS (SELECT image_id, label, count(*) FILTER (code IN (5,7,15,17,25,27))*1.0::DOUBLE + count(*) FILTER (code IN (21,33))*sqrt(2) + count(*) FILTER (code IN (13,23))*((1+sqrt(2))/2) AS perimeter FROM pc GROUP BY 1,2)"""
CELLM_EXACT = CELLM.replace(MOM.replace("frags", "gc"), MOM_EXACT.replace("frags", "gc")).replace(PERIM.replace("frags", "gc"), PERIM_EXACT.replace("frags", "gc"))
# the cut with the least squared error, of whole millionths; equal errors go to the smaller value
CUTS = f"""ln AS (SELECT image_id, label, metric, CAST(least(greatest(floor(value*1000000.0::DOUBLE+0.5::DOUBLE), -9e18::DOUBLE), 9e18::DOUBLE) AS BIGINT) AS u FROM (UNPIVOT me ON {', '.join(NAMES)} INTO NAME metric VALUE value)),
tb AS (SELECT image_id, metric, u, count(*) AS n, CAST(u AS HUGEINT)*count(*) AS s FROM ln GROUP BY 1,2,3),
tc AS (SELECT *, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER t AS nt, sum(s) OVER t AS st FROM tb WINDOW w AS (PARTITION BY image_id, metric ORDER BY u), t AS (PARTITION BY image_id, metric)),
td AS (SELECT *, CAST(s1*nt-st*n1 AS DOUBLE) AS off FROM tc WHERE n1 < nt),
tm AS (SELECT image_id, metric, u AS low_max FROM (SELECT *, row_number() OVER (PARTITION BY image_id, metric ORDER BY off*off/(CAST(n1 AS DOUBLE)*CAST(nt-n1 AS DOUBLE)) DESC, u) AS rn FROM td) WHERE rn=1)"""


@query("e6_compare_metrics", "region", CELLM_EXACT + ", " + CUTS + """
SELECT image_id, label, metric, CASE WHEN low_max IS NULL THEN NULL WHEN (u > low_max) = (metric IN ('axis_ratio', 'eccentricity')) THEN 'hyphal' ELSE 'epithelial' END AS cell_type FROM ln LEFT JOIN tm USING (image_id, metric)""")
def _(s, d):
    return M.compare_metrics(shape_metrics(s, d), NAMES)


@query("e7_node_types", "region", OV + ", " + TYPES + """ SELECT bo.image_id, frag, coalesce(CASE cell_type WHEN 'epithelial' THEN 1 WHEN 'hyphal' THEN 2 END, 0) AS node_type FROM bo LEFT JOIN ct ON ct.image_id=bo.image_id AND ct.label=bo.gt AND n>=0.1*area""")
def _(s, d):
    return M.node_types(M.assign_to_gt(V.region(s, d), 0.1), M.classify_cells(shape_metrics(s, d), rules(s, d)))


# ---- labels of candidate graphs ------------------------------------------------------------


def truth_pairs(s, d):
    """True pairs, written in falling order, including some that are no candidates."""
    p = V.pairs(s, d).filter("true_label = 1").select(F.col("dst").alias("u"), F.col("src").alias("v"))
    n = V.nodes(s, d).filter("node % 10 = 0 AND node % 100 <> 0").select(F.col("node").alias("u"), (F.col("node") - 10).alias("v"))
    return p.unionByName(n)


@query("e9_edge_labels", "pairs", """tp AS (SELECT src AS a, dst AS b FROM pairs WHERE true_label=1 UNION SELECT node-10, node FROM nodes WHERE node%10=0 AND node%100<>0)
SELECT graph_id, src, dst, CAST(tp.a IS NOT NULL AS INT) AS edge_label FROM pairs LEFT JOIN tp ON a=src AND b=dst""")
def _(s, d):
    return LB.edge_labels(V.pairs(s, d), truth_pairs(s, d)).select("graph_id", "src", "dst", "edge_label")


@query("e9_edge_labels_listed", "pairs", "SELECT graph_id, src, dst, true_label AS edge_label FROM pairs")
def _(s, d):
    p = V.pairs(s, d)
    flags = p.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "true_label"))).alias("c"))  # a view's graph has 100 nodes at most
    cands = flags.select("graph_id", F.posexplode("c").alias("pos", "c")).select("graph_id", "c.src", "c.dst", "pos")
    return LB.edge_labels_listed(cands, flags.select("graph_id", F.col("c.true_label").alias("labels"))).select("graph_id", "src", "dst", "edge_label")


@query("e10_trim_long_negatives", "pairs", "SELECT graph_id, src, dst, true_label, prob FROM pairs WHERE true_label<>0 OR prob<=0.65")
def _(s, d):
    return LB.trim_long_negatives(V.pairs(s, d), "prob", 0.65).select("graph_id", "src", "dst", "true_label", "prob")


@query("e11_true_degree", "pairs", "SELECT n.graph_id, n.node, count(p.src) AS degree FROM nodes n LEFT JOIN (SELECT src, dst FROM pairs WHERE true_label=1) p ON p.src=n.node OR p.dst=n.node GROUP BY 1,2")
def _(s, d):
    return LB.true_degree(V.pairs(s, d), V.nodes(s, d).select("graph_id", "node"))


@query("e12_to_undirected", "pairs", """a AS (SELECT graph_id, src, dst, prob, prob*prob AS n1, prob/2 AS n2 FROM pairs)
SELECT graph_id, src, dst, prob, round(n1, 9) AS node1_angle_diff, round(n2, 9) AS node2_angle_diff FROM a UNION ALL SELECT graph_id, dst, src, prob, round(n2, 9), round(n1, 9) FROM a""")
def _(s, d):
    p = V.pairs(s, d).select("graph_id", "src", "dst", "prob", rnd(F.col("prob") * F.col("prob"), 9).alias("node1_angle_diff"), rnd(F.col("prob") / 2, 9).alias("node2_angle_diff"))
    return LB.to_undirected(p)


@query("e13_recall_ceiling", "pairs", """t AS (SELECT graph_id, src, dst FROM pairs WHERE true_label=1 UNION SELECT graph_id, node-10, node FROM nodes WHERE node%10=0 AND node%100<>0)
SELECT t.graph_id, count(*) AS true_pairs, CAST(count(*) FILTER (c.src IS NULL) AS BIGINT) AS missed FROM t LEFT JOIN pairs c ON c.graph_id=t.graph_id AND c.src=t.src AND c.dst=t.dst GROUP BY ROLLUP (t.graph_id)""")
def _(s, d):
    t = truth_pairs(s, d).select(F.expr("u div 100").alias("graph_id"), F.col("v").alias("src"), F.col("u").alias("dst")).distinct()
    return LB.recall_ceiling(V.pairs(s, d), t)


PAIRS6 = ["background_background", "background_epithelial", "background_hyphal", "epithelial_epithelial", "epithelial_hyphal", "hyphal_hyphal"]


@query("e14_negatives_by_type_pair", "pairs", "ty AS (SELECT node, CASE node_type WHEN 0 THEN 'background' WHEN 1 THEN 'epithelial' ELSE 'hyphal' END AS t FROM nodes), e AS (SELECT graph_id, least(a.t,b.t)||'_'||greatest(a.t,b.t) AS pair FROM pairs JOIN ty a ON a.node=src JOIN ty b ON b.node=dst WHERE true_label=0) SELECT graph_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (pair='{p}') AS {p}, 100.0::DOUBLE*count(*) FILTER (pair='{p}')/count(*) AS {p}_pct" for p in PAIRS6) + " FROM e GROUP BY ROLLUP (graph_id)")
def _(s, d):
    from gridloom.plans.evaluation import type_names

    return LB.negatives_by_type_pair(V.pairs(s, d), type_names(s, d), PAIRS6)


