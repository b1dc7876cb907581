"""Queries for sources, layouts and pixel-wise operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.functions.rounds import shared_dir
from gridloom.operators import layout as L, raster as R
from gridloom.plans.registry import query
from gridloom.sources import views as V


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def acquisitions(spark, d):
    """File names in the style of a microscope export, spread over the folders (hosts)."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    name = F.concat(
        F.lit("exp"), F.expr("page_id div 4").cast("string"), F.lit("_C"), (F.col("page_id") % 4 + 1).cast("string"),
        F.lit("_MAX_CY5, FITC,dapi.tif"),
    )
    return V.files(spark, d).select("page_id", F.concat(host, F.lit("/"), name).alias("path"))


ACQ = """acq AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || '/' || 'exp' || (page_id//4) || '_C' || (page_id%4+1) || '_MAX_CY5, FITC,dapi.tif' AS path FROM files)"""
PARSED = ACQ + """, nm AS (SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS file FROM acq),
st AS (SELECT *, regexp_replace(file, '\\.[^.]*$', '') AS stem, TRY_CAST(regexp_extract(file, 'C(\\d+)', 1) AS INT) AS channel_no FROM nm),
parsed AS (SELECT *, [trim(u) FOR u IN string_split(list_last(string_split(stem, '_')), ',')] AS channels, regexp_replace(stem, '_C\\d_', '_') AS base FROM st)"""


@query("a1_scan_files")
def _(s, d):
    return L.scan_files(s, [d], "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("a2_parse_file_name", "files", PARSED + """ SELECT page_id, folder, stem, array_to_string(channels, '|') AS channels, channel_no, CASE WHEN channel_no BETWEEN 1 AND len(channels) THEN channels[channel_no] ELSE stem END AS channel, base FROM parsed""")
def _(s, d):
    p = L.parse_file_name(acquisitions(s, d))
    return p.select("page_id", "folder", "stem", F.array_join("channels", "|").alias("channels"), "channel_no", "channel", "base")


@query("a2_composite_name", "files", PARSED + """, ch AS (SELECT DISTINCT folder, base, file, CASE WHEN channel_no BETWEEN 1 AND len(channels) THEN channels[channel_no] ELSE stem END AS channel FROM parsed)
SELECT folder, base, base || '_' || string_agg(channel, ',' ORDER BY file) AS name FROM ch GROUP BY 1,2""")
def _(s, d):
    return L.composite_name(L.parse_file_name(acquisitions(s, d)))


@query("a3_find_channel", "files", PARSED + """, ref AS (SELECT folder, base, arg_min([upper(u) FOR u IN channels], file) AS r FROM parsed GROUP BY 1,2)
SELECT folder, base, min(file) AS file FROM parsed JOIN ref USING (folder, base) WHERE list_position(r, 'DAPI') > 0 AND contains(file, 'C' || list_position(r, 'DAPI')) GROUP BY 1,2""")
def _(s, d):
    return L.find_channel(L.parse_file_name(acquisitions(s, d)), "DAPI")


@query("a4_complete_acquisitions", "files", ACQ + """, r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, CASE page_id % 5 WHEN 0 THEN 'signal' WHEN 1 THEN 'nuclei' WHEN 2 THEN 'labels' ELSE 'other' END AS role FROM acq)
SELECT folder, min(path) FILTER (role='signal') AS signal, min(path) FILTER (role='nuclei') AS nuclei, min(path) FILTER (role='labels') AS labels FROM r GROUP BY 1 HAVING signal IS NOT NULL AND nuclei IS NOT NULL AND labels IS NOT NULL""")
def _(s, d):
    m = F.col("page_id") % 5
    role = F.when(m == 0, "signal").when(m == 1, "nuclei").when(m == 2, "labels").otherwise("other")
    a = acquisitions(s, d).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "path", role.alias("role"))
    return L.complete_acquisitions(a, ["signal", "nuclei", "labels"])


@query("a5_rasters_to_pixels", "emb", "SELECT vec_id AS image_id, pos//8 AS y, pos%8 AS x, round(e, 6)+0.0 AS v FROM emb")
def _(s, d):
    p = L.rasters_to_pixels(V.table(s, d, "embeddings"), 8, "embedding", "vec_id")
    return p.withColumn("v", rnd("v"))


@query("a6_pixels_to_rasters", "pix", "SELECT image_id, y//4 AS ty, x//4 AS tx, max(y)-min(y)+1 AS h, max(x)-min(x)+1 AS w, list(v ORDER BY y, x) AS data FROM pix GROUP BY 1,2,3")
def _(s, d):
    return L.pixels_to_rasters(V.pix(s, d), ["image_id"], 4)


@query("a7_write_chunked", "stack", """l1 AS (SELECT image_id, c, z, y//2 AS y, x//2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM stack GROUP BY ALL), l2 AS (SELECT image_id, c, z, y//2 AS y, x//2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM l1 GROUP BY ALL)
SELECT CAST(0 AS BIGINT) AS level, image_id, c, z, y, x, CAST(v AS BIGINT) AS v FROM stack UNION ALL SELECT 1, image_id, c, z, y, x, v FROM l1 UNION ALL SELECT 2, image_id, c, z, y, x, v FROM l2""")
def _(s, d):
    path = scratch(s)
    L.write_chunks(R.pyramid(V.stack(s, d), 3, R.SLICE), path, 4)
    return s.read.parquet(path).select(*[F.col(k).cast("long").alias(k) for k in ("level", "image_id", "c", "z", "y", "x", "v")])


@query("a8_read_profiles", "profile", "SELECT label, count(*) AS n, round(max(distance), 6)+0.0 AS max_distance FROM profile GROUP BY 1")
def _(s, d):
    path = scratch(s)
    L.write_csv(V.profile(s, d), path)
    r = L.read_profiles(s, path)  # how rows are dealt to files is Spark's choice
    return r.groupBy(F.regexp_replace("label", r"_f\d+$", "").alias("label")).agg(F.count("*").alias("n"), rnd(F.max("distance")).alias("max_distance"))


@query("a9_read_metrics", "metrics", "SELECT repeat, fold, " + ", ".join(f"round(avg(value) FILTER (tag='{t}'), 6)+0.0 AS {t}" for t in ("auc", "f1", "pr_auc")) + " FROM metrics GROUP BY 1,2")
def _(s, d):
    path = scratch(s)
    L.write_csv(V.metrics(s, d).select("repeat", "fold", "step", "tag", "value"), path)
    return L.read_metrics(s, path).groupBy("repeat", "fold").pivot("tag", ["auc", "f1", "pr_auc"]).agg(rnd(F.avg("value")))


@query("a10_write_graph", "nodes pairs", """pos AS (SELECT src, dst FROM pairs WHERE true_label = 1), deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pos UNION ALL SELECT dst FROM pos) GROUP BY 1)
SELECT graph_id, node, node_type, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node)""")
def _(s, d):
    path = scratch(s)
    L.write_graph(V.nodes(s, d).drop("vec"), V.pairs(s, d).filter("true_label = 1"), path)
    n, e = L.read_graph(s, path)
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return n.join(deg, "node", "left").select("graph_id", "node", "node_type", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("a11_save_dataset", "nodes pairs", "SELECT n.graph_id, n_nodes, n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, count(*) AS n_edges FROM pairs GROUP BY 1) e USING (graph_id)")
def _(s, d):
    path = scratch(s)
    L.write_graph(V.nodes(s, d), V.pairs(s, d), path)
    n, e = L.read_graph(s, path, drop=("vec",))
    counts = e.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(counts, "graph_id", "left")


@query("b1_split_channels", "stack", "SELECT image_id, c, z, y, x, v FROM stack")
def _(s, d):
    return R.split_channels(V.pages(s, d), 3)


MID = """n AS (SELECT image_id, c, count(DISTINCT z) AS n FROM stack GROUP BY 1,2),
mid AS (SELECT stack.* FROM stack JOIN n USING (image_id, c) WHERE n <= 3 OR (z >= (n - n//3)//2 AND z < (n - n//3)//2 + n//3))"""


@query("b2_middle_slices", "stack", MID + " SELECT image_id, c, z, y, x, v FROM mid")
def _(s, d):
    return R.middle_slices(V.stack(s, d), 3)


@query("b3_project_max", "stack", "SELECT image_id, c, y, x, max(v) AS v FROM stack GROUP BY ALL")
def _(s, d):
    return R.project_max(V.stack(s, d))


def sharp(src: str) -> str:
    return f"""q AS (SELECT image_id, c, z, quantile_cont(v, 0.0035) AS lo, quantile_cont(v, 0.9965) AS hi FROM {src} GROUP BY 1,2,3),
cl AS (SELECT image_id, c, z, y, x, least(greatest(CAST(v AS DOUBLE), lo), hi) AS v FROM {src} JOIN q USING (image_id, c, z)),
ker(dy, dx, w) AS (VALUES (0,0,-4.0::DOUBLE),(1,0,1.0),(-1,0,1.0),(0,1,1.0),(0,-1,1.0)),
lap AS (SELECT a.image_id, a.c, a.z, a.y, a.x, any_value(a.v) AS v, sum(w*b.v) AS lap FROM cl a, ker JOIN cl b ON b.image_id=a.image_id AND b.c=a.c AND b.z=a.z
  AND b.y = CASE WHEN a.y+dy<0 THEN -(a.y+dy) WHEN a.y+dy>7 THEN 14-(a.y+dy) ELSE a.y+dy END AND b.x = CASE WHEN a.x+dx<0 THEN -(a.x+dx) WHEN a.x+dx>7 THEN 14-(a.x+dx) ELSE a.x+dx END GROUP BY 1,2,3,4,5),
sc AS (SELECT image_id, c, z, var_pop(lap) AS laplacian, stddev_pop(v)/avg(v) AS normalized_variance, var_pop(v)/(avg(v)*avg(v))*avg(abs(lap)) AS combined FROM lap GROUP BY 1,2,3)"""


@query("b4_sharpness", "stack", sharp("stack") + " SELECT image_id, c, z, round(laplacian, 2) AS laplacian, round(normalized_variance, 8) AS normalized_variance, round(combined, 5) AS combined FROM sc")
def _(s, d):
    return R.sharpness(V.stack(s, d)).select(*R.SLICE, rnd("laplacian", 2).alias("laplacian"), rnd("normalized_variance", 8).alias("normalized_variance"), rnd("combined", 5).alias("combined"))


BEST = sharp("mid") + """, best AS (SELECT image_id, c, arg_min(z, (-{m}, z)) AS z FROM sc GROUP BY 1,2)"""


@query("b5_project_sharpest", "stack", MID + ", " + BEST.format(m="combined") + " SELECT image_id, c, z, y, x, v FROM stack JOIN best USING (image_id, c, z)")
def _(s, d):
    return R.project_sharpest(V.stack(s, d), "combined")


@query("b5_project_manual_slice", "stack", "SELECT image_id, c, z, y, x, v FROM stack WHERE z = 5")
def _(s, d):
    return R.project_sharpest(V.stack(s, d), 5, check=False).select(*R.SLICE, "y", "x", "v")


@query("b6_clip_percentile", "stack", """q AS (SELECT image_id, c, z, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM stack GROUP BY 1,2,3)
SELECT image_id, c, z, y, x, round(least(greatest(CAST(v AS DOUBLE), lo), hi), 6) AS v FROM stack JOIN q USING (image_id, c, z)""")
def _(s, d):
    return R.clip_percentile(V.stack(s, d), 0.5, 99.5, R.SLICE).withColumn("v", rnd("v"))


SUB = """, d AS (SELECT s.image_id, s.c, s.y, s.x, b.z, max(s.v) FILTER (s.z = b.z+1) AS u, max(s.v) FILTER (s.z = b.z-1) AS l, max(s.v) FILTER (s.z = b.z) AS m FROM stack s JOIN best b ON b.image_id=s.image_id AND b.c=s.c GROUP BY 1,2,3,4,5)"""


@query("b7_subtract_direct", "stack", MID + ", " + BEST.format(m="laplacian") + SUB + " SELECT image_id, c, y, x, z, CAST(u-l AS DOUBLE) AS v FROM d WHERE u IS NOT NULL AND l IS NOT NULL")
def _(s, d):
    return R.subtract_adjacent(V.stack(s, d), "direct")


@query("b7_subtract_average", "stack", MID + ", " + BEST.format(m="normalized_variance") + SUB + " SELECT image_id, c, y, x, z, m - 0.5::DOUBLE*(u+l) AS v FROM d WHERE u IS NOT NULL AND l IS NOT NULL")
def _(s, d):
    return R.subtract_adjacent(V.stack(s, d), "average", method="normalized_variance")


@query("b8_minmax_u16", "pix", """m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pix GROUP BY 1)
SELECT image_id, y, x, CASE WHEN hi>lo THEN CAST(floor(65535.0::DOUBLE*(v-lo)/(hi-lo)) AS BIGINT) ELSE 0 END AS v FROM pix JOIN m USING (image_id)""")
def _(s, d):
    return R.minmax_u16(V.pix(s, d))


@query("b9_minmax_round", "stack", """m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM stack GROUP BY 1)
SELECT image_id, c, z, y, x, CASE WHEN hi>lo THEN CAST(round_even((v-lo)/(hi-lo)*255.0::DOUBLE, 0) AS BIGINT) ELSE 0 END AS v FROM stack JOIN m USING (image_id)""")
def _(s, d):
    return R.minmax_round(V.stack(s, d), 8)


@query("b10_contrast_stretch", "pix", """q AS (SELECT image_id, CAST(round(quantile_cont(v, 0.02)*50) AS BIGINT) AS lo, CAST(round(quantile_cont(v, 0.98)*50) AS BIGINT) AS hi FROM pix GROUP BY 1)
SELECT image_id, y, x, CASE WHEN hi>lo THEN (least(greatest(CAST(v AS BIGINT)*50, lo), hi)-lo)*65535//(hi-lo) ELSE 0 END AS v FROM pix JOIN q USING (image_id)""")
def _(s, d):
    return R.contrast_stretch(V.pix(s, d), 2.0)


@query("b11_quantize8", "pix", "SELECT image_id, y, x, CAST(floor(v/257) AS BIGINT) AS v FROM pix")
def _(s, d):
    return R.quantize8(V.pix(s, d))


@query("b12_display_stretch", "stack", """q AS (SELECT image_id, c, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM stack GROUP BY 1,2)
SELECT image_id, c, z, y, x, round(least(greatest((v-lo)/greatest(hi-lo, 1e-6), 0.0), 1.0), 8)+0.0 AS v FROM stack JOIN q USING (image_id, c)""")
def _(s, d):
    return R.display_stretch(V.stack(s, d)).withColumn("v", rnd("v", 8))


@query("b13_sum_and_stretch", "stack", """t AS (SELECT image_id, z, y, x, sum(v) AS t FROM stack GROUP BY ALL), m AS (SELECT image_id, min(t) AS lo, max(t) AS hi FROM t GROUP BY 1)
SELECT image_id, z, y, x, CASE WHEN hi>lo THEN CAST(floor(CAST(t-lo AS DOUBLE)/CAST(hi-lo AS DOUBLE)*65535) AS BIGINT) ELSE 0 END AS v FROM t JOIN m USING (image_id)""")
def _(s, d):
    return R.sum_and_stretch(V.stack(s, d), coords=("z", "y", "x"))


@query("b14_merge_channels", "pgs", """f AS (SELECT image_id, page%(1+image_id%4) AS c, page//(1+image_id%4) AS z, y, x, v FROM pgs),
p AS (SELECT image_id, z, y, x, count(*) AS n, max(v) FILTER (c=0) AS c0, max(v) FILTER (c=1) AS c1, max(v) FILTER (c=2) AS c2, sum(v) FILTER (c>=2) AS tail FROM f GROUP BY ALL),
k AS (SELECT *, CAST(CASE WHEN n=2 THEN c0+c1 WHEN n>3 THEN tail END AS DOUBLE) AS mix FROM p), mm AS (SELECT image_id, min(mix) AS lo, max(mix) AS hi FROM k GROUP BY 1),
g AS (SELECT k.*, CASE WHEN hi>lo THEN floor((mix-lo)/(hi-lo)*65535) ELSE 0 END AS g FROM k JOIN mm USING (image_id))
SELECT image_id, z, y, x, CAST(CASE n WHEN 1 THEN c0 WHEN 2 THEN g ELSE c0 END AS BIGINT) AS r, CAST(CASE n WHEN 1 THEN c0 WHEN 2 THEN g ELSE c1 END AS BIGINT) AS g, CAST(CASE n WHEN 1 THEN c0 WHEN 2 THEN g WHEN 3 THEN c2 ELSE g END AS BIGINT) AS b FROM g""")
def _(s, d):
    pages = V.pages(s, d)  # 1 to 4 channels, by image
    return R.merge_channels(pages.selectExpr("image_id", "page % (1 + image_id % 4) AS c", "page div (1 + image_id % 4) AS z", "y", "x", "v"))


@query("b15_stack_channels", "stack", "SELECT image_id, z, y, x, max(v) FILTER (c=0) AS c0, max(v) FILTER (c=1) AS c1, max(v) FILTER (c=2) AS c2 FROM stack GROUP BY ALL")
def _(s, d):
    return R.stack_channels(V.stack(s, d), [0, 1, 2])


@query("b16_resize_nearest", "pix", """t AS (SELECT unnest(range(12)) AS i), g AS (SELECT a.i AS y, b.i AS x FROM t a, t b)
SELECT image_id, g.y, g.x, v FROM pix JOIN g ON pix.y = CAST(floor(g.y*8/12) AS BIGINT) AND pix.x = CAST(floor(g.x*8/12) AS BIGINT)""")
def _(s, d):
    return R.resize_nearest(V.pix(s, d), 12)


@query("b17_resize_area", "pix", """t AS (SELECT unnest(range(5)) AS i), o AS (SELECT t.i AS t, s.i AS s, least((s.i+1)*5/8, t.i+1) - greatest(s.i*5/8, t.i) AS w FROM t, (SELECT unnest(range(8)) AS i) s WHERE least((s.i+1)*5/8, t.i+1) - greatest(s.i*5/8, t.i) > 1e-12)
SELECT image_id, a.t AS y, b.t AS x, round(sum(v*a.w*b.w)/sum(a.w*b.w), 4) AS v FROM pix JOIN o a ON a.s = y JOIN o b ON b.s = x GROUP BY ALL""")
def _(s, d):
    return R.resize_area(V.pix(s, d), 5).withColumn("v", rnd("v", 4))


@query("b18_resize_linear", "pix", """t AS (SELECT i, least(greatest((i+0.5::DOUBLE)*8/13-0.5, 0), 7) AS f FROM (SELECT unnest(range(13)) AS i)),
w AS (SELECT i AS t, CAST(floor(f) AS BIGINT) AS s, 1-(f-floor(f)) AS w FROM t UNION ALL SELECT i, CAST(floor(f) AS BIGINT)+1, f-floor(f) FROM t WHERE f > floor(f))
SELECT image_id, a.t AS y, b.t AS x, round(sum(v*a.w*b.w), 4) AS v FROM pix JOIN w a ON a.s = y JOIN w b ON b.s = x GROUP BY ALL""")
def _(s, d):
    return R.resize_linear(V.pix(s, d), 13).withColumn("v", rnd("v", 4))


@query("b19_pyramid", "pix", """l1 AS (SELECT image_id, y//2 AS y, x//2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM pix GROUP BY ALL), l2 AS (SELECT image_id, y//2 AS y, x//2 AS x, CAST(floor(avg(v)) AS BIGINT) AS v FROM l1 GROUP BY ALL)
SELECT image_id, y, x, v, 0 AS level FROM pix UNION ALL SELECT image_id, y, x, v, 1 FROM l1 UNION ALL SELECT image_id, y, x, v, 2 FROM l2""")
def _(s, d):
    return R.pyramid(V.pix(s, d), 3)


@query("b20_shift", "stack", """g AS (SELECT unnest(range(8)) AS i)
SELECT s.image_id, s.c, s.z, CASE WHEN s.c=1 THEN a.i ELSE s.y END AS y, CASE WHEN s.c=1 THEN b.i ELSE s.x END AS x, s.v FROM stack s JOIN g a ON (s.c<>1 AND a.i=s.y) OR (s.c=1 AND s.y=least(greatest(a.i-2,0),7)) JOIN g b ON (s.c<>1 AND b.i=s.x) OR (s.c=1 AND s.x=least(greatest(b.i+3,0),7))""")
def _(s, d):
    return R.shift(V.stack(s, d), 2, -3, R.SLICE, F.col("c") == 1)


@query("b21_best_shift", "stack", """ker(dy, dx, kx, ky) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)),
ed AS (SELECT a.image_id, a.c, a.z, a.y, a.x, sqrt(CAST(sum(kx*b.v)*sum(kx*b.v)+sum(ky*b.v)*sum(ky*b.v) AS DOUBLE)) AS m FROM stack a, ker JOIN stack b ON b.image_id=a.image_id AND b.c=a.c AND b.z=a.z AND b.y=least(greatest(a.y+dy,0),7) AND b.x=least(greatest(a.x+dx,0),7) GROUP BY 1,2,3,4,5),
sh AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2,3)) AS i) a, (SELECT unnest(range(-2,3)) AS i) b),
sc AS (SELECT m.image_id, m.c, m.z, dy, dx, round(corr(r.m, m.m), 9) AS score FROM ed r, sh JOIN ed m ON m.image_id=r.image_id AND m.c>0 AND m.z=r.z AND m.y+dy=r.y AND m.x+dx=r.x WHERE r.c=0 GROUP BY 1,2,3,4,5)
SELECT image_id, c, z, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, c, z ORDER BY score DESC, dy, dx) AS rn FROM sc) WHERE rn=1""")
def _(s, d):
    st = V.stack(s, d)  # every other channel against channel 0, in every slice
    ref = st.filter("c = 0").withColumn("c", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return R.best_shift(ref, st.filter("c > 0"), 2, R.SLICE)


@query("b22_rotate90", "pix", """SELECT image_id, 0 AS k, y, x, v FROM pix UNION ALL SELECT image_id, 1, 7-x, y, v FROM pix UNION ALL SELECT image_id, 2, 7-y, 7-x, v FROM pix UNION ALL SELECT image_id, 3, x, 7-y, v FROM pix""")
def _(s, d):
    return R.rotate90(V.pix(s, d))


@query("b23_invert", "pix", "SELECT image_id, y, x, CAST(65535-v AS BIGINT) AS v FROM pix")
def _(s, d):
    return R.invert(V.pix(s, d))


def otsu_sql(src: str, key: str, val: str = "v") -> str:
    """256-bin Otsu threshold per key as a chain of common table expressions ending in `ot`."""
    return f"""om AS (SELECT {key}, min({val})::DOUBLE AS lo, max({val})::DOUBLE AS hi FROM {src} GROUP BY 1),
ob AS (SELECT {key}, b, count(*) AS n, any_value(lo+(b+0.5::DOUBLE)*((hi-lo)/256)) AS m FROM (SELECT {key}, lo, hi, least(CAST(floor(({val}-lo)/((hi-lo)/256)) AS BIGINT), 255) AS b FROM {src} JOIN om USING ({key})) GROUP BY 1,2),
oc AS (SELECT *, sum(n) OVER w AS n1, sum(n*m) OVER w AS s1, sum(n) OVER t AS nt, sum(n*m) OVER t AS st FROM ob WINDOW w AS (PARTITION BY {key} ORDER BY b), t AS (PARTITION BY {key})),
ov AS (SELECT *, CASE WHEN nt>n1 THEN round(n1::DOUBLE/nt*((nt-n1)::DOUBLE/nt)*pow(s1/n1-(st-s1)/(nt-n1), 2), 4) ELSE -1 END AS bt FROM oc),
ot AS (SELECT {key}, b AS bin, m AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY bt DESC, b) AS rn FROM ov) WHERE rn=1)"""


@query("b24_otsu_threshold", "pix", otsu_sql("pix", "image_id") + " SELECT image_id, bin, round(threshold, 4) AS threshold FROM ot")
def _(s, d):
    return R.otsu_threshold(V.pix(s, d), ["image_id"]).withColumn("threshold", rnd("threshold", 4))


@query("b25_otsu_edge_map", "pix", """m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM pix GROUP BY 1),
g AS (SELECT image_id, y, x, CASE WHEN hi>lo THEN CAST(floor(255*(v-lo)/(hi-lo)) AS BIGINT) ELSE 0 END AS v FROM pix JOIN m USING (image_id)),
h AS (SELECT image_id, v AS b, count(*) AS n FROM g GROUP BY 1,2),
c AS (SELECT *, sum(n) OVER w AS n1, sum(n*b) OVER w AS s1, sum(n) OVER t AS nt, sum(n*b) OVER t AS st FROM h WINDOW w AS (PARTITION BY image_id ORDER BY b), t AS (PARTITION BY image_id)),
bt AS (SELECT *, CASE WHEN nt>n1 THEN round(n1::DOUBLE/nt*((nt-n1)::DOUBLE/nt)*pow(s1::DOUBLE/n1-(st-s1)::DOUBLE/(nt-n1), 2), 4) ELSE -1 END AS bt FROM c),
o AS (SELECT image_id, b AS t FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY bt DESC, b) AS rn FROM bt) WHERE rn=1)
SELECT image_id, y, x, CAST(v > t AS INT) AS edge FROM g JOIN o USING (image_id)""")
def _(s, d):
    return R.otsu_edge_map(V.pix(s, d))


def two_means_sql(src: str, keys: str, val: str) -> str:
    """Exact two-cluster split per key, ending in `tm`."""
    return f"""ta AS (SELECT {keys}, CAST({val} AS DOUBLE) AS u FROM {src} WHERE {val} IS NOT NULL), tb AS (SELECT {keys}, u, count(*) AS n FROM ta GROUP BY ALL),
tc AS (SELECT *, sum(n) OVER w AS n1, sum(n*u) OVER w AS s1, sum(n*u*u) OVER w AS q1, sum(n) OVER t AS nt, sum(n*u) OVER t AS st, sum(n*u*u) OVER t AS qt FROM tb WINDOW w AS (PARTITION BY {keys} ORDER BY u), t AS (PARTITION BY {keys})),
td AS (SELECT *, q1-s1*s1/n1 + (qt-q1)-(st-s1)*(st-s1)/(nt-n1) AS sse, s1/n1 AS low_mean, (st-s1)/(nt-n1) AS high_mean FROM tc WHERE n1 < nt),
tm AS (SELECT {keys}, u AS low_max, low_mean, high_mean, (low_mean+high_mean)/2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sse, u) AS rn FROM td) WHERE rn=1)"""


@query("b26_two_means_1d", "pix", two_means_sql("pix", "image_id", "v") + " SELECT image_id, low_max, round(low_mean, 4) AS low_mean, round(high_mean, 4) AS high_mean, round(cut, 4) AS cut FROM tm")
def _(s, d):
    t = R.two_means_1d(V.pix(s, d), ["image_id"], "v")
    return t.select("image_id", "low_max", *[rnd(c, 4).alias(c) for c in ("low_mean", "high_mean", "cut")])


FOCUS = "fo AS (SELECT image_id, c, z, CASE WHEN avg(v)>0 THEN var_pop(v)/avg(v) ELSE 0 END AS focus FROM stack GROUP BY 1,2,3), "


@query("b27_focused_slices", "stack", FOCUS + two_means_sql("fo", "image_id, c", "focus") + " SELECT image_id, c, z, round(focus, 6) AS focus, focus > low_max + 1e-9 AS focused FROM fo JOIN tm USING (image_id, c)")
def _(s, d):
    return R.focused_slices(V.stack(s, d)).withColumn("focus", rnd("focus", 6))


@query("b28_histogram", "pix", """m AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM pix), p AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM pix),
l AS (SELECT ln(least(greatest(v::DOUBLE, lo), hi)+1e-9) AS u FROM pix, p), lm AS (SELECT min(u) AS lo, max(u) AS hi FROM l)
SELECT 'plain' AS kind, least(CAST(floor((v-lo)/((hi-lo)/100)) AS BIGINT), 99) AS bin, count(*) AS n FROM pix, m GROUP BY 2
UNION ALL SELECT 'log_clipped', least(CAST(floor((u-lo)/((hi-lo)/50)) AS BIGINT), 49), count(*) FROM l, lm GROUP BY 2""")
def _(s, d):
    p = V.pix(s, d)
    a = R.histogram(p, "v", 100).withColumn("kind", F.lit("plain"))
    return a.unionByName(R.histogram(p, "v", 50, log=True, clip=True).withColumn("kind", F.lit("log_clipped")))


@query("b31_pad_to_multiple", "pix", """g AS (SELECT a.i AS y, b.i AS x FROM (SELECT unnest(range(9)) AS i) a, (SELECT unnest(range(9)) AS i) b), im AS (SELECT DISTINCT image_id FROM pix)
SELECT im.image_id, g.y, g.x, coalesce(v, 0) AS v FROM im CROSS JOIN g LEFT JOIN pix ON pix.image_id=im.image_id AND pix.y=g.y AND pix.x=g.x""")
def _(s, d):
    return R.pad_to_multiple(V.pix(s, d), 3)
