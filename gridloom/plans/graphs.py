"""Queries for components, graph algorithms and iterative operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.operators import components as C, filters as N, matching as M, messages as MS, profiles as P, regions as G, tiles as T
from gridloom.operators.labels import both_directions
from gridloom.plans import sqlkit as K
from gridloom.plans.evaluation import DIRECTED
from gridloom.plans.filters import sobel_sql
from gridloom.plans.rasters import otsu_sql
from gridloom.plans.regions import INNER, LAB, OV, sizes, slice_labels
from gridloom.plans.registry import query
from gridloom.sources import views as V


def mos(s, d):
    return V.mosaic(s, d)


def fg(s, d):
    return mos(s, d).filter("fg").select("image_id", "y", "x")


PID = "y*4294967296+x"


#: pixel ids over several images of less than 2^20 rows and columns, and the id inside the image
IMG_PID = "image_id*1099511627776+y*1048576+x"
IMG_COMP = "((comp//1048576)%1048576)*4294967296+comp%1048576"


def cc_sql(src: str, conn: int, name: str = "cc", pid: str = PID) -> str:
    """Component per pixel of `src`(image_id, y, x), named by its smallest pixel id; of one image unless `pid` tells images apart."""
    at = lambda e, img, y, x: e.replace("image_id", img).replace("*4294967296+x", f"*4294967296+{x}").replace("*1048576+x", f"*1048576+{x}").replace("+y*", f"+{y}*") if "image_id" in e else e.replace("+x", f"+{x}").replace("y*", f"{y}*", 1)
    near = "(VALUES (0,1),(1,0),(0,-1),(-1,0)" + (",(1,1),(1,-1),(-1,1),(-1,-1)" if conn == 8 else "") + ")"
    return f"""{name}_n AS MATERIALIZED (SELECT image_id, y, x, y+dy AS ny, x+dx AS nx FROM {src} CROSS JOIN {near} t(dy, dx)),
{name}_e AS MATERIALIZED (SELECT {at(pid, 'a.image_id', 'a.y', 'a.x')} AS src, {at(pid, 'a.image_id', 'a.ny', 'a.nx')} AS dst FROM {name}_n a JOIN {src} b ON b.image_id=a.image_id AND b.y=a.ny AND b.x=a.nx),
{name}(id, comp) USING KEY (id) AS (SELECT {pid}, {pid} FROM {src} UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.{name} u, {name} v, {name}_e e WHERE e.src=u.id AND e.dst=v.id AND v.comp<u.comp ORDER BY u.id, v.comp))"""


def outside_sql(name: str, src: str, col: str) -> str:
    """Background pixels reachable from the border."""
    return f"""{name}_b AS MATERIALIZED (SELECT y, x FROM {src} WHERE NOT {col}), {name}_d AS MATERIALIZED (SELECT max(y) AS h, max(x) AS w FROM {src}),
{name}(y, x) AS (SELECT y, x FROM {name}_b, {name}_d WHERE y=0 OR x=0 OR y=h OR x=w UNION SELECT b.y, b.x FROM (SELECT y+dy AS y, x+dx AS x FROM {name} CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0)) t(dy, dx)) r JOIN {name}_b b ON b.y=r.y AND b.x=r.x)"""


@query("c16_label_components", "mosaic", "fgp AS (SELECT image_id, y, x FROM mosaic WHERE fg), " + cc_sql("fgp", 4) + f" SELECT image_id, y, x, comp AS component FROM fgp JOIN cc ON id={PID}")
def _(s, d):
    return C.label_components(fg(s, d), 4, tile=64)


@query("c16_label_components_8", "mosaic", "fgp AS (SELECT image_id, y, x FROM mosaic WHERE fg), " + cc_sql("fgp", 8) + f" SELECT image_id, y, x, dense_rank() OVER (ORDER BY comp) AS label FROM fgp JOIN cc ON id={PID}")
def _(s, d):
    return C.number_components(C.label_components(fg(s, d), 8, tile=64))


@query("c17_fill_holes", "mosaic", outside_sql("os", "mosaic", "fg") + " SELECT image_id, m.y, m.x, os.y IS NULL AS fg FROM mosaic m LEFT JOIN os ON os.y=m.y AND os.x=m.x")
def _(s, d):
    return C.fill_holes(mos(s, d).select("image_id", "y", "x", "fg"), tile=64)


@query("b29_combine_masks", "mosaic", "mg AS (SELECT image_id, y, x, e, v>32000 AS g FROM mosaic), " + outside_sql("o1", "mg", "g") + """, cb AS (SELECT m.image_id, m.y, m.x, o1.y IS NULL AND e>-0.02 AS g FROM mg m LEFT JOIN o1 ON o1.y=m.y AND o1.x=m.x), """ + outside_sql("o2", "cb", "g") + " SELECT image_id, m.y, m.x, o2.y IS NULL AS fg FROM cb m LEFT JOIN o2 ON o2.y=m.y AND o2.x=m.x")
def _(s, d):
    return C.combine_masks(mos(s, d), "e", "v", -0.02, 32000)


@query("b30_hybrid_threshold", "mosaics", otsu_sql("mosaics", "image_id") + ", " + K.gauss("lm", "mosaics", 1.0, "reflect", out="m") + ", fgp AS (SELECT image_id, y, x FROM mosaics JOIN lm USING (image_id, y, x) JOIN ot USING (image_id) WHERE v>m AND v>0.95*threshold), " + cc_sql("fgp", 4, pid=IMG_PID) + f", lb AS (SELECT image_id, y, x, {IMG_COMP} AS component, count(*) OVER (PARTITION BY comp) AS n FROM fgp JOIN cc ON id={IMG_PID}) SELECT image_id, y, x, component FROM lb WHERE n>=6")
def _(s, d):
    return C.hybrid_threshold(V.mosaics(s, d).select("image_id", "y", "x", "v"), 0.95, 7, 6)


NMS = sobel_sql("mosaics") + ", " + K.window("nb", "so", 1, "zero", "any_value(a.magnitude) AS m, any_value(CASE WHEN degrees(atan2(a.gy, a.gx))<0 THEN degrees(atan2(a.gy, a.gx))+180 ELSE degrees(atan2(a.gy, a.gx)) END) AS a, " + ", ".join(f"coalesce(max(b.magnitude) FILTER (t.dy={dy} AND t.dx={dx}), 0) AS q{i}" for i, (dx, dy) in enumerate([(1, 0), (-1, 0), (1, -1), (-1, 1), (0, -1), (0, 1), (-1, -1), (1, 1)])), "magnitude") + """,
nm AS (SELECT image_id, y, x, CASE WHEN CASE WHEN a<22.5 OR a>=157.5 THEN m>=q0 AND m>=q1 WHEN a<67.5 THEN m>=q2 AND m>=q3 WHEN a<112.5 THEN m>=q4 AND m>=q5 ELSE m>=q6 AND m>=q7 END THEN m ELSE 0 END AS nms FROM nb),
nt AS (SELECT *, max(nms) OVER (PARTITION BY image_id) AS top FROM nm), n8 AS (SELECT image_id, y, x, nms, top, CAST(floor(nms/top*255) AS BIGINT) AS q FROM nt), """ + K.otsu8("ot", "n8", "q") + """, hy AS MATERIALIZED (SELECT image_id, y, x, nms>=t/255.0::DOUBLE*top AS strong FROM n8 JOIN ot USING (image_id) WHERE nms>=t/255.0::DOUBLE*top*0.5)"""


@query("c26_canny_link", "mosaics", NMS + ", " + cc_sql("hy", 8, pid=IMG_PID) + f", lb AS (SELECT image_id, y, x, {IMG_COMP} AS component, count(*) OVER w AS n, bool_or(strong) OVER w AS s FROM hy JOIN cc ON id={IMG_PID} WINDOW w AS (PARTITION BY comp)) SELECT image_id, y, x, component FROM lb WHERE n>=5 AND s")
def _(s, d):
    return C.canny_link(V.mosaics(s, d).select("image_id", "y", "x", "v"), 5)


@query("c21_seeded_watershed", "mosaic", """px AS MATERIALIZED (SELECT y*4294967296+x AS id, y, x, 70000-v AS h FROM mosaic WHERE e>-0.02), sd AS (SELECT id, (y//16)*100+x//16+1 AS seed, h FROM px WHERE y%16=8 AND x%16=8),
ws_n AS MATERIALIZED (SELECT id, (y+dy)*4294967296+x+dx AS nid FROM px CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0)) t(dy, dx)), ws_e AS MATERIALIZED (SELECT n.id AS src, p.id AS dst, p.h FROM ws_n n JOIN px p ON p.id=n.nid),
wc(id, cost) USING KEY (id) AS (SELECT id, h FROM sd UNION (SELECT DISTINCT ON (e.dst) e.dst, greatest(v.cost, e.h) AS c FROM wc v JOIN ws_e e ON e.src=v.id LEFT JOIN recurring.wc u ON u.id=e.dst WHERE u.id IS NULL OR greatest(v.cost, e.h)<u.cost ORDER BY e.dst, c)),
fe AS MATERIALIZED (SELECT e.src, e.dst FROM ws_e e JOIN wc a ON a.id=e.src JOIN wc b ON b.id=e.dst WHERE greatest(a.cost, e.h)=b.cost AND e.dst NOT IN (SELECT id FROM sd)),
ws(id, seed) USING KEY (id) AS (SELECT id, seed FROM sd UNION (SELECT DISTINCT ON (e.dst) e.dst, v.seed FROM ws v JOIN fe e ON e.src=v.id LEFT JOIN recurring.ws u ON u.id=e.dst WHERE u.id IS NULL OR v.seed<u.seed ORDER BY e.dst, v.seed))
SELECT CAST(0 AS BIGINT) AS image_id, y, x, seed FROM ws JOIN px USING (id)""")
def _(s, d):
    m = mos(s, d).filter("e > -0.02").select("image_id", "y", "x", (70000 - F.col("v")).alias("height"))
    seeds = m.filter("y % 16 = 8 AND x % 16 = 8").withColumn("seed", F.expr("(y div 16)*100 + x div 16 + 1"))
    return T.seeded_watershed(m, seeds, tile=64)


@query("c30_thin")
def _(s, d):
    return T.thin(mos(s, d).filter("e > 0").select("image_id", "y", "x"), tile=64)


@query("c31_skeleton_degree", "mosaic", """fgp AS (SELECT image_id, y, x FROM mosaic WHERE fg), nn AS MATERIALIZED (SELECT image_id, y, x, y+dy AS ny, x+dx AS nx FROM fgp CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,1),(-1,-1)) t(dy, dx)),
dg AS (SELECT n.image_id, n.y, n.x, count(f.y) AS degree FROM nn n LEFT JOIN fgp f ON f.image_id=n.image_id AND f.y=n.ny AND f.x=n.nx GROUP BY 1,2,3)
SELECT image_id, y, x, degree, CASE WHEN degree=1 THEN 'endpoint' WHEN degree>=3 THEN 'branch' WHEN degree=0 THEN 'isolated' ELSE 'path' END AS kind FROM dg""")
def _(s, d):
    return N.skeleton_degree(fg(s, d))


DEG = """fgp AS (SELECT image_id, y, x FROM mosaic WHERE fg), nn AS MATERIALIZED (SELECT image_id, y, x, dy, dx, y+dy AS ny, x+dx AS nx FROM fgp CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,1),(-1,-1)) t(dy, dx)),
ep AS (SELECT n.image_id, n.y, n.x, min(n.dy) AS dy, min(n.dx) AS dx FROM nn n JOIN fgp f ON f.image_id=n.image_id AND f.y=n.ny AND f.x=n.nx GROUP BY 1,2,3 HAVING count(*)=1)"""


@query("c32_extend_endpoints", "mosaic", DEG + """, dm AS (SELECT max(y) AS h, max(x) AS w FROM mosaic), sp AS (SELECT ep.image_id, ep.y AS ey, ep.x AS ex, k, ep.y-k*dy AS y, ep.x-k*dx AS x FROM ep, (SELECT unnest(range(1,5)) AS k)),
bl AS (SELECT sp.*, sp.y<0 OR sp.x<0 OR sp.y>h OR sp.x>w OR f.y IS NOT NULL AS stop FROM sp CROSS JOIN dm LEFT JOIN fgp f ON f.y=sp.y AND f.x=sp.x), ex AS (SELECT *, min(k) FILTER (stop) OVER (PARTITION BY ey, ex) AS s FROM bl),
al AS (SELECT image_id, y, x FROM fgp UNION SELECT image_id, y, x FROM ex WHERE k<coalesce(s, 5)) SELECT al.image_id, al.y, al.x FROM al JOIN mosaic m ON m.y=al.y AND m.x=al.x WHERE m.e>-0.05""")
def _(s, d):
    m = mos(s, d)
    return N.extend_endpoints(fg(s, d), m.filter("e > -0.05").select("image_id", "y", "x"), 4, N.image_sizes(m))


def tile_label():
    return F.expr("(y div 8)*20 + x div 8 + 1").alias("label")


@query("j2_find_tip", "mosaic", DEG + """, lb AS (SELECT image_id, (y//8)*20+x//8+1 AS label, y, x, v FROM mosaic WHERE e>0), th AS (SELECT label, quantile_cont(v, 0.75) AS t FROM lb GROUP BY 1), ce AS (SELECT label, avg(y) AS cy, avg(x) AS cx FROM lb JOIN th USING (label) WHERE v>t GROUP BY 1),
en AS (SELECT lb.image_id, lb.label, lb.y, lb.x, count(*) OVER (PARTITION BY lb.label) AS n, sqrt(pow(lb.y-cy, 2)+pow(lb.x-cx, 2)) AS dist FROM ep JOIN lb ON lb.y=ep.y AND lb.x=ep.x JOIN ce USING (label))
SELECT image_id, label, y, x, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9) DESC, y, x) AS rn FROM en WHERE n>=2) WHERE rn=1""")
def _(s, d):
    lab = mos(s, d).filter("e > 0").select("image_id", tile_label(), "y", "x")
    ends = N.skeleton_degree(fg(s, d)).filter("kind = 'endpoint'").join(lab, ["image_id", "y", "x"])
    from gridloom.plans.pipelines import find_tip

    return find_tip(ends, P.bright_centroid(lab, mos(s, d))).withColumn("dist", rnd("dist"))


@query("g11_geodesic_distance", "mosaic", """px AS MATERIALIZED (SELECT y*4294967296+x AS id, y, x FROM mosaic WHERE fg), sr AS (SELECT id FROM px WHERE y%16=3 AND x%16<8),
gd_n AS MATERIALIZED (SELECT id, (y+dy)*4294967296+x+dx AS nid, sqrt(dy*dy+dx*dx) AS w FROM px CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,1),(-1,-1)) t(dy, dx)), gd_e AS MATERIALIZED (SELECT n.id AS src, p.id AS dst, w FROM gd_n n JOIN px p ON p.id=n.nid),
gd(id, dist) USING KEY (id) AS (SELECT id, 0.0::DOUBLE FROM sr UNION (SELECT DISTINCT ON (e.dst) e.dst, v.dist+e.w AS c FROM gd v JOIN gd_e e ON e.src=v.id LEFT JOIN recurring.gd u ON u.id=e.dst WHERE u.id IS NULL OR v.dist+e.w<u.dist-1e-9 ORDER BY e.dst, c))
SELECT CAST(0 AS BIGINT) AS image_id, y, x, round(coalesce(dist, 0)*0.5, 6) AS dist FROM px LEFT JOIN gd USING (id)""")
def _(s, d):
    m = fg(s, d)
    return T.geodesic_distance(m, m.filter("y % 16 = 3 AND x % 16 < 8"), 0.5, tile=64).withColumn("dist", rnd("dist"))


@query("d16_stitch_slices", "stack", LAB + """, ol AS (SELECT image_id, c, z, label, y, x FROM lb WHERE label>0), sz AS (SELECT image_id, c, z, label, count(*) AS n FROM ol GROUP BY 1,2,3,4),
it AS (SELECT a.image_id, a.c, a.z, a.label, b.label AS prev, count(*) AS i FROM ol a JOIN ol b ON b.image_id=a.image_id AND b.c=a.c AND b.z=a.z-1 AND b.y=a.y AND b.x=a.x GROUP BY 1,2,3,4,5),
iu AS (SELECT it.*, i::DOUBLE/(p.n+q.n-i) AS iou FROM it JOIN sz p ON p.image_id=it.image_id AND p.c=it.c AND p.z=it.z AND p.label=it.label JOIN sz q ON q.image_id=it.image_id AND q.c=it.c AND q.z=it.z-1 AND q.label=it.prev),
lk AS (SELECT image_id, c, z, label, prev FROM (SELECT *, row_number() OVER (PARTITION BY image_id, c, z, label ORDER BY iou DESC, prev) AS rn FROM iu WHERE iou>=0.4) WHERE rn=1),
nd AS MATERIALIZED (SELECT image_id*1000+c AS g, z, label, image_id, c, z*4294967296+label AS node FROM sz), le AS MATERIALIZED (SELECT image_id*1000+c AS g, z*4294967296+label AS a, (z-1)*4294967296+prev AS b FROM lk), ld AS MATERIALIZED (SELECT g, a, b FROM le UNION ALL SELECT g, b, a FROM le),
cc(g, id, comp) USING KEY (g, id) AS (SELECT g, node, node FROM nd UNION (SELECT DISTINCT ON (u.g, u.id) u.g, u.id, v.comp FROM recurring.cc u, cc v, ld e WHERE e.g=u.g AND v.g=u.g AND e.a=u.id AND e.b=v.id AND v.comp<u.comp ORDER BY u.g, u.id, v.comp))
SELECT image_id, c, z, label, comp AS object_id FROM nd JOIN cc ON cc.g=nd.g AND cc.id=nd.node""")
def _(s, d):
    return C.stitch_slices(slice_labels(s, d).filter("label > 0"), 0.4)


# ---- graphs of the positive pairs ------------------------------------------------------------

CCG = """pe AS MATERIALIZED (SELECT graph_id, src, dst FROM pairs WHERE true_label=1), pd AS MATERIALIZED (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe),
cc(id, comp) USING KEY (id) AS (SELECT node, node FROM nodes UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc u, cc v, pd e WHERE e.a=u.id AND e.b=v.id AND v.comp<u.comp ORDER BY u.id, v.comp)),
ce AS (SELECT graph_id, node, dense_rank() OVER (PARTITION BY graph_id ORDER BY comp) AS cell FROM nodes JOIN cc ON id=node)"""
TOPO = CCG + """, dg AS (SELECT a AS node, count(*) AS degree FROM pd GROUP BY 1), tp AS (SELECT graph_id, cell, n_nodes, n_edges, max_degree, CASE WHEN n_nodes=1 THEN 'singleton' WHEN n_edges<>n_nodes-1 THEN 'cyclic' WHEN max_degree<=2 THEN 'path' ELSE 'branched' END AS topology
FROM (SELECT graph_id, cell, count(*) AS n_nodes, CAST(coalesce(sum(degree), 0)//2 AS BIGINT) AS n_edges, coalesce(max(degree), 0) AS max_degree FROM ce LEFT JOIN dg USING (node) GROUP BY 1,2))"""


def positives(s, d):
    return V.pairs(s, d).filter("true_label = 1").select("graph_id", "src", "dst")


def cells(s, d):
    from gridloom.functions.rounds import materialize

    e, _ = materialize(positives(s, d))
    n = V.nodes(s, d).select("graph_id", "node")
    c, _ = materialize(C.graph_components(n, e))
    return c, e


@query("g1_connected_components", "pairs", CCG + " SELECT graph_id, node, cell FROM ce")
def _(s, d):
    return cells(s, d)[0]


@query("g2_topology", "pairs", TOPO + " SELECT graph_id, cell, n_nodes, n_edges, max_degree, topology FROM tp")
def _(s, d):
    return C.topology(*cells(s, d))


CHAIN = TOPO + """, tr AS (SELECT graph_id, cell, topology FROM tp WHERE topology IN ('path', 'branched')), tn AS MATERIALIZED (SELECT ce.graph_id, cell, node, topology, degree FROM ce JOIN tr USING (graph_id, cell) JOIN dg USING (node)),
wk(cell, start, node, via, d) AS (SELECT graph_id*1000+cell, node, node, CAST(-1 AS BIGINT), 0 FROM tn UNION ALL SELECT wk.cell, start, e.b, wk.node, d+1 FROM wk JOIN pd e ON e.a=wk.node WHERE e.b<>via),
ws AS MATERIALIZED (SELECT * FROM wk), s0 AS (SELECT graph_id*1000+cell AS cell, topology, CASE WHEN any_value(topology)='path' THEN min(node) FILTER (degree=1) ELSE min(node) END AS s FROM tn GROUP BY 1,2),
sa AS (SELECT s0.cell, CASE WHEN any_value(topology)='path' THEN any_value(s) ELSE arg_max(node, (d, -node)) END AS a FROM s0 JOIN ws ON ws.cell=s0.cell AND ws.start=s GROUP BY 1),
sb AS (SELECT sa.cell, any_value(a) AS a, arg_max(node, (d, -node)) AS b, max(d) AS len FROM sa JOIN ws ON ws.cell=sa.cell AND ws.start=a GROUP BY 1),
ord AS (SELECT sb.cell, p.d AS pos, p.node FROM sb JOIN ws p ON p.cell=sb.cell AND p.start=a JOIN ws q ON q.cell=sb.cell AND q.start=b AND q.node=p.node WHERE p.d+q.d=len)
SELECT cell//1000 AS graph_id, cell%1000 AS cell, pos, node FROM ord UNION ALL SELECT graph_id, cell, 0, node FROM ce JOIN tp USING (graph_id, cell) WHERE topology='singleton'"""


@query("g3_chain_order", "pairs", CHAIN)
def _(s, d):
    return C.chain_order(*cells(s, d))


@query("g3_chain_order_swept", "pairs", CHAIN)
def _(s, d):
    return C.chain_order(*cells(s, d))


@query("g4_relabel", "frags", "SELECT image_id, y, x, (label-1)//3+1 AS label FROM frags")
def _(s, d):
    f = V.frags(s, d)
    lut = f.select("image_id", "label").distinct().withColumn("cell", F.expr("(label-1) div 3 + 1"))
    return C.relabel(f, lut)


@query("g5_summarize_cells", "pairs", TOPO + """ SELECT graph_id, count(*) || ' cells: ' || concat_ws(', ', """ + ", ".join(f"CASE WHEN count(*) FILTER (topology='{k}')>0 THEN count(*) FILTER (topology='{k}') || ' {k}' END" for k in C.KINDS) + ") AS summary FROM tp GROUP BY 1")
def _(s, d):
    return C.summarize_cells(C.topology(*cells(s, d)))


ASYM = "ds AS (SELECT graph_id, src, dst, prob*0.8 AS p FROM pairs UNION ALL SELECT graph_id, dst, src, prob*1.9 FROM pairs UNION ALL SELECT graph_id, node, node, 0.25::DOUBLE FROM nodes WHERE node%50=0)"


def asymmetric(s, d):
    p = V.pairs(s, d)
    loops = V.nodes(s, d).filter("node % 50 = 0").select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.25).alias("p"))
    return p.select("graph_id", "src", "dst", (F.col("prob") * 0.8).alias("p")).unionByName(p.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("prob") * 1.9).alias("p"))).unionByName(loops)


@query("g6_symmetrize_mean", "pairs", ASYM + " SELECT graph_id, src, dst, round(avg(p) OVER (PARTITION BY graph_id, least(src,dst), greatest(src,dst)), 8) AS p FROM ds")
def _(s, d):
    return MS.symmetrize(asymmetric(s, d), "p").select("graph_id", "src", "dst", rnd("p", 8).alias("p"))


@query("g6_symmetrize_max", "pairs", ASYM + " SELECT graph_id, src, dst, round(CASE WHEN src=dst THEN p ELSE least(greatest(max(p) OVER (PARTITION BY graph_id, least(src,dst), greatest(src,dst)), 0), 1) END, 8) AS p FROM ds")
def _(s, d):
    return MS.symmetrize(asymmetric(s, d), "p", "max").select("graph_id", "src", "dst", rnd("p", 8).alias("p"))


@query("g8_greedy_chains")
def _(s, d):
    e = V.pairs(s, d).select("graph_id", "src", "dst", F.col("prob").alias("score"))
    pts = V.nodes(s, d).select("graph_id", "node", F.expr("cast((node % 100) div 10 as double)").alias("y"), (F.col("node") % 10).cast("double").alias("x"))
    return C.greedy_chains(e, pts, 0.5, 90.0)


# an edge is in the minimum forest if cheaper edges (ties by number) don't connect its ends
MERGE = """as0 AS (SELECT DISTINCT image_id, gt, frag AS label FROM bo WHERE gt IS NOT NULL AND n>=0.1*area), ie AS (SELECT a.image_id, a.gt, a.label AS i, b.label AS j FROM as0 a JOIN as0 b ON a.image_id=b.image_id AND a.gt=b.gt AND a.label<b.label),
md AS (SELECT ie.image_id, gt, i, j, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS d2 FROM ie JOIN ib a ON a.image_id=ie.image_id AND a.label=i JOIN ib b ON b.image_id=ie.image_id AND b.label=j GROUP BY 1,2,3,4),
mr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, gt ORDER BY d2, i, j) AS r FROM md), mb AS MATERIALIZED (SELECT image_id, gt, r, i AS a, j AS b FROM mr UNION ALL SELECT image_id, gt, r, j, i FROM mr),
mw(image_id, gt, r, node) AS (SELECT image_id, gt, r, i FROM mr UNION SELECT mw.image_id, mw.gt, mw.r, e.b FROM mw JOIN mb e ON e.image_id=mw.image_id AND e.gt=mw.gt AND e.r<mw.r AND e.a=mw.node)
SELECT image_id, gt, i, j, round(sqrt(d2), 6)+0.0 AS dist FROM mr ANTI JOIN mw ON mw.image_id=mr.image_id AND mw.gt=mr.gt AND mw.r=mr.r AND mw.node=mr.j"""


@query("e8_merge_edges", "frags region", OV + ", " + INNER + ", " + MERGE)
def _(s, d):
    f = V.frags(s, d)
    return C.merge_edges(f, G.inner_boundary(f, sizes(s, d)), M.assign_to_gt(V.region(s, d), 0.1)).select("image_id", "gt", "i", "j", rnd("dist").alias("dist"))


# ---- message passing ------------------------------------------------------------------------

EX = "nx AS (SELECT graph_id, node, generate_subscripts(vec, 1)-1 AS dim, unnest(vec) AS u FROM nodes)"


def dims(df):
    return df.select("node", "dim", rnd("u").alias("u"))


@query("g12_gcn_aggregate", "pairs", DIRECTED + ", " + EX + """, lp AS (SELECT src, dst FROM dir UNION ALL SELECT node, node FROM nodes), dg AS (SELECT dst, count(*) AS d FROM lp GROUP BY 1)
SELECT lp.dst AS node, dim, round(sum(u/sqrt(a.d*b.d)), 6)+0.0 AS u FROM lp JOIN dg a ON a.dst=lp.src JOIN dg b ON b.dst=lp.dst JOIN nx ON nx.node=lp.src GROUP BY 1,2""")
def _(s, d):
    return dims(MS.gcn_aggregate(V.nodes(s, d), both_directions(V.pairs(s, d))))


@query("g13_attention_aggregate", "pairs", DIRECTED + ", " + EX + """, sm AS (SELECT src, dst, prob, exp(3*prob)/sum(exp(3*prob)) OVER (PARTITION BY dst) AS al FROM dir)
SELECT sm.dst AS node, a.dim, round(sum(al*(a.u-b.u)), 6)+0.0 AS u FROM sm JOIN nx a ON a.node=sm.src JOIN nx b ON b.node=sm.dst AND b.dim=a.dim GROUP BY 1,2 UNION ALL SELECT dst, 64, round(sum(al*prob), 6)+0.0 FROM sm GROUP BY 1""")
def _(s, d):
    e = both_directions(V.pairs(s, d)).withColumn("score", F.col("prob") * 3)
    return dims(MS.attention_aggregate(V.nodes(s, d), e, "score", "prob"))


@query("g14_edgeconv_max", "pairs", DIRECTED + ", " + EX + " SELECT e.dst AS node, a.dim, round(max(greatest(b.u+2*(a.u-b.u), 0)), 6)+0.0 AS u FROM dir e JOIN nx a ON a.node=e.src JOIN nx b ON b.node=e.dst AND b.dim=a.dim GROUP BY 1,2")
def _(s, d):
    return dims(MS.edgeconv_max(V.nodes(s, d), both_directions(V.pairs(s, d))))


@query("g15_neighbour_mean", "bip", "it AS (SELECT p_partkey AS item_id, unnest([0,1,2]) AS dim, unnest([p_size*1.0::DOUBLE, p_retailprice/100, p_partkey%7*1.0::DOUBLE]) AS u FROM part) SELECT user_id, CAST(dim AS INT) AS dim, round(avg(u)+1e-9, 6) AS u FROM bip JOIN it USING (item_id) GROUP BY 1,2")
def _(s, d):
    it = V.table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 7).cast("double")).alias("vec"))
    return MS.neighbour_mean(it, V.bip(s, d)).withColumn("u", rnd(F.col("u") + 1e-9))


@query("g15_link_dot", "pairs", "SELECT src, dst, round(list_dot_product(a.vec, b.vec), 6)+0.0 AS score FROM pairs JOIN nodes a ON a.node=src JOIN nodes b ON b.node=dst")
def _(s, d):
    return MS.link_dot(V.pairs(s, d), V.nodes(s, d)).select("src", "dst", rnd("score").alias("score"))


@query("g16_graph_norm", "nodes", EX + ", st AS (SELECT graph_id, dim, avg(u) AS m FROM nx GROUP BY 1,2), ce AS (SELECT graph_id, node, dim, u-0.7::DOUBLE*m AS q FROM nx JOIN st USING (graph_id, dim)) SELECT node, dim, round(q/sqrt(avg(q*q) OVER (PARTITION BY graph_id, dim)+1e-5), 6)+0.0 AS u FROM ce")
def _(s, d):
    return dims(MS.graph_norm(V.nodes(s, d), 0.7))


@query("g17_direction_mask", "pairs", DIRECTED + " SELECT d.src, d.dst, round(prob/(1+exp(-(b.vec[1]-a.vec[1])/0.1::DOUBLE)), 8) AS masked FROM dir d JOIN nodes a ON a.node=d.src JOIN nodes b ON b.node=d.dst")
def _(s, d):
    phi = V.nodes(s, d).select("node", F.col("vec")[0].alias("phi"))
    return MS.direction_mask(both_directions(V.pairs(s, d)), phi, 0.1).select("src", "dst", rnd("masked", 8).alias("masked"))


