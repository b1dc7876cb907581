"""Queries for fitted models, pipelines and the streaming operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.operators import components as C, learning as ML
from gridloom.plans.evaluation import STOP
from gridloom.plans.graphs import CHAIN
from gridloom.plans.pipelines import build_graph, extract_profiles, merge_fragments
from gridloom.plans.rasters import scratch
from gridloom.plans.registry import query
from gridloom.plans.regions import px, rules
from gridloom.sources import views as V
from gridloom.streaming import early_stop as ES


@query("c34_rf_pixels")
def _(s, d):
    f = ML.pixel_features(V.pix(s, d)).withColumn("label", (F.col("v") > 33000).cast("double"))
    r = ML.rf_pixels(f, f, "label", 10)
    return r.select("image_id", "y", "x", "cls", rnd(F.col("probability")[1]).alias("p1"))


@query("c35_gmm_1d")
def _(s, d):
    from gridloom.operators.filters import sobel

    g = ML.gmm_1d(sobel(V.pix(s, d)), F.log(F.col("magnitude") + 1e-9), 2)
    return g.select("image_id", "y", "x", rnd("p0").alias("p0"), rnd("p1").alias("p1"))


@query("i23_pca")
def _(s, d):
    n = V.nodes(s, d).select("graph_id", "node", "vec")
    p = ML.pca(n, n)
    return p.select("graph_id", "node", *[rnd(c).alias(c) for c in ("pc1", "pc2", "explained1", "explained2")])


@query("i24_plsda")
def _(s, d):
    n = V.nodes(s, d).select("graph_id", "node", "label", "vec")
    p = ML.plsda(n, F.col("label") == 1)
    return p.select("graph_id", "node", *[rnd(c).alias(c) for c in ("lv1", "lv2", "r2x1", "r2x2")])


def scored_edges(s, d):
    from gridloom.functions.rounds import materialize

    fold = (F.col("graph_id") % 3).cast("int").alias("fold")
    pairs, _ = materialize(V.pairs(s, d).select("*", fold))
    return ML.edge_classifier(pairs, V.nodes(s, d).select("graph_id", "node", "vec", fold), [0, 1, 2])


@query("i25_edge_classifier")
def _(s, d):
    return scored_edges(s, d).withColumn("score", rnd("score"))


@query("i25_fold_metrics")
def _(s, d):
    m = ML.fold_metrics(scored_edges(s, d))
    return m.select("fold", "n", *[rnd(c).alias(c) for c in ("auc", "mean", "std", "bce")])


def gt_pixels(s, d):
    return V.region(s, d).select("image_id", "y", "x", "frag", "gt")


@query("e15_build_graph")
def _(s, d):
    nodes, edges = build_graph(V.frags(s, d), px(s, d), gt_pixels(s, d), rules(s, d), k=3)
    t = nodes.select("image_id", "label", "node_type")
    return edges.join(t.withColumnsRenamed({"label": "src", "node_type": "src_type"}), ["image_id", "src"])


#: mean score from which an edge is followed
SCORED = 0.85
MERGED = CHAIN[: CHAIN.rindex("SELECT cell//1000 AS graph_id")].replace("FROM pairs WHERE true_label=1", f"FROM pairs WHERE (prob*0.8+prob*1.9)/2>={SCORED!r}") + """, od AS (SELECT cell//1000 AS graph_id, cell%1000 AS cell, pos, node FROM ord UNION ALL SELECT graph_id, cell, 0, node FROM ce JOIN tp USING (graph_id, cell) WHERE topology='singleton'
UNION ALL SELECT graph_id, cell, row_number() OVER (PARTITION BY graph_id, cell ORDER BY node)-1, node FROM ce JOIN tp USING (graph_id, cell) WHERE topology='cyclic'),
mg AS (SELECT ce.graph_id, ce.cell, topology, n_nodes, CAST(pos AS INT) AS pos, node, node%100+1 AS label FROM ce JOIN tp USING (graph_id, cell) LEFT JOIN od USING (graph_id, cell, node))"""


def merged(s, d):
    p = V.pairs(s, d)
    both = p.select("graph_id", "src", "dst", (F.col("prob") * 0.8).alias("prob")).unionByName(p.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("prob") * 1.9).alias("prob")))
    nodes = V.nodes(s, d).select("graph_id", "node", (F.col("node") % 100 + 1).alias("label"))
    return merge_fragments(nodes, both, V.frags(s, d), SCORED)


@query("g3_merge_record", "pairs", MERGED + " SELECT * FROM mg")
def _(s, d):
    return merged(s, d)[0]


@query("g4_merge_labels", "frags pairs", MERGED + " SELECT image_id, y, x, cell AS label FROM frags JOIN mg ON mg.graph_id=image_id AND mg.label=frags.label")
def _(s, d):
    return merged(s, d)[1]


@query("g6_merge_edges", "pairs", MERGED + ", me AS (SELECT graph_id, src, dst, (prob*0.8+prob*1.9)/2 AS prob FROM pairs) SELECT me.graph_id, a AS src, b AS dst, round(prob, 8) AS prob, cell FROM (SELECT graph_id, src AS a, dst AS b, prob FROM me UNION ALL SELECT graph_id, dst, src, prob FROM me) me JOIN ce ON node=a WHERE prob>=" + repr(SCORED))
def _(s, d):
    return merged(s, d)[2].select("graph_id", "src", "dst", rnd("prob", 8).alias("prob"), "cell")


@query("j4_extract_profiles")
def _(s, d):
    m = V.mosaic(s, d)
    comp = C.label_components(m.filter("fg").select("image_id", "y", "x"), 8)
    from gridloom.operators.filters import remove_small

    lab = remove_small(comp.withColumnRenamed("component", "label"), 12)
    signal = m.select("image_id", "y", "x", "v")
    nuclei = m.select("image_id", "y", "x", (F.col("v") % 1000).alias("v"))
    p = extract_profiles(lab, signal, nuclei, 0.5, 1.0)
    return p.select("image_id", "label", "channel", "distance", rnd("intensity").alias("intensity"))


@query("l1_early_stop_stream", "runs", STOP + " SELECT repeat, fold, best_epoch, stop_epoch, round(best_value, 8) AS best_value FROM best")
def _(s, d):
    src = scratch(s)
    V.runs(s, d).select("repeat", "fold", "epoch", "auc").repartitionByRange(6, "epoch").write.parquet(src)
    r = ES.run_available(s, src, scratch(s), 60, 10)
    return r.withColumn("best_value", rnd("best_value", 8))
