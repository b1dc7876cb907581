"""Queries for splits, samples, encodings, metrics and cross-validation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.columns import rnd
from gridloom.functions.rounds import materialize
from gridloom.operators import metrics as M, sampling as S
from gridloom.plans.registry import query
from gridloom.sources import views as V

PAIR_ID = "CAST(src AS VARCHAR) || '-' || CAST(dst AS VARCHAR)"
LINK_ID = "CAST(user_id AS VARCHAR) || '-' || CAST(item_id AS VARCHAR)"


def pair_id():
    return F.concat_ws("-", "src", "dst")


def link_id():
    return F.concat_ws("-", "user_id", "item_id")


# ---- sampling -----------------------------------------------------------------------------


@query("h1_zscore_nodes", "nodes", """ex AS (SELECT graph_id, node, generate_subscripts(vec, 1)-1 AS dim, unnest(vec) AS u FROM nodes), st AS (SELECT dim, avg(u) AS m, stddev_samp(u) AS sd FROM ex WHERE graph_id <> 0 GROUP BY 1)
SELECT node, dim, round((u-m)/(sd+1e-7), 6)+0.0 AS z FROM ex JOIN st USING (dim)""")
def _(s, d):
    n = V.nodes(s, d)
    z = S.vector_zscore(n.filter("graph_id <> 0"), n)
    return z.select("node", F.posexplode("vec").alias("dim", "z")).withColumn("z", rnd("z"))


@query("h1_zscore_edges", "pairs", "st AS (SELECT avg(prob) AS m, stddev_samp(prob) AS sd FROM pairs WHERE graph_id <> 0) SELECT src, dst, round((prob-m)/(sd+1e-7), 6)+0.0 AS z FROM pairs, st")
def _(s, d):
    p = V.pairs(s, d)
    return S.column_zscore(p.filter("graph_id <> 0"), p, "prob").select("src", "dst", rnd("prob").alias("z"))


@query("h2_k_fold", "nodes", "SELECT node, CAST((row_number() OVER (ORDER BY md5(CAST(node AS VARCHAR) || '-7'))-1) % 5 AS INT) AS fold FROM nodes")
def _(s, d):
    return S.k_fold(V.nodes(s, d).select("node"), "node", 5, 7)


NEG = f"""r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, true_label ORDER BY md5({PAIR_ID} || '-3')) AS rk FROM pairs),
t AS (SELECT graph_id, sum(true_label) AS p, sum(1-true_label) AS n FROM pairs GROUP BY 1),
smp AS (SELECT r.* FROM r JOIN t USING (graph_id) WHERE floor(p*1.5) <= 0 OR n = 0 OR true_label = 1 OR rk <= floor(p*1.5))"""


@query("h3_sample_negatives", "pairs", NEG + " SELECT graph_id, src, dst, true_label, prob FROM smp")
def _(s, d):
    return S.sample_negatives(V.pairs(s, d), ["graph_id"], pair_id(), 1.5, 3).select("graph_id", "src", "dst", "true_label", "prob")


@query("h4_balanced_sample", "nodes", """c AS (SELECT node_type, count(*) AS n FROM nodes GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY md5(CAST(node AS VARCHAR) || '-11')) AS rk FROM nodes)
SELECT node, node_type FROM r WHERE rk <= (SELECT greatest(floor(min(n)*0.8), 1) FROM c)""")
def _(s, d):
    return S.balanced_sample(V.nodes(s, d).select("node", "node_type"), "node_type", "node", 0.8, 11).select("node", "node_type")


@query("h5_sample_per_class", "pairs", f"SELECT true_label, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5({PAIR_ID} || '-0')) AS rk FROM pairs) WHERE rk <= 15")
def _(s, d):
    return S.sample_per_class(V.pairs(s, d), "true_label", pair_id(), 15, 0).select("true_label", "src", "dst").orderBy("src", "dst")


@query("h6_smooth_labels", "pairs", "SELECT src, dst, round(true_label*(1-0.1::DOUBLE)+(1-true_label)*0.1::DOUBLE, 6) AS y FROM pairs")
def _(s, d):
    return S.smooth_labels(V.pairs(s, d), "true_label", 0.1).select("src", "dst", rnd("true_label").alias("y"))


@query("h7_link_split", "bip", f"""r AS (SELECT user_id, item_id, row_number() OVER (ORDER BY md5({LINK_ID} || '-5')) AS rk, count(*) OVER () AS n FROM bip),
k AS (SELECT *, CAST(floor(n*0.1::DOUBLE) AS BIGINT) AS nt, CAST(floor(n*0.1::DOUBLE) AS BIGINT) AS nv FROM r)
SELECT user_id, item_id, CASE WHEN rk<=nt THEN 'test' WHEN rk<=nt+nv THEN 'val' WHEN rk<=nt+nv+floor((n-nt-nv)*0.3::DOUBLE) THEN 'supervision' ELSE 'message' END AS split FROM k""")
def _(s, d):
    return S.link_split(V.bip(s, d), link_id(), 0.1, 0.1, 0.3, 5).select("user_id", "item_id", "split")


@query("h8_negative_links")
def _(s, d):
    return S.negative_links(V.bip(s, d), 1.0, 9)


@query("h9_sample_neighbours", "bip", f"""h1 AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5({LINK_ID} || '-2')) AS rk FROM bip) WHERE rk <= 20),
h2 AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5({LINK_ID} || '-2')) AS rk FROM bip WHERE item_id IN (SELECT item_id FROM h1)) WHERE rk <= 10)
SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2""")
def _(s, d):
    b = V.bip(s, d)
    return S.sample_neighbours(b, b, (20, 10), 2)


@query("h10_index_ids", "bip", "u AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id)-1 AS u FROM (SELECT DISTINCT user_id FROM bip)), i AS (SELECT item_id, dense_rank() OVER (ORDER BY item_id)-1 AS i FROM (SELECT DISTINCT item_id FROM bip)) SELECT u, i, rating FROM bip JOIN u USING (user_id) JOIN i USING (item_id)")
def _(s, d):
    b = V.bip(s, d)
    u = S.index_ids(b, "user_id").withColumnRenamed("idx", "u")
    i = S.index_ids(b, "item_id").withColumnRenamed("idx", "i")
    return b.join(u, "user_id").join(i, "item_id").select("u", "i", "rating")


WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()


@query("h11_multi_hot", "", "SELECT p_partkey AS item_id, " + ", ".join(f"CAST(list_contains(string_split(p_name, ' '), '{w}') AS INT) AS w_{w}" for w in WORDS) + " FROM part")
def _(s, d):
    return S.multi_hot(V.table(s, d, "part").withColumnRenamed("p_partkey", "item_id"), "item_id", "p_name", " ", WORDS)


@query("h11_vocabulary", "", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def _(s, d):
    return S.vocabulary(V.table(s, d, "part"), "p_name", " ")


@query("h12_top_items", "bip", "t AS (SELECT item_id, count(*) AS n FROM bip GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT item_id, p_name AS title, n FROM t JOIN part ON p_partkey = item_id")
def _(s, d):
    items = V.table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return S.top_items(V.bip(s, d), items, 10)


@query("h13_unseen_items", "bip", "SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM bip WHERE user_id = 1)")
def _(s, d):
    return S.unseen_items(1, V.bip(s, d), V.table(s, d, "part").select(F.col("p_partkey").alias("item_id")))


# ---- metrics ------------------------------------------------------------------------------

BCE = "round(-avg(truth*greatest(ln(prob), -100)+(1-truth)*greatest(ln(1-prob), -100)), 6)"


@query("i1_bce_loss", "cls pairs", NEG + f", sp AS (SELECT true_label AS truth, prob FROM smp), al AS (SELECT true_label AS truth, prob FROM pairs) SELECT 'documents' AS scope, {BCE} AS bce, count(*) AS n FROM cls UNION ALL SELECT 'all', {BCE}, count(*) FROM al UNION ALL SELECT 'sampled', {BCE}, count(*) FROM sp")
def _(s, d):
    p = V.pairs(s, d).withColumn("truth", F.col("true_label"))
    smp = S.sample_negatives(p, ["graph_id"], pair_id(), 1.5, 3)
    parts = [("documents", V.cls(s, d)), ("all", p), ("sampled", smp)]
    return M.stack_folds([M.bce_loss(x).select(F.lit(n).alias("scope"), rnd("bce").alias("bce"), "n") for n, x in parts])


def degrees(s, d):
    from gridloom.operators.labels import true_degree

    return true_degree(V.pairs(s, d), V.nodes(s, d).select("graph_id", "node"))


DIRECTED = "dir AS (SELECT graph_id, src, dst, true_label, prob FROM pairs UNION ALL SELECT graph_id, dst, src, true_label, prob FROM pairs)"
DEGREE = "deg AS (SELECT node, count(d.src) AS degree FROM nodes LEFT JOIN (SELECT * FROM dir WHERE true_label=1) d ON d.src=node GROUP BY 1)"


@query("i2_degree_penalty", "pairs", DIRECTED + ", " + DEGREE + """, rk AS (SELECT d.src, d.prob, degree, row_number() OVER (PARTITION BY d.src ORDER BY d.prob DESC) AS r, count(*) OVER (PARTITION BY d.src) AS n FROM dir d JOIN deg ON node=d.src),
v AS (SELECT src, pow(sum(prob) FILTER (r<=degree) - coalesce(avg(prob) FILTER (r>degree), 0) - any_value(degree), 2) AS violation FROM rk WHERE degree>0 GROUP BY 1 UNION ALL SELECT node, degree*degree FROM deg WHERE node NOT IN (SELECT src FROM dir))
SELECT round(avg(violation), 6) AS penalty, count(*) AS n FROM v""")
def _(s, d):
    from gridloom.operators.labels import both_directions

    return M.degree_penalty(both_directions(V.pairs(s, d)), degrees(s, d)).withColumn("penalty", rnd("penalty"))


@query("i3_accuracy", "cls", "SELECT round(avg(CAST((prob>=0.6)::INT = truth AS INT)), 6) AS accuracy FROM cls")
def _(s, d):
    return M.accuracy(V.cls(s, d), 0.6).withColumn("accuracy", rnd("accuracy"))


PR = """sc AS (SELECT prob AS u, sum(truth) AS pos, count(*) AS n FROM cls GROUP BY 1), pr AS (SELECT u AS threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER () AS p, pos FROM sc WINDOW w AS (ORDER BY u DESC)),
prc AS (SELECT threshold, tp::DOUBLE/called AS prec, tp::DOUBLE/p AS rec, pos, p FROM pr)"""


@query("i4_pr_curve", "cls", PR + " SELECT round(threshold, 8) AS threshold, round(prec, 8) AS precision, round(rec, 8) AS recall FROM prc")
def _(s, d):
    return M.pr_curve(V.cls(s, d)).select(*[rnd(c, 8).alias(c) for c in ("threshold", "precision", "recall")])


@query("i5_best_f1_threshold", "cls", PR + ", f AS (SELECT threshold, 2*prec*rec/(prec+rec+1e-8) AS f1 FROM prc) SELECT round(threshold, 8) AS threshold, round(f1, 8) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1")
def _(s, d):
    return M.best_f1_threshold(V.cls(s, d)).select(rnd("threshold", 8).alias("threshold"), rnd("f1", 8).alias("f1"))


@query("i6_f1", "cls", "SELECT round(2.0::DOUBLE*count(*) FILTER (prob>=0.6 AND truth=1)/(2*count(*) FILTER (prob>=0.6 AND truth=1)+count(*) FILTER (prob>=0.6 AND truth=0)+count(*) FILTER (prob<0.6 AND truth=1)), 8) AS f1 FROM cls")
def _(s, d):
    return M.f1(V.cls(s, d), 0.6).withColumn("f1", rnd("f1", 8))


AUC = "SELECT {g}round((sum(ar) FILTER (truth=1) - p*(p+1)/2.0::DOUBLE)/(p*n), 8) AS auc FROM rk GROUP BY {k}p, n"


@query("i7_roc_auc", "cls", """rk AS (SELECT truth, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob)-1)/2.0::DOUBLE AS ar, sum(truth) OVER () AS p, sum(1-truth) OVER () AS n FROM cls) """ + AUC.format(g="", k=""))
def _(s, d):
    return M.roc_auc(V.cls(s, d)).withColumn("auc", rnd("auc", 8))


@query("i7_roc_auc_by_graph", "pairs", """rk AS (SELECT graph_id, true_label AS truth, rank() OVER (PARTITION BY graph_id ORDER BY prob) + (count(*) OVER (PARTITION BY graph_id, prob)-1)/2.0::DOUBLE AS ar, sum(true_label) OVER (PARTITION BY graph_id) AS p, sum(1-true_label) OVER (PARTITION BY graph_id) AS n FROM pairs) """ + AUC.format(g="graph_id, ", k="graph_id, "))
def _(s, d):
    return M.roc_auc(V.pairs(s, d).withColumnRenamed("true_label", "truth"), ["graph_id"]).withColumn("auc", rnd("auc", 8))


@query("i8_average_precision", "cls", PR + " SELECT round(sum(pos::DOUBLE/p*prec), 8) AS average_precision FROM prc")
def _(s, d):
    return M.average_precision(V.cls(s, d)).withColumn("average_precision", rnd("average_precision", 8))


KLASS = "CASE WHEN prob>={t} AND {y}=1 THEN 'TP' WHEN prob<{t} AND {y}=0 THEN 'TN' WHEN prob>={t} THEN 'FP' ELSE 'FN' END"


@query("i9_confusion_class", "cls", f"SELECT doc_id, {KLASS.format(t=0.5, y='truth')} AS edge_class FROM cls")
def _(s, d):
    return M.confusion_class(V.cls(s, d), 0.5).select("doc_id", "edge_class")


@query("i10_score_spread", "cls", "SELECT truth, doc_id%3 AS fold, round(avg(prob), 8) AS mean, round(stddev_pop(prob), 8) AS std FROM cls GROUP BY 1,2")
def _(s, d):
    c = V.cls(s, d).withColumn("fold", F.col("doc_id") % 3)
    return M.score_spread(c, ["truth", "fold"]).select("truth", "fold", rnd("mean", 8).alias("mean"), rnd("std", 8).alias("std"))


def predicted(s, d):
    pred = F.when(F.col("node") % 5 == 0, 0).otherwise(F.when(F.col("node") % 3 == 0, F.col("node_type")).otherwise(1))
    return V.nodes(s, d).select("graph_id", "node", F.col("node_type").alias("truth"), pred.alias("pred"))


CM = """pv AS (SELECT graph_id, node, node_type AS truth, CASE WHEN node%5=0 THEN 0 WHEN node%3=0 THEN node_type ELSE 1 END AS pred FROM nodes),
cm AS (SELECT graph_id, cls, count(*) FILTER (truth=cls) AS support, count(*) FILTER (pred=cls) AS called, count(*) FILTER (truth=cls AND pred=cls) AS tp, avg((truth=pred)::INT) AS accuracy FROM pv, (SELECT unnest([0,1,2]) AS cls) GROUP BY 1,2),
cf AS (SELECT graph_id, cls, accuracy, CASE WHEN called>0 THEN tp::DOUBLE/called ELSE 0 END AS precision, tp::DOUBLE/support AS recall, CASE WHEN tp>0 THEN 2.0::DOUBLE*tp/(called+support) ELSE 0 END AS f1, support FROM cm WHERE support>0)"""


@query("i11_class_metrics", "nodes", CM + " SELECT graph_id, cls, round(accuracy, 8) AS accuracy, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM cf")
def _(s, d):
    m = M.class_metrics(predicted(s, d), ["graph_id"])
    return m.select("graph_id", "cls", *[rnd(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "support")


@query("i12_aggregate_class_metrics", "nodes", CM + " SELECT cls, round(avg(f1), 8) AS f1_mean, round(stddev_pop(f1), 8) AS f1_std, count(*) AS n_folds FROM cf GROUP BY 1")
def _(s, d):
    a = M.aggregate_class_metrics(M.class_metrics(predicted(s, d), ["graph_id"]))
    return a.select("cls", rnd("f1_mean", 8).alias("f1_mean"), rnd("f1_std", 8).alias("f1_std"), "n_folds")


def type_names(s, d):
    names = F.when(F.col("node_type") == 0, "background").when(F.col("node_type") == 1, "epithelial").otherwise("hyphal")
    return V.nodes(s, d).select("node", "node_type", names.alias("type_name"))


@query("i13_outcome_by_type_pair", "pairs", f"""ty AS (SELECT node, CASE node_type WHEN 0 THEN 'background' WHEN 1 THEN 'epithelial' ELSE 'hyphal' END AS t FROM nodes),
e AS (SELECT least(a.t,b.t)||'-'||greatest(a.t,b.t) AS pair, {KLASS.format(t=0.6, y='true_label')} AS c FROM pairs JOIN ty a ON a.node=src JOIN ty b ON b.node=dst)
SELECT pair, count(*) AS total, """ + ", ".join(f'count(*) FILTER (c=\'{o}\') AS "{o}", 100.0::DOUBLE*count(*) FILTER (c=\'{o}\')/count(*) AS "{o}_pct"' for o in ("TP", "FN", "FP", "TN")) + " FROM e GROUP BY 1")
def _(s, d):
    return M.outcome_by_type_pair(M.confusion_class(V.pairs(s, d), 0.6, "prob", "true_label"), type_names(s, d))


@query("i14_majority_baseline", "nodes", CM + """, c AS (SELECT graph_id, truth, count(*) AS n, sum((truth=pred)::INT) AS hit FROM pv GROUP BY 1,2)
SELECT graph_id, round(max(n)::DOUBLE/sum(n), 8) AS baseline, round(sum(hit)::DOUBLE/sum(n), 8) AS accuracy, round(sum(hit)::DOUBLE/sum(n)-max(n)::DOUBLE/sum(n), 8)+0.0 AS gain FROM c GROUP BY 1""")
def _(s, d):
    m = M.majority_baseline(predicted(s, d), ["graph_id"])
    return m.select("graph_id", *[rnd(c, 8).alias(c) for c in ("baseline", "accuracy", "gain")])


STOP = """r0 AS (SELECT repeat, fold, epoch, auc, max(auc) OVER (PARTITION BY repeat, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM runs WHERE epoch>=10),
r1 AS (SELECT repeat, fold, epoch, max(CASE WHEN auc>-1 THEN auc END) OVER w AS bm, coalesce(max(CASE WHEN auc > coalesce(pm, -1) THEN epoch END) OVER w, 0) AS le FROM r0 WINDOW w AS (PARTITION BY repeat, fold ORDER BY epoch)),
r2 AS (SELECT *, CASE WHEN epoch-greatest(le, 9)>=60 THEN epoch END AS st FROM r1),
best AS (SELECT repeat, fold, min(st) AS stop_epoch, coalesce(arg_min(le, epoch) FILTER (st IS NOT NULL), max(le)) AS best_epoch, CASE WHEN min(st) IS NULL THEN max(bm) ELSE arg_min(bm, epoch) FILTER (st IS NOT NULL) END AS best_value FROM r2 GROUP BY 1,2)"""


@query("i15_early_stop", "runs", STOP + " SELECT repeat, fold, best_epoch, stop_epoch, round(best_value, 8) AS best_value FROM best")
def _(s, d):
    return M.early_stop(V.runs(s, d), 60, 10).withColumn("best_value", rnd("best_value", 8))


FS = STOP + """, fs AS (SELECT b.repeat, b.fold, best_epoch, round(max(value) FILTER (tag='auc'), 8) AS auc, round(max(value) FILTER (tag='f1'), 8) AS f1, round(max(value) FILTER (tag='pr_auc'), 8) AS pr_auc FROM best b LEFT JOIN metrics m ON m.repeat=b.repeat AND m.fold=b.fold AND m.step=best_epoch WHERE best_epoch>0 GROUP BY 1,2,3)"""


def summary(s, d):
    runs, _ = materialize(V.runs(s, d))  # epochs are numbered once
    best, _ = materialize(M.early_stop(runs, 60, 10))  # one row a run
    fs = M.fold_summary(V.long_metrics(runs), best, ["auc", "f1", "pr_auc"])
    return fs.select("repeat", "fold", "best_epoch", *[rnd(c, 8).alias(c) for c in ("auc", "f1", "pr_auc")])


@query("i16_fold_summary", "metrics", FS + " SELECT repeat, fold, best_epoch, auc, f1, pr_auc FROM fs")
def _(s, d):
    return summary(s, d)


@query("i17_parse_threshold", "runs", "SELECT repeat, fold, epoch, CASE WHEN pr_auc IS NOT NULL THEN pr_auc END AS threshold FROM runs")
def _(s, d):
    text = F.when(F.col("pr_auc").isNull(), "AUC: nan").otherwise(
        F.concat(F.lit("AUC: "), F.col("auc").cast("string"), F.lit(" | Thresh: "), F.col("pr_auc").cast("string"), F.lit(" | F1 "), F.col("f1").cast("string"))
    )
    t = M.parse_threshold(V.runs(s, d).withColumn("text", text), "text")
    return t.select("repeat", "fold", "epoch", "threshold")


PV = ", ".join(f"max({c}) FILTER (repeat='{r}') AS \"{r}_{c}\"" for c in ("best_epoch", "auc", "f1", "pr_auc") for r in "ANR")


@query("i18_pivot_by_fold", "metrics", FS + f" SELECT fold, {PV} FROM fs GROUP BY 1")
def _(s, d):
    return M.pivot_by_fold(summary(s, d))


@query("i19_cv_aggregate", "metrics", FS + " SELECT count(*) AS n_folds, round(avg(auc), 8) AS mean_auc, round(avg(f1), 8) AS mean_f1, round(avg(pr_auc), 8) AS mean_pr_auc FROM fs")
def _(s, d):
    a = M.cv_aggregate(summary(s, d))
    return a.select("n_folds", *[rnd(c, 8).alias(c) for c in ("mean_auc", "mean_f1", "mean_pr_auc")])


@query("i19_pooled_folds", "cls", "SELECT doc_id%4 AS fold, count(*) AS n, round(avg(prob), 8) AS mean_prob FROM cls GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(prob), 8) FROM cls")
def _(s, d):
    c = V.cls(s, d)
    pooled = M.stack_folds([c.filter(F.col("doc_id") % 4 == k).withColumn("fold", F.lit(k).cast("long")) for k in range(4)])
    return pooled.rollup("fold").agg(F.count("*").alias("n"), rnd(F.avg("prob"), 8).alias("mean_prob"))


@query("i20_edge_report", "pairs", DIRECTED + f""", att AS (SELECT *, CASE WHEN src<dst THEN prob ELSE prob/2 END AS a1, CASE WHEN src<dst THEN prob*prob ELSE 0.0::DOUBLE END AS a2 FROM dir),
sy AS (SELECT graph_id, src, dst, true_label, prob, avg(a1) OVER w AS a1, avg(a2) OVER w AS a2 FROM att WINDOW w AS (PARTITION BY graph_id, least(src,dst), greatest(src,dst)))
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst)-1 AS edge_idx, src, dst AS tgt, round(a1, 8) AS a1, round(a2, 8) AS a2, prob, true_label, {KLASS.format(t=0.6, y='true_label')} AS edge_class FROM sy""")
def _(s, d):
    from gridloom.operators.labels import both_directions

    e = both_directions(V.pairs(s, d))
    fwd = F.col("src") < F.col("dst")
    e = e.withColumn("a1", F.when(fwd, F.col("prob")).otherwise(F.col("prob") / 2)).withColumn("a2", F.when(fwd, F.col("prob") * F.col("prob")).otherwise(0.0))
    r = M.edge_report(e, 0.6)
    return r.withColumn("a1", rnd("a1", 8)).withColumn("a2", rnd("a2", 8))


@query("i21_attribution_rows", "pix", """g AS (SELECT image_id, y, x, CASE WHEN x>=5 THEN x-5 WHEN x<2 THEN x+3 ELSE x+3 END AS pos, ln(1+CAST(v%97 AS DOUBLE)) AS l, sum(ln(1+CAST(v%97 AS DOUBLE))) OVER (PARTITION BY image_id, y) AS t FROM pix)
SELECT image_id, y, CAST(pos AS INT) AS pos, round(l/CASE WHEN t<1e-8 THEN 1 ELSE t END, 8)+0.0 AS a FROM g""")
def _(s, d):
    rows = V.pix(s, d).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.expr("cast(v % 97 as double) as u")))).alias("p"))
    a = M.attribution_rows(rows.withColumn("a", F.transform("p", lambda q: q["u"])), "a", [(5, 8), (0, 2), (2, 5)])
    return a.select("image_id", "y", F.posexplode("a").alias("pos", "a")).withColumn("a", rnd("a", 8))


@query("i22_report_order", "cls", f"""k AS (SELECT doc_id, prob, {KLASS.format(t=0.5, y='truth')} AS edge_class FROM cls),
o AS (SELECT *, list_position(['TP','TN','FP','FN'], edge_class) AS co, row_number() OVER (PARTITION BY edge_class ORDER BY CASE WHEN edge_class='TN' THEN 1-prob ELSE prob END, doc_id) AS class_rank FROM k)
SELECT doc_id, edge_class, class_rank, class_rank=1 AND co > (SELECT min(co) FROM o) AS boundary FROM o""")
def _(s, d):
    r = M.report_order(M.confusion_class(V.cls(s, d), 0.5), "doc_id")
    return r.select("doc_id", "edge_class", "class_rank", "boundary").orderBy(F.expr("array_position(array('TP','TN','FP','FN'), edge_class)"), "class_rank")


@query("i26_rmse", "bip", "im AS (SELECT item_id, avg(rating)*1.2-1 AS pred FROM bip GROUP BY 1) SELECT round(sqrt(avg(pow(least(greatest(pred, 0), 5)-rating, 2))), 8) AS rmse, count(*) AS n FROM bip JOIN im USING (item_id)")
def _(s, d):
    b = V.bip(s, d)
    pred = b.groupBy("item_id").agg((F.avg("rating") * 1.2 - 1).alias("pred"))
    return M.rmse(b.join(pred, "item_id"), 0, 5, "pred", "rating").withColumn("rmse", rnd("rmse", 8))
