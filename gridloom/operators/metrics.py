"""Evaluation metrics and cross-validation tables.

Score-ordered metrics first collapse to counts per distinct score, then take running sums in
buckets cut at score quantiles, so they hold for any number of rows and any distribution of scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import running_max, running_sums


def bce_loss(df: DataFrame, keys: list[str] = []) -> DataFrame:
    p, y = F.col("prob"), F.col("truth")
    log_p = F.when(p > 0, F.greatest(F.log(p), F.lit(-100.0))).otherwise(-100.0)
    log_q = F.when(p < 1, F.greatest(F.log(1 - p), F.lit(-100.0))).otherwise(-100.0)
    return df.groupBy(*keys).agg((-F.avg(y * log_p + (1 - y) * log_q)).alias("bce"), F.count("*").alias("n"))


def degree_penalty(directed: DataFrame, degree: DataFrame) -> DataFrame:
    """Mean over nodes of (top-degree score sum - mean of the other scores - degree)^2.

    Nodes of degree 0 with edges are skipped; nodes without edges count degree^2.  Scores of a
    node collapse to distinct values, ranks come from running counts: a hub needs no single task.
    """
    d = directed.groupBy("src", F.col("prob").alias("p")).agg(F.count("*").alias("n"))
    d = d.withColumn("u", 1 - F.col("p"))
    r = running_sums(d, ["src"], "u", {"upto": "n"})
    r = r.join(degree.filter("degree > 0").select(F.col("node").alias("src"), "degree"), "src")
    taken = F.greatest(F.least(F.col("degree") - (F.col("upto") - F.col("n")), F.col("n")), F.lit(0))
    g = r.groupBy("src").agg(
        F.first("degree").alias("degree"), F.sum(taken * F.col("p")).alias("top"),
        F.sum(F.col("n") * F.col("p")).alias("total"), F.sum("n").alias("n"), F.sum(taken).alias("k"),
    )
    rest = F.when(F.col("n") > F.col("k"), (F.col("total") - F.col("top")) / (F.col("n") - F.col("k"))).otherwise(0.0)
    some = g.select(F.pow(F.col("top") - rest - F.col("degree"), F.lit(2.0)).alias("violation"))
    none = degree.join(directed.select(F.col("src").alias("node")), "node", "left_anti").select(
        F.pow(F.col("degree").cast("double"), F.lit(2.0)).alias("violation")
    )
    return some.unionByName(none).agg(F.avg("violation").alias("penalty"), F.count("*").alias("n"))


def accuracy(df: DataFrame, t: float, keys: list[str] = []) -> DataFrame:
    hit = ((F.col("prob") >= t).cast("int") == F.col("truth")).cast("int")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def _by_score(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("prob").alias("u")).agg(F.sum("truth").alias("pos"), F.count("*").alias("n"))


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score taken as an inclusive threshold."""
    s = running_sums(_by_score(df), [], "u", {"pos_upto": "pos", "n_upto": "n"})
    s = with_stats(s, [], _p=F.sum("pos"), _n=F.sum("n"))
    tp = F.col("_p") - F.col("pos_upto") + F.col("pos")
    called = F.col("_n") - F.col("n_upto") + F.col("n")
    return s.select(
        F.col("u").alias("threshold"), (tp / called).alias("precision"),
        F.when(F.col("_p") > 0, tp / F.col("_p")).otherwise(1.0).alias("recall"), "pos", F.col("_p").alias("positives"),
    )


def best_f1_threshold(df: DataFrame) -> DataFrame:
    """Smallest threshold with the best 2pr/(p+r+1e-8); 0.5 for an empty input."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    best = pr_curve(df).withColumn("f1", f1).agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), "b.f1")


def f1(df: DataFrame, t: float) -> DataFrame:
    call, y = F.col("prob") >= t, F.col("truth") == 1
    tp, fp, fn = (F.count_if(c) for c in (call & y, call & ~y, ~call & y))
    return df.agg(F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def roc_auc(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Tie-aware area under the ROC curve from average ranks; NULL for a single class."""
    g = df.groupBy(*keys, F.col("prob").alias("u")).agg(F.sum("truth").alias("pos"), F.count("*").alias("n"))
    s = running_sums(g, keys, "u", {"upto": "n"})
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    auc = (F.sum(F.col("pos") * mean_rank) - p * (p + 1) / 2) / (p * n)
    return s.groupBy(*keys).agg(F.when((p > 0) & (n > 0), auc).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of recall steps times precision; a step is the share of positives at that score."""
    c = pr_curve(df)
    return c.agg(F.sum(F.col("pos") / F.col("positives") * F.col("precision")).alias("average_precision"))


def confusion_class(df: DataFrame, t: float, prob: str = "prob", truth: str = "truth") -> DataFrame:
    call, y = F.col(prob) >= t, F.col(truth) == 1
    c = F.when(call & y, "TP").when(~call & ~y, "TN").when(call, "FP").otherwise("FN")
    return df.withColumn("edge_class", c)


def score_spread(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"))


def class_metrics(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class present in the truth, with the accuracy of
    its group.  All from one small table of (truth, prediction) counts."""
    c = df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    t = c.groupBy(*keys, F.col("t").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(*keys, F.col("p").alias("cls")).agg(F.sum("n").alias("called"))
    acc = c.groupBy(*keys).agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    m = t.join(p, [*keys, "cls"], "left")
    m = m.join(acc, keys) if keys else m.crossJoin(F.broadcast(acc))
    prec = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    rec = F.col("tp") / F.col("support")
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    pr = F.col("precision") + F.col("recall")
    m = m.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0))
    return m.select(*keys, "cls", "accuracy", "precision", "recall", "f1", "support")


def aggregate_class_metrics(folds: DataFrame) -> DataFrame:
    return folds.groupBy("cls").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.count("*").alias("n_folds"))


def outcome_by_type_pair(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Counts and shares of outcomes by unordered class pair; only pairs that occur."""
    a = types.select(F.col("node").alias("src"), F.col("type_name").alias("ta"))
    b = types.select(F.col("node").alias("dst"), F.col("type_name").alias("tb"))
    e = edges.join(a, "src").join(b, "dst")
    e = e.withColumn("pair", F.concat_ws("-", F.least("ta", "tb"), F.greatest("ta", "tb")))
    order = ["TP", "FN", "FP", "TN"]
    g = e.groupBy("pair").pivot("edge_class", order).count().na.fill(0)
    total = sum((F.col(o) for o in order[1:]), F.col(order[0]))
    g = g.withColumn("total", total)
    return g.select("pair", "total", *order, *[(100.0 * F.col(o) / F.col("total")).alias(f"{o}_pct") for o in order])


def majority_baseline(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Share of the commonest class per group and what the predictions add to it."""
    c = df.groupBy(*keys, truth).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(pred)).cast("int")).alias("hit"))
    g = c.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("baseline"), (F.sum("hit") / F.sum("n")).alias("accuracy"))
    return g.withColumn("gain", F.col("accuracy") - F.col("baseline"))


def epoch_bucket():
    return F.expr("epoch div 4096")


def early_stop(runs: DataFrame, patience: int, min_epoch: int, metric: str = "auc") -> DataFrame:
    """Best and stop epoch per run with the best value: strict improvements from min_epoch on, stop at the
    first epoch that lies `patience` epochs after the last improvement (NULL if never).

    One running maximum of (value, earliest epoch) carries everything.
    """
    keys = ["repeat", "fold"]
    r = runs.filter(F.col("epoch") >= min_epoch).select(*keys, "epoch", F.col(metric).alias("m"))
    r = r.withColumn("_own", F.when(F.col("m") > -1.0, F.struct("m", (-F.col("epoch")).alias("e"))))
    r = running_max(r, keys, "epoch", "_own", "_before", epoch_bucket())
    r = r.withColumn("_best", F.greatest("_own", "_before"))
    since = F.coalesce(-F.col("_best.e"), F.lit(0))
    r = r.withColumn("_stop", F.when(F.col("epoch") - F.greatest(since, F.lit(min_epoch - 1)) >= patience, F.col("epoch")))
    g = r.groupBy(*keys).agg(F.min("_stop").alias("stop_epoch"), F.min_by("_best", "_stop").alias("_at_stop"), F.max("_best").alias("_all"))
    g = g.withColumn("_b", F.when(F.col("stop_epoch").isNotNull(), F.col("_at_stop")).otherwise(F.col("_all")))
    return g.select(*keys, "stop_epoch", F.coalesce(-F.col("_b.e"), F.lit(0)).alias("best_epoch"), F.col("_b.m").alias("best_value"))


def fold_summary(metrics: DataFrame, best: DataFrame, tags: list[str]) -> DataFrame:
    """Every tag at the best epoch, one row per run, NULL where a tag is missing; runs without
    a best epoch drop out."""
    b = best.filter(F.col("best_epoch") > 0).select("repeat", "fold", F.col("best_epoch").alias("step"))
    at = metrics.join(b, ["repeat", "fold", "step"], "left_semi").groupBy("repeat", "fold", "step").pivot("tag", tags).agg(F.first("value"))
    return b.join(at, ["repeat", "fold", "step"], "left").withColumnRenamed("step", "best_epoch")


def parse_threshold(df: DataFrame, text: str) -> DataFrame:
    m = F.regexp_extract(text, r"Thresh[: ]\s*([0-9.eE+-]+)", 1)
    return df.withColumn("threshold", F.when(m != "", m.try_cast("double")))


def pivot_by_fold(df: DataFrame, repeats: list[str] | None = None) -> DataFrame:
    """One row per fold with <repeat>_<metric> columns, grouped by metric."""
    if not {"repeat", "fold"} <= set(df.columns):
        raise ValueError("pivot_by_fold needs the columns repeat and fold")
    names = [c for c in df.columns if c not in ("repeat", "fold")]
    if repeats is None:  # one value per training repeat: a handful
        repeats = [r[0] for r in df.select("repeat").distinct().orderBy("repeat").collect()]
    p = df.groupBy("fold").pivot("repeat", repeats).agg(*[F.first(c).alias(c) for c in names])
    if len(names) == 1:
        p = p.select("fold", *[F.col(r).alias(f"{r}_{names[0]}") for r in repeats])
    return p.select("fold", *[f"{r}_{c}" for c in names for r in repeats])


def cv_aggregate(folds: DataFrame) -> DataFrame:
    """Means over folds; undefined values do not count."""
    return folds.agg(F.count("*").alias("n_folds"), *[F.avg(c).alias(f"mean_{c}") for c in folds.columns if c not in ("repeat", "fold", "best_epoch")])


def edge_report(edges: DataFrame, t: float) -> DataFrame:
    """Report rows of directed edges (graph_id, src, dst, a1, a2, prob, true_label).

    Weights of both directions are averaged; the index numbers a graph's edges by (src, dst)
    using running counts over sources and, inside a source, over ranges of targets.
    """
    pair = ["graph_id", F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")]
    sym = edges.groupBy(*pair).agg(F.avg("a1").alias("a1"), F.avg("a2").alias("a2"))
    e = edges.drop("a1", "a2").withColumn("_lo", F.least("src", "dst")).withColumn("_hi", F.greatest("src", "dst"))
    e = e.join(sym, ["graph_id", "_lo", "_hi"])
    per = edges.groupBy("graph_id", "src").agg(F.count("*").alias("_n"))
    off = running_sums(per, ["graph_id"], "src", {"_to": "_n"}, 8).select("graph_id", "src", (F.col("_to") - F.col("_n")).alias("_off"))
    e = running_sums(e.withColumn("_one", F.lit(1)), ["graph_id", "src"], "dst", {"_r": "_one"}, bucket=F.expr("dst div 65536"))
    e = e.join(off, ["graph_id", "src"])
    idx = F.col("_off") + F.col("_r") - 1
    e = confusion_class(e.withColumn("edge_idx", idx), t, "prob", "true_label")
    return e.select("graph_id", "edge_idx", "src", F.col("dst").alias("tgt"), "a1", "a2", "prob", "true_label", "edge_class")


def attribution_rows(df: DataFrame, array: str, groups: list[tuple[int, int]]) -> DataFrame:
    """log1p, divide by the row sum (rows summing to 0 stay), group columns contiguously."""
    logs = F.transform(array, lambda v: F.log1p(v))
    total = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v)
    d = df.withColumn("_l", logs).withColumn("_t", F.when(total < 1e-8, 1.0).otherwise(total))
    parts = [F.slice("_l", a + 1, b - a) for a, b in groups]
    return d.withColumn(array, F.transform(F.concat(*parts), lambda v: v / F.col("_t"))).drop("_l", "_t")


# Order of the outcome classes in reports.
CLASS_ORDER = ["TP", "TN", "FP", "FN"]


def report_order(df: DataFrame, id_col: str) -> DataFrame:
    """Position of every row inside its outcome class (TN by falling score, others rising) and a
    mark on the first row of every class but the first one present."""
    u = F.when(F.col("edge_class") == "TN", 1 - F.col("prob")).otherwise(F.col("prob"))
    d = df.withColumn("u", u)
    per = d.groupBy("edge_class", "u").agg(F.count("*").alias("_n"))
    off = running_sums(per, ["edge_class"], "u", {"_to": "_n"}).select("edge_class", "u", (F.col("_to") - F.col("_n")).alias("_off"))
    d = running_sums(d.withColumn("_one", F.lit(1)), ["edge_class", "u"], id_col, {"_r": "_one"}, bucket=F.expr(f"{id_col} div 65536"))
    d = d.join(off, ["edge_class", "u"])
    pos = F.col("_off") + F.col("_r")
    order = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("edge_class"))
    d = d.withColumn("class_order", order).withColumn("class_rank", pos)
    d = with_stats(d, [], _first=F.min("class_order"))
    return d.withColumn("boundary", (F.col("class_rank") == 1) & (F.col("class_order") > F.col("_first"))).drop("u", "_off", "_first", "_r", "_one")


def rmse(df: DataFrame, lo: float, hi: float, pred: str = "pred", truth: str = "truth") -> DataFrame:
    p = F.least(F.greatest(F.col(pred), F.lit(float(lo))), F.lit(float(hi)))
    return df.agg(F.sqrt(F.avg((p - F.col(truth)) * (p - F.col(truth)))).alias("rmse"), F.count("*").alias("n"))


def stack_folds(parts: list[DataFrame]) -> DataFrame:
    """Pooled held-out rows of several folds."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


