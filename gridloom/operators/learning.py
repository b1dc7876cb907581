"""Fitted models on Spark ML and small one-pass linear methods."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import stencil as st
from gridloom.functions.columns import dot
from gridloom.functions.rounds import materialize
from gridloom.operators import filters as N, metrics as M, raster as R, sampling as S


def pixel_features(df: DataFrame, sigma: float = 1.0, side: int = 3, scales: tuple[float, ...] = (1.2, 1.6)) -> DataFrame:
    """Filter responses per pixel: value, blur, gradient, Laplacian, local mean, vesselness (of 16-bit values as shares).

    They are written once: a fit passes over them many times and would shuffle for every filter each time."""
    f = N.sobel(df).withColumnRenamed("magnitude", "f_sobel").drop("gx", "gy")
    f = N.gaussian_blur(f, sigma, out="f_blur")
    f = N.laplacian(f).withColumnRenamed("lap", "f_laplacian")
    f = N.gaussian_gradient(f, sigma).withColumnRenamed("magnitude", "f_gradient").drop("gx", "gy")
    f = st.separable(f, N.IMG, "v", {"f_mean": ([1 / side] * side,) * 2}, st.REFLECT)
    f = N.frangi(f.withColumn("_raw", F.col("v")).withColumn("v", F.col("v") / float(R.U16)), list(scales)).withColumnRenamed("vesselness", "f_vesselness")
    return materialize(f.drop("v", "scale").withColumnRenamed("_raw", "v").withColumn("f_value", F.col("v").cast("double")))[0]


FEATURES = ["f_value", "f_blur", "f_sobel", "f_laplacian", "f_gradient", "f_mean", "f_vesselness"]


def rf_pixels(train: DataFrame, apply_to: DataFrame, label: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """Random-forest class per pixel: the class with the highest probability."""
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=6, seed=seed)
    model = rf.fit(va.transform(train))
    out = model.transform(va.transform(apply_to))
    return out.withColumn("probability", vector_to_array("probability")).withColumn("cls", F.col("prediction").cast("int")).drop("features", "rawPrediction", "prediction")


def gmm_1d(df: DataFrame, value: Column, k: int, seed: int = 42) -> DataFrame:
    """Probability of every mixture component per row, components ordered by mean."""
    va = VectorAssembler(inputCols=["_u"], outputCol="_f")
    x = va.transform(df.withColumn("_u", value))
    model = GaussianMixture(k=k, featuresCol="_f", probabilityCol="_p", seed=seed).fit(x)
    means = [float(g.mean[0]) for g in model.gaussians]  # k numbers
    order = sorted(range(k), key=means.__getitem__)
    p = vector_to_array("_p")
    out = model.transform(x)
    return out.withColumns({f"p{n}": p[i] for n, i in enumerate(order)}).drop("_u", "_f", "_p", "prediction")


def pca(vectors: DataFrame, fit_on: DataFrame, k: int = 2) -> DataFrame:
    """Coordinates on the k main axes of `fit_on`, centred by its mean, with the share of
    variance each axis explains."""
    mean = fit_on.select(F.posexplode("vec").alias("i", "u")).groupBy("i").agg(F.avg("u").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))  # one row

    def centred(df: DataFrame) -> DataFrame:
        c = df.crossJoin(F.broadcast(mean)).withColumn("_c", F.zip_with("vec", "_mean", lambda a, b: a - b))
        return c.withColumn("_c", array_to_vector("_c")).drop("_mean")

    model = PCA(k=k, inputCol="_c", outputCol="_z").fit(centred(fit_on))
    z = vector_to_array("_z")
    out = model.transform(centred(vectors))
    ratio = model.explainedVariance.toArray()
    return out.withColumns({f"pc{i + 1}": z[i] for i in range(k)} | {f"explained{i + 1}": F.lit(float(ratio[i])) for i in range(k)}).drop("_c", "_z", "vec")


def plsda(df: DataFrame, y: Column, k: int = 2) -> DataFrame:
    """Latent scores of a partial-least-squares fit and the share of X explained per component.

    Inputs are standardized.  A component needs one aggregate for its weights and one for its
    loadings; both are single rows as wide as the vectors and go back by broadcast.
    """
    base = df.withColumn("_y", y.cast("double"))
    d = S.vector_zscore(base, base)
    ys = base.agg(F.avg("_y").alias("_ym"), F.stddev_samp("_y").alias("_ys"))
    d = d.crossJoin(F.broadcast(ys)).withColumn("_y", (F.col("_y") - F.col("_ym")) / F.col("_ys")).drop("_ym", "_ys")
    d, _ = materialize(d)

    def one_row(rows: DataFrame, value: Column, out: str) -> DataFrame:
        g = rows.select(F.posexplode("vec").alias("i", "u"), *[c for c in ("_y", "_t") if c in rows.columns]).groupBy("i").agg(F.sum(value).alias("s"))
        return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda s: s["s"]).alias(out))

    total = d.agg(F.sum(dot("vec", "vec")).alias("_ss"))
    d = d.crossJoin(F.broadcast(total))
    for c in range(1, k + 1):
        w = one_row(d, F.col("u") * F.col("_y"), "_w")
        w = w.withColumn("_w", F.transform("_w", lambda v: v / F.sqrt(dot("_w", "_w"))))
        d = d.crossJoin(F.broadcast(w)).withColumn("_t", dot("vec", "_w"))
        load = one_row(d, F.col("u") * F.col("_t"), "_p").crossJoin(d.agg(F.sum(F.col("_t") * F.col("_t")).alias("_tt"), F.sum(F.col("_t") * F.col("_y")).alias("_q")))
        load = load.withColumn("_p", F.transform("_p", lambda v: v / F.col("_tt"))).withColumn("_q", F.col("_q") / F.col("_tt"))
        d = d.crossJoin(F.broadcast(load))
        d = d.withColumn("vec", F.zip_with("vec", "_p", lambda a, b: a - F.col("_t") * b)).withColumn("_y", F.col("_y") - F.col("_q") * F.col("_t"))
        d = d.withColumnRenamed("_t", f"lv{c}").withColumn(f"r2x{c}", F.col("_tt") * dot("_p", "_p") / F.col("_ss")).drop("_w", "_p", "_tt", "_q")
        d, _ = materialize(d)
    return d.drop("vec", "_y", "_ss")


def edge_ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the vectors of their ends, `va` and `vb`."""
    a = nodes.select(F.col("node").alias("src"), F.col("vec").alias("va"))
    b = nodes.select(F.col("node").alias("dst"), F.col("vec").alias("vb"))
    return pairs.join(a, "src").join(b, "dst")


def edge_classifier(pairs: DataFrame, nodes: DataFrame, folds: list[int], ratio: float = 1.5, seed: int = 3) -> DataFrame:
    """Held-out score of every edge: per fold, vectors are standardized on the training graphs,
    negatives sampled, and a logistic model scores the held-out graphs.

    Negatives are sampled for all folds on rows without vectors; vectors meet their pairs once, and a
    fold only applies its own statistics, which are single rows."""
    picked = pairs
    for k in folds:
        rest = picked.filter(F.col("fold") == k).withColumn(f"_train{k}", F.lit(False))
        tr = S.mark_negatives(picked.filter(F.col("fold") != k), ["graph_id"], F.concat_ws("-", "src", "dst"), ratio, seed, f"_train{k}")
        picked, _ = materialize(tr.unionByName(rest))
    ends, _ = materialize(edge_ends(picked, nodes))
    out = None
    for k in folds:  # a handful of model fits, each a distributed job
        z = S.vector_zscore(nodes.filter(F.col("fold") != k), ends, into=("va", "vb"))
        z = S.column_zscore(pairs.filter(F.col("fold") != k), z, "prob")
        z = z.withColumn("features", array_to_vector(F.concat("va", "vb", F.array("prob")))).drop("va", "vb")
        model = LogisticRegression(labelCol="true_label", maxIter=10, regParam=0.01).fit(z.filter(f"_train{k}"))
        sc = model.transform(z.filter(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1])
        sc = sc.select("graph_id", "fold", "src", "dst", "true_label", "score")
        out = sc if out is None else out.unionByName(sc)
    return out


def fold_metrics(scored: DataFrame) -> DataFrame:
    """AUC, score spread and loss of every fold."""
    s = scored.select("fold", F.col("score").alias("prob"), F.col("true_label").alias("truth"))
    return M.roc_auc(s, ["fold"]).join(M.score_spread(s, ["fold"]), "fold").join(M.bce_loss(s, ["fold"]), "fold")
