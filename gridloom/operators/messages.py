"""Message passing on graphs as joins and aggregates; vectors travel as (dimension, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.columns import dot, with_stats


def symmetrize(edges: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """Mean of both directions, or their maximum clamped to [0, 1]; self-loops untouched."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    agg = F.avg(value) if how == "mean" else F.least(F.greatest(F.max(value), F.lit(0.0)), F.lit(1.0))
    pair = edges.filter("src <> dst").groupBy("graph_id", lo.alias("_lo"), hi.alias("_hi")).agg(agg.alias("_v"))
    e = edges.withColumn("_lo", lo).withColumn("_hi", hi).join(pair, ["graph_id", "_lo", "_hi"], "left")
    return e.withColumn(value, F.coalesce("_v", value)).drop("_lo", "_hi", "_v")


def _dims(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), F.posexplode("vec").alias("dim", "u"))


def gcn_aggregate(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """Neighbour sum with self-loops, weighted by deg^-1/2 of both ends: (node, dim, u)."""
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    e = directed.select("src", "dst").unionByName(loops)
    deg = e.groupBy("dst").agg(F.count("*").alias("d"))
    e = e.join(deg.withColumnsRenamed({"dst": "src", "d": "ds"}), "src").join(deg, "dst")
    e = e.withColumn("w", 1 / F.sqrt(F.col("ds") * F.col("d")))
    return e.join(_dims(nodes, "src"), "src").groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col("w") * F.col("u")).alias("u"))


def attention_weights(directed: DataFrame, score: str) -> DataFrame:
    """Softmax of a score over the edges into each node."""
    s = with_stats(directed, ["dst"], _m=F.max(score))
    s = s.withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    s = with_stats(s, ["dst"], _t=F.sum("_e"))
    return s.withColumn("alpha", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def attention_aggregate(nodes: DataFrame, directed: DataFrame, score: str, extra: str) -> DataFrame:
    """Weighted sum over in-edges of [x_src - x_dst, edge value]: (node, dim, u), the edge value
    as the last dimension."""
    a = attention_weights(directed, score).select("src", "dst", "alpha", extra)
    src, dst = _dims(nodes, "src"), _dims(nodes, "dst").withColumnRenamed("u", "v")
    diff = a.join(src, "src").join(dst, ["dst", "dim"])
    m = diff.groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col("alpha") * (F.col("u") - F.col("v"))).alias("u"))
    width = nodes.select(F.size("vec").alias("w")).limit(1)
    last = a.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("alpha") * F.col(extra)).alias("u"))
    last = last.crossJoin(F.broadcast(width)).select("node", F.col("w").alias("dim"), "u")  # one row
    return m.unionByName(last)


def edgeconv_max(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """Largest relu(x_dst + 2 (x_src - x_dst)) over in-edges, per dimension."""
    src, dst = _dims(nodes, "src"), _dims(nodes, "dst").withColumnRenamed("u", "v")
    f = F.greatest(F.col("v") + 2 * (F.col("u") - F.col("v")), F.lit(0.0))
    return directed.select("src", "dst").join(src, "src").join(dst, ["dst", "dim"]).groupBy(F.col("dst").alias("node"), "dim").agg(F.max(f).alias("u"))


def neighbour_mean(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean vector of the items each user is linked to: (user_id, dim, u)."""
    v = vectors.select("item_id", F.posexplode("vec").alias("dim", "u"))
    return edges.join(v, "item_id").groupBy("user_id", "dim").agg(F.avg("u").alias("u"))


def link_dot(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score of a pair of nodes: dot product of their vectors."""
    a = vectors.select(F.col("node").alias("src"), F.col("vec").alias("va"))
    b = vectors.select(F.col("node").alias("dst"), F.col("vec").alias("vb"))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", dot("va", "vb")).drop("va", "vb")


def graph_norm(nodes: DataFrame, alpha: float, eps: float = 1e-5) -> DataFrame:
    """Per graph and dimension: (x - alpha * mean) over the deviation of that difference."""
    d = nodes.select("graph_id", "node", F.posexplode("vec").alias("dim", "u"))
    d = with_stats(d, ["graph_id", "dim"], _m=F.avg("u"), _q=F.avg(F.col("u") * F.col("u")))
    m = F.col("_m")
    var = F.col("_q") - 2 * alpha * m * m + alpha * alpha * m * m
    return d.select("graph_id", "node", "dim", ((F.col("u") - alpha * m) / F.sqrt(var + eps)).alias("u"))


def direction_mask(directed: DataFrame, potential: DataFrame, temperature: float) -> DataFrame:
    """Probability times the sigmoid of the potential rise from source to target."""
    a = potential.select(F.col("node").alias("src"), F.col("phi").alias("ps"))
    b = potential.select(F.col("node").alias("dst"), F.col("phi").alias("pd"))
    e = directed.join(a, "src").join(b, "dst")
    return e.withColumn("masked", F.col("prob") / (1 + F.exp(-(F.col("pd") - F.col("ps")) / temperature))).drop("ps", "pd")
