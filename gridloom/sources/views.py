"""Input views over the given tables, in Spark and as SQL definitions.

The tables hold no images, so a 64-value vector is read as one 8x8 image and vectors are tiled
into larger rasters.  Pixel values become integers once, which keeps sums exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.columns import dot, doubles
from gridloom.functions.ordering import first_by


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "e")
    ).withColumn("e", F.col("e").cast("double"))


def _idiv(a: str, n: int) -> Column:
    return F.expr(f"{a} div {n}")


def _v() -> Column:
    return F.floor((F.col("e") + 0.6) * 50000).cast("int").alias("v")


def _y(scale: str = "0") -> Column:
    return F.expr(f"({scale})*8 + pos div 8").cast("long").alias("y")


def _x(scale: str = "0") -> Column:
    return F.expr(f"({scale})*8 + pos % 8").cast("long").alias("x")


def pix(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select(F.col("vec_id").alias("image_id"), _y(), _x(), _v())


def pages(spark: SparkSession, d: str) -> DataFrame:
    """24 vectors are the pages of an image; the last image may have fewer."""
    return emb(spark, d).select(_idiv("vec_id", 24).alias("image_id"), (F.col("vec_id") % 24).alias("page"), _y(), _x(), _v())


def stack(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.raster import split_channels

    return split_channels(pages(spark, d), 3)


def mosaic(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select(
        F.lit(0).cast("long").alias("image_id"),
        _y("vec_id div 20"),
        _x("vec_id % 20"),
        "e",
        _v(),
        (F.col("e") > 0.05).alias("fg"),
    )


def mosaics(spark: SparkSession, d: str) -> DataFrame:
    """Mosaics of 200 vectors, 20 in a row; the last image may be lower."""
    return emb(spark, d).select(
        _idiv("vec_id", 200).alias("image_id"), _y("(vec_id % 200) div 20"), _x("vec_id % 20"), "e", _v(), (F.col("e") > 0.05).alias("fg"),
    )


def region(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select(
        _idiv("vec_id", 100).alias("image_id"),
        _y("(vec_id % 100) div 10"),
        _x("vec_id % 10"),
        _v(),
        F.when(F.col("e") > 0, F.col("vec_id") % 100 + 1).otherwise(0).alias("frag"),
        F.when(F.col("e") > F.lit(0.02) * (F.col("vec_id") % 10), _idiv("(vec_id % 100)", 4) + 1).otherwise(0).alias("gt"),
    )


def frags(spark: SparkSession, d: str) -> DataFrame:
    """Label pixels of the fragments: (image_id, label, y, x)."""
    return region(spark, d).filter("frag > 0").select("image_id", F.col("frag").alias("label"), "y", "x")


def profile(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("label"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("intensity"),
    )
    t0 = ev.groupBy("label").agg(F.min("us").alias("us0"))
    return ev.join(t0, "label").select(
        "label", ((F.col("us") - F.col("us0")) / 3600000000.0).alias("distance"), "intensity"
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Metric values per (repeat, fold, epoch).

    Epochs number the rows of a run in time order.  Counting per (run, ship date) first keeps
    every window small: only rows of one date are ranked against each other.
    """
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("repeat"), F.col("l_linenumber").alias("fold"), "l_shipdate",
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
    )
    per_day = li.groupBy("repeat", "fold", "l_shipdate").agg(F.count("*").alias("n"))
    before = W.partitionBy("repeat", "fold").orderBy("l_shipdate").rowsBetween(W.unboundedPreceding, -1)
    offs = per_day.select("repeat", "fold", "l_shipdate", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    day = W.partitionBy("repeat", "fold", "l_shipdate").orderBy(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return li.join(offs, ["repeat", "fold", "l_shipdate"]).select(
        "repeat",
        "fold",
        (F.row_number().over(day) + F.col("off")).cast("int").alias("epoch"),
        ((F.col("l_extendedprice") % 1000) / 1000).alias("auc"),
        (F.col("l_discount") * 10).alias("f1"),
        F.when(F.col("l_tax") < 0.01, None).otherwise(F.col("l_tax")).alias("pr_auc"),
    )


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return long_metrics(runs(spark, d))


def long_metrics(r: DataFrame) -> DataFrame:
    return r.unpivot(["repeat", "fold", "epoch"], ["auc", "f1", "pr_auc"], "tag", "value").filter(
        F.col("value").isNotNull()
    ).withColumnRenamed("epoch", "step")


def bip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("item_id"), "l_quantity")
    return o.join(li, "k").groupBy("user_id", "item_id").agg((F.max("l_quantity") / 10).alias("rating"))


def cls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    n = F.col("n_chars").cast("double")
    return lab.join(docs, "doc_id").select(
        "doc_id", (n / (F.col("n_chars") + 2000)).alias("prob"), F.col("quality").alias("truth")
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """4 vectors are the tiles of an image; the last image may have fewer."""
    return emb(spark, d).select(
        _idiv("vec_id", 4).alias("image_id"), (F.col("vec_id") % 4).alias("tile_id"),
        _idiv("pos", 8).alias("fy"), (F.col("pos") % 8).cast("long").alias("fx"), F.col("e").alias("f"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        _idiv("vec_id", 100).alias("graph_id"), F.col("vec_id").alias("node"), "label",
        (F.col("label") % 3).alias("node_type"), doubles("embedding").alias("vec"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of the test graphs: 6 nearest by dot product inside graphs of at most
    100 nodes (fixed by the view), unordered, with a label and a score."""
    n = nodes(spark, d)
    a = n.select("graph_id", F.col("node").alias("i"), F.col("label").alias("li"), F.col("vec").alias("vi"))
    b = n.select("graph_id", F.col("node").alias("j"), F.col("label").alias("lj"), F.col("vec").alias("vj"))
    near = first_by(
        a.join(b, "graph_id").filter("i <> j").withColumn("s", dot("vi", "vj")).drop("vi", "vj"),
        ["i"], [F.col("s").desc(), F.col("j")], 6,
    )
    return near.groupBy("graph_id", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(
        F.first((F.col("li") == F.col("lj")).cast("int")).alias("true_label"),
        F.first(F.round((F.lit(1.0) + F.col("s")) / 2, 6)).alias("prob"),
    )


_V = "CAST(floor((e+0.6)*50000) AS INT) AS v"

# name -> (views it reads, SQL definition)
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "emb": ([], "SELECT vec_id, label, i-1 AS pos, CAST(embedding[i] AS DOUBLE) AS e FROM (SELECT vec_id, label, embedding, unnest(range(1,65)) AS i FROM embeddings)"),
    "pix": (["emb"], f"SELECT vec_id AS image_id, pos//8 AS y, pos%8 AS x, {_V} FROM emb"),
    "pgs": (["emb"], f"SELECT vec_id//24 AS image_id, vec_id%24 AS page, pos//8 AS y, pos%8 AS x, {_V} FROM emb"),
    "stack": (["pgs"], "SELECT image_id, page%3 AS c, page//3 AS z, y, x, v FROM pgs"),
    "mosaic": (["emb"], f"SELECT CAST(0 AS BIGINT) AS image_id, (vec_id//20)*8+pos//8 AS y, (vec_id%20)*8+pos%8 AS x, e, {_V}, e > 0.05 AS fg FROM emb"),
    "mosaics": (["emb"], f"SELECT vec_id//200 AS image_id, ((vec_id%200)//20)*8+pos//8 AS y, (vec_id%20)*8+pos%8 AS x, e, {_V}, e > 0.05 AS fg FROM emb"),
    "region": (["emb"], f"SELECT vec_id//100 AS image_id, ((vec_id%100)//10)*8+pos//8 AS y, (vec_id%10)*8+pos%8 AS x, {_V}, CASE WHEN e>0 THEN vec_id%100+1 ELSE 0 END AS frag, CASE WHEN e > 0.02*(vec_id%10) THEN (vec_id%100)//4+1 ELSE 0 END AS gt FROM emb"),
    "frags": (["region"], "SELECT image_id, frag AS label, y, x FROM region WHERE frag > 0"),
    "profile": ([], "SELECT CAST(user_id AS VARCHAR) AS label, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))/3600000000.0 AS distance, value AS intensity FROM events"),
    "runs": ([], "SELECT l_returnflag AS repeat, l_linenumber AS fold, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS INT) AS epoch, (l_extendedprice % 1000)/1000 AS auc, l_discount*10 AS f1, CASE WHEN l_tax < 0.01 THEN NULL ELSE l_tax END AS pr_auc FROM lineitem"),
    "metrics": (["runs"], "SELECT repeat, fold, epoch AS step, tag, value FROM (UNPIVOT runs ON auc, f1, pr_auc INTO NAME tag VALUE value)"),
    "bip": ([], "SELECT o_custkey AS user_id, l_partkey AS item_id, max(l_quantity)/10 AS rating FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2"),
    "cls": ([], "SELECT d.doc_id, CAST(d.n_chars AS DOUBLE)/(d.n_chars+2000) AS prob, l.quality AS truth FROM labels l JOIN documents d USING (doc_id)"),
    "files": ([], "SELECT page_id, url FROM pages"),
    "tiles": (["emb"], "SELECT vec_id//4 AS image_id, vec_id%4 AS tile_id, pos//8 AS fy, pos%8 AS fx, e AS f FROM emb"),
    "nodes": ([], "SELECT vec_id//100 AS graph_id, vec_id AS node, label, label % 3 AS node_type, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"),
    "near": (["nodes"], "SELECT * FROM (SELECT a.graph_id, a.node AS i, b.node AS j, a.label = b.label AS same, list_dot_product(a.vec, b.vec) AS s, row_number() OVER (PARTITION BY a.node ORDER BY list_dot_product(a.vec, b.vec) DESC, b.node) AS rn FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node <> b.node) WHERE rn <= 6"),
    "pairs": (["near"], "SELECT graph_id, least(i,j) AS src, greatest(i,j) AS dst, CAST(bool_or(same) AS INT) AS true_label, min(round((1+s)/2, 6)) AS prob FROM near GROUP BY 1,2,3"),
}
