"""Edge labels, directions and degrees of candidate graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def both_directions(pairs: DataFrame, swap: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Add the reverse of every pair; column pairs in `swap` trade places on the reverse row."""
    other = {"src": "dst", "dst": "src"}
    for a, b in swap:
        other[a], other[b] = b, a
    rev = pairs.select(*[F.col(other.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(rev)


def to_undirected(edges: DataFrame) -> DataFrame:
    """Both directions of edges with src < dst; the two endpoint angles swap on the reverse."""
    bad = F.raise_error(F.lit("edges must have src < dst"))
    checked = edges.withColumn("src", F.when(F.col("src") <= F.col("dst"), F.col("src")).otherwise(bad.cast("bigint")))
    return both_directions(checked, (("node1_angle_diff", "node2_angle_diff"),))


def edge_labels(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """1 when the unordered pair is listed as true."""
    t = truth.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")).distinct().withColumn("_t", F.lit(1))
    c = cands.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return c.join(t, ["_a", "_b"], "left").withColumn("edge_label", F.coalesce("_t", F.lit(0))).drop("_a", "_b", "_t")


def edge_labels_listed(cands: DataFrame, flags: DataFrame) -> DataFrame:
    """Labels from a 0/1 list: `cands` has (graph_id, pos), `flags` one `labels` array per graph, whose place
    pos (from 0) is the label of that candidate.  A list of another length than its graph's candidates
    stops the query."""
    f = flags.select("graph_id", F.col("labels").alias("_l"))
    n = cands.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).join(f, "graph_id", "full")
    bad = F.raise_error(F.lit("a label list must have one 0 or 1 for every candidate of its graph")).cast("array<int>")
    fits = (F.size("_l") == F.col("_n")) & F.forall("_l", lambda x: x.isin(0, 1))
    n = n.select("graph_id", F.when(F.coalesce(fits, F.lit(False)), F.col("_l").cast("array<int>")).otherwise(bad).alias("_l"))
    return cands.join(n, "graph_id").withColumn("edge_label", F.get("_l", F.col("pos").cast("int"))).drop("_l")


def trim_long_negatives(edges: DataFrame, length: str, limit: float, label: str = "true_label") -> DataFrame:
    return edges.filter((F.col(label) != 0) | (F.col(length) <= limit))


def true_degree(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positive undirected degree of every node, 0 for isolated ones."""
    ends = pairs.filter("true_label = 1").select(F.explode(F.array("src", "dst")).alias("node"))
    deg = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def recall_ceiling(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs per graph and overall (graph NULL), and how many are not candidates."""
    c = cands.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("_c", F.lit(1))
    t = truth.join(c, ["graph_id", "src", "dst"], "left")
    return t.rollup("graph_id").agg(F.count("*").alias("true_pairs"), F.sum(F.when(F.col("_c").isNull(), 1).otherwise(0)).alias("missed"))


def negatives_by_type_pair(pairs: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    """Negative edges by unordered class pair, per graph and overall, with totals and shares."""
    a = types.select(F.col("node").alias("src"), F.col("type_name").alias("ta"))
    b = types.select(F.col("node").alias("dst"), F.col("type_name").alias("tb"))
    e = pairs.filter("true_label = 0").join(a, "src").join(b, "dst")
    e = e.withColumn("pair", F.concat_ws("_", F.least("ta", "tb"), F.greatest("ta", "tb")))
    cols = [F.count_if(F.col("pair") == n).alias(n) for n in names]
    g = e.rollup("graph_id").agg(*cols, F.count("*").alias("total"))
    return g.select("graph_id", "total", *names, *[(100.0 * F.col(n) / F.col("total")).alias(f"{n}_pct") for n in names])
