"""Exact nearest vectors inside graphs, block against block.

Vectors of a graph go to their nearest pivot and from there into blocks of bounded size, one row a
block.  What travels between blocks are centres and radii first: the triangle inequality gives the
smallest distance two blocks can have, and a pair of blocks meets only while that may be among the k
best of one of its vectors.  A pair meets once, for both sides, and gives ids and distances only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import first_by, hash_rank
from gridloom.functions.rounds import materialize

BLOCK = 512
PIVOTS = 4  # for as many vectors as a block holds
_FOUND = "array<struct<i: long, j: long, d: double>>"


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """The matrix of each row of a column of lists of equally long lists."""
    return [np.array(x.as_py(), float) for x in column]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by differences, a few rows of a at a time."""
    step = max(1, (1 << 20) // max(b.size, 1))
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((d * d).sum(axis=2))
    return np.round(out, 9)


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(graph_id, block, nodes, vecs, centre, radius, n): the vectors of every graph in blocks of about `size`."""
    v = with_stats(vectors.select("graph_id", "node", "vec"), ["graph_id"], _n=F.count(F.lit(1)))
    v = v.withColumn("_parts", F.ceil(F.col("_n") / size))
    pivots = hash_rank(v, ["graph_id"], "node", 1).filter(F.col("rank") <= PIVOTS * F.col("_parts"))
    pivots = pivots.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).alias("p")).select("graph_id", F.col("p.vec").alias("pivots"))
    chunk = v.withColumn("_c", F.pmod(F.xxhash64("node"), F.col("_parts"))).groupBy("graph_id", "_c").agg(F.collect_list(F.struct("node", "vec")).alias("m"))

    def assigned(vecs: pa.Array, pivots: pa.Array) -> pa.Array:
        out = []
        for x, p in zip(_matrix(vecs), _matrix(pivots), strict=True):
            d = _distances(x, p)
            at = d.argmin(axis=1)
            out.append([{"cell": int(c), "d": float(d[i, c])} for i, c in enumerate(at)])
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("d", pa.float64())])))

    near = F.arrow_udf(assigned, ArrayType(StructType([StructField("cell", LongType()), StructField("d", DoubleType())])))
    c = chunk.join(pivots, "graph_id").select("graph_id", "pivots", F.col("m.node").alias("nodes"), F.col("m.vec").alias("vecs"), near("m.vec", "pivots").alias("near"))
    c = c.select("graph_id", "pivots", F.explode(F.arrays_zip("nodes", "vecs", "near")).alias("x"))
    c = c.select("graph_id", F.col("x.near.cell").alias("cell"), F.col("x.near.d").alias("d"), F.col("x.nodes").alias("node"), F.col("x.vecs").alias("vec"), F.get("pivots", F.col("x.near.cell").cast("int")).alias("centre"))
    c = with_stats(c, ["graph_id", "cell"], _n=F.count(F.lit(1)))
    c = c.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("_n") / size)))
    b = c.groupBy("graph_id", "cell", "part").agg(F.collect_list(F.struct("node", "vec")).alias("m"), F.first("centre").alias("centre"), F.max("d").alias("radius"), F.count(F.lit(1)).alias("n"))
    out, _ = materialize(b.select("graph_id", F.concat_ws("-", "cell", "part").alias("block"), F.col("m.node").alias("nodes"), F.col("m.vec").alias("vecs"), "centre", "radius", "n"))
    return out


def block_pairs(b: DataFrame) -> DataFrame:
    """(graph_id, a, b, low): unordered pairs of blocks and the smallest distance between their vectors."""
    side = b.select("graph_id", "block", "centre", "radius")
    one, two = (side.select("graph_id", F.col("block").alias(s), F.col("centre").alias(f"{s}c"), F.col("radius").alias(f"{s}r")) for s in "ab")
    gap = F.sqrt(F.aggregate(F.zip_with("ac", "bc", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    p = one.join(two, "graph_id").filter("a <= b")
    return p.select("graph_id", "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(gap - F.col("ar") - F.col("br"), F.lit(0.0))).alias("low"), (F.col("a") == F.col("b")).alias("own"))


def _met(pairs: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(graph_id, i, j, d): of every vector of both blocks its k best in the other block."""

    def best(ids: np.ndarray, others: np.ndarray, d: np.ndarray, out: list, same: bool) -> None:
        order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)[:, : k + 1]
        for r, row in enumerate(order):
            use = [c for c in row if not same or others[c] != ids[r]][:k]
            out += [{"i": int(ids[r]), "j": int(others[c]), "d": float(d[r, c])} for c in use]

    def compared(a_ids: pa.Array, a_vecs: pa.Array, b_ids: pa.Array, b_vecs: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for i, x, j, y, same in zip(a_ids, _matrix(a_vecs), b_ids, _matrix(b_vecs), own.to_pylist(), strict=True):
            i, j, out = np.array(i.as_py()), np.array(j.as_py()), []
            d = _distances(x, y)
            best(i, j, d, out, same)
            if not same:
                best(j, i, d.T, out, False)
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])))

    meet = F.arrow_udf(compared, _FOUND).asNondeterministic()
    j = pairs
    for s in "ab":
        j = j.join(b.select("graph_id", F.col("block").alias(s), F.col("nodes").alias(f"{s}n"), F.col("vecs").alias(f"{s}v")), ["graph_id", s])
    return j.select("graph_id", F.explode(meet("an", "av", "bn", "bv", "own")).alias("x")).select("graph_id", "x.*")


def nearest_vectors(vectors: DataFrame, k: int, size: int = BLOCK, first: int = 2) -> DataFrame:
    """(graph_id, i, j, d): the k nearest other vectors of each (graph_id, node, vec); ties to the smaller node."""
    b = blocks(vectors, size)
    p, _ = materialize(block_pairs(b))
    turn = W.partitionBy("graph_id", "a").orderBy(F.col("own").desc(), "low", "b")
    p, _ = materialize(p.withColumn("turn", F.row_number().over(turn)))
    start, _ = materialize(_met(p.filter(F.col("turn") <= 1 + first), b, k))
    order = [F.col("d"), F.col("j")]
    top, _ = materialize(first_by(start, ["graph_id", "i"], order, k))
    bound = top.groupBy("graph_id", F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("d"))
    worst = b.select("graph_id", "block", F.explode("nodes").alias("node")).join(bound, ["graph_id", "node"], "left")
    worst = worst.groupBy("graph_id", "block").agg(F.max(F.when(F.col("c") >= k, F.col("d")).otherwise(F.lit(float("inf")))).alias("w"))
    rest = p.filter(F.col("turn") > 1 + first)
    for s in "ab":
        rest = rest.join(worst.withColumnsRenamed({"block": s, "w": f"{s}w"}), ["graph_id", s])
    rest = rest.filter(F.col("low") <= F.greatest("aw", "bw") + 1e-8)
    return first_by(top.unionByName(_met(rest, b, k)), ["graph_id", "i"], order, k).select("graph_id", "i", "j", "d")
