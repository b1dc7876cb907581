"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are both indexed.  Vectors are dealt to the nearest of at most `cells` centres (a
farthest-point net of a bounded sample) and in each cell by hash to blocks of at most about `rows`; a
block holds a cover tree: each node has a point as its centre and a covering radius, its children are a
net of its points.  With centres p and q and radii r and s, no inner product of the two nodes exceeds
p.q + r|q| + s|p| + rs;  a pair of nodes is left out when that is below the worst k-th score of the
query node.

Every block of queries searches blocks of its own cell first, which gives each query a k-th score.
Then blocks of queries and blocks of data meet in groups: a task has the vectors of one group of each,
walks their trees together, the most promising blocks first, and keeps the k best of each query, so
vectors travel once for each group they meet and results once for each group of data.  The k best of
each query and group are merged at the end.

Scores are integers: components become floor(scale x).  Leaves that meet are compared by one product of
matrices, in single precision where no sum can reach 2^24, in double precision below 2^53; beyond,
Python integers take over.  Ties go to the smaller vec_id.  Vectors that are null, empty or hold
null or non-finite components take no part; vectors of different lengths don't meet; rows with the
query's own vec_id are not its candidates, so rows that share a vec_id are not told apart; fewer than k
candidates give fewer rows, an empty table none.  Only vec_id, embedding and the query column are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.llm.tables import written

LEAF = 256  # points compared without looking further
KIDS = 8  # children of a node at most
GROUP = 1 << 17  # rows of a group of blocks, about


class Tree:
    """A cover tree: points in `order`; node i covers order[lo[i]:hi[i]] within radius[i] of point centre[i].

    Children are numbered in a row: first[i] .. first[i] + kids[i].  Their centres are a farthest-point net: they
    lie further apart than any point lies from its nearest one.
    """

    def __init__(self, x: np.ndarray):
        lo, hi, centre, radius, first, kids = [0], [len(x)], [0], [], [], []
        self.order = np.arange(len(x))
        me = 0
        while me < len(lo):  # nodes in order of their depth
            rows = self.order[lo[me] : hi[me]].copy()
            y = x[rows]
            c = x[centre[me]]
            far = float(np.sqrt(max(((y[a : a + 1024] - c) ** 2).sum(axis=1).max() for a in range(0, len(y), 1024))))
            radius.append(far * (1 + 1e-12) + 1e-9 * (len(rows) > 1))
            first.append(len(lo))
            groups = _net(y, int(np.flatnonzero(rows == centre[me])[0])) if len(rows) > LEAF and far else []
            kids.append(len(groups))
            at = lo[me]
            for net, members in groups:
                self.order[at : at + len(members)] = rows[members]
                lo.append(at)
                hi.append(at + len(members))
                centre.append(int(rows[net]))
                at += len(members)
            me += 1
        self.lo, self.hi, self.centre, self.radius, self.first, self.kids = (np.array(z) for z in (lo, hi, centre, radius, first, kids))


def _net(y: np.ndarray, start: int) -> list[tuple[int, np.ndarray]]:
    """At most KIDS rows that lie far apart, each with the rows nearest to it."""
    norms = (y * y).sum(axis=1)

    def far(c: int) -> np.ndarray:
        return np.maximum(norms - 2 * (y @ y[c]) + norms[c], 0)

    net, d, nearest = [start], far(start), np.zeros(len(y), int)
    d[start] = 0
    while len(net) < KIDS and d.max() > 0:
        c = int(d.argmax())
        e = far(c)
        e[c] = 0
        nearest[e < d] = len(net)
        d = np.minimum(d, e)
        net.append(c)
    return [(c, np.flatnonzero(nearest == i)) for i, c in enumerate(net)] if len(net) > 1 else []


class Block:
    """Vectors in the order of their tree, with their ids; `x` in the narrowest kind that holds products exactly."""

    def __init__(self, blob: bytes):
        self.v, self.ids, self.tree = pickle.loads(blob)
        self.by = np.argsort(self.ids, kind="stable")
        wide = self.v.astype(float)
        self.most = float(np.sqrt((wide * wide).sum(axis=1)).max(initial=0))
        self.centre = wide[self.tree.centre]  # of every node
        self.norm = np.sqrt((self.centre * self.centre).sum(axis=1))

    def x(self, kind: type) -> np.ndarray:
        if self.v.dtype != kind:
            self.v = self.v.astype(kind)
        return self.v


class Best:
    """The k best (score, id) of each query: rows of a block of queries.  Scores below `least` are of no use."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least.astype(float)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, lo: int, ids: np.ndarray, by: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries from `lo` on with rows `ids`; -inf is no candidate.  `by`: the order of ids."""
        k, least = self.k, self.least[lo : lo + len(scores)]
        use = scores >= least[:, None].astype(scores.dtype)
        if np.count_nonzero(use) > 4 * k * len(scores):
            if len(ids) > k:
                least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                self.least[lo : lo + len(scores)] = least
            edge = least[:, None].astype(scores.dtype)
            tie = (scores == edge)[:, by]
            tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= k
            use = scores > edge
            use[:, by] |= tie
        r, c = np.divmod(np.flatnonzero(use), len(ids))
        s = scores[r, c]
        real = s > -np.inf
        self.add(r[real] + lo, ids[c[real]], s[real].astype(np.int64))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(rows):
            self.found.append((rows, ids, scores))
            self.held += len(rows)
            if self.held > 6 * self.k * self.queries:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores of the k best, in the order of queries and ranks."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        rows, ids, scores = (np.concatenate(z) for z in zip(*self.found, strict=True))
        rows, ids, scores, rank = ranked(rows, ids, scores, self.k)
        last = rank == self.k - 1
        np.maximum.at(self.least, rows[last], scores[last].astype(float))
        self.found, self.held = [(rows, ids, scores)], 0
        return rows, ids, scores


def ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each of `rows` by score and id, and their ranks from 0."""
    o = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[o], ids[o], scores[o]
    new = np.r_[True, rows[1:] != rows[:-1]]
    rank = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = rank < k
    return rows[keep], ids[keep], scores[keep], rank[keep]


def survivors(q: Block, c: Block, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves whose bound reaches the worst k-th score of the query leaf, and the bounds."""
    qt, ct = q.tree, c.tree

    def kept(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, s = qt.radius[a], ct.radius[b]
        apart = r * c.norm[b] + s * q.norm[a] + r * s
        bound = np.einsum("ij,ij->i", q.centre[a], c.centre[b]) + apart
        use = ~(bound + (q.norm[a] * c.norm[b] + apart) * 1e-12 + 1e-6 < worst[a])  # an overflow leaves nothing out
        return a[use], b[use], bound[use]

    out = []
    a, b, bound = kept(np.zeros(1, int), np.zeros(1, int))
    while len(a):
        q_kids, c_kids = qt.kids[a], ct.kids[b]
        ends = (q_kids == 0) & (c_kids == 0)
        out.append((a[ends], b[ends], bound[ends]))
        a, b, q_kids, c_kids = a[~ends], b[~ends], q_kids[~ends], c_kids[~ends]
        data = (c_kids > 0) & ((q_kids == 0) | (ct.radius[b] >= qt.radius[a]))
        n = np.where(data, c_kids, q_kids)
        of = np.repeat(np.arange(len(a)), n)
        kid = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a, b, data = a[of], b[of], data[of]
        a, b, bound = kept(np.where(data, a, qt.first[a] + kid), np.where(data, ct.first[b] + kid, b))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def search(q: Block, c: Block, best: Best) -> None:
    """Dual-tree search of one block of queries in one block of data."""
    qt, ct = q.tree, c.tree
    limits = np.stack([qt.lo, qt.hi], axis=1).ravel()
    worst = np.minimum.reduceat(np.r_[best.least, np.inf], limits)[::2]
    a, b, bound = survivors(q, c, worst)
    if not len(a):
        return
    if not _exact(q, c):  # too large for doubles: compare in Python's integers
        whole = np.array([[int(e) for e in r] for r in c.v], object).T
        for i, r in enumerate(q.v):
            s = np.array([int(e) for e in r], object) @ whole
            some = sorted((-int(z), int(j)) for z, j in zip(s, c.ids, strict=True) if j != q.ids[i])[: best.k]
            best.add(np.full(len(some), i), np.array([j for _, j in some], np.int64), np.array([-z for z, _ in some], np.int64))
        return
    kind = np.float32 if max(q.most * c.most, q.most, c.most) < 2**24 else np.float64
    x, y = q.x(kind), c.x(kind)

    def compare(lo: int, hi: int, cols: np.ndarray | None) -> None:
        some, ids = (y, c.ids) if cols is None else (y[cols], c.ids[cols])
        by = c.by if cols is None else np.argsort(ids, kind="stable")
        scores = x[lo:hi] @ some.T
        sorted_ids = ids[by]
        left, right = (np.searchsorted(sorted_ids, q.ids[lo:hi], side) for side in ("left", "right"))
        for r in np.flatnonzero(right > left):
            scores[r, by[left[r] : right[r]]] = -np.inf
        best.offer(lo, ids, by, scores)

    if ((qt.hi - qt.lo)[a] * (ct.hi - ct.lo)[b]).sum() >= 0.5 * len(x) * len(y):  # little is left out: all at once
        for lo in range(0, len(x), 256):
            compare(lo, min(lo + 256, len(x)), None)
        return
    o = np.lexsort((-bound, a))
    a, b = a[o], b[o]
    for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
        lo, hi = qt.lo[a[at[0]]], qt.hi[a[at[0]]]
        cols = np.concatenate([np.arange(ct.lo[k], ct.hi[k]) for k in b[at]])  # most promising first
        for k in range(0, len(cols), 4096):
            compare(lo, hi, cols[k : k + 4096])


def usable(v: str) -> Column:
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)


def _packed(x: np.ndarray, ids: np.ndarray) -> bytes:
    tree = Tree(x)
    x, ids = x[tree.order], ids[tree.order]
    place = np.empty(len(x), int)
    place[tree.order] = np.arange(len(x))
    tree.centre = place[tree.centre]
    del tree.order
    small = np.abs(x).max(initial=0) < 2**15
    return pickle.dumps((x.astype(np.int16) if small else x, ids, tree))


def _exact(q: Block, c: Block) -> bool:
    return q.most * c.most < 2**52


def _lists(found: list[tuple], kind: pa.DataType) -> pa.Array:
    values = [np.asarray(z) for z in found]
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0), kind))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, cells: int = 32, rows: int = 4096, query_rows: int = 512, sample: int = 4096, first: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query row of `vectors`
    (vec_id, embedding) with all other rows."""
    spark = vectors.sparkSession
    v = vectors.filter(usable("embedding")).select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"), is_query.alias("is_query"))
    v = written(v.filter("vec_id is not null").withColumn("dim", F.size("v")))
    chosen = v.select("dim", "v").orderBy(F.xxhash64("vec_id", F.lit(8)), "vec_id").limit(sample).toPandas()
    nets = {}
    for dim, some in chosen.groupby("dim"):
        x = np.array(some["v"].tolist(), float)
        net, d = [0], np.linalg.norm(x - x[0], axis=1)
        while len(net) < cells and d.max() > 0:
            net.append(int(d.argmax()))
            d = np.minimum(d, np.linalg.norm(x - x[net[-1]], axis=1))
        nets[int(dim)] = x[net]
    nets = spark.sparkContext.broadcast(nets)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), np.int32)
        dims = column.value_lengths().to_numpy()
        for d in np.unique(dims):
            net = nets.value.get(int(d))
            if net is not None:
                at = np.flatnonzero(dims == d)
                x = _matrix(pa.chunked_array([column.take(pa.array(at))]))
                out[at] = ((net * net).sum(axis=1) - 2 * (x @ net.T)).argmin(axis=1)
        return pa.array(out)

    dealt = v.withColumn("cell", nearest.asNondeterministic()("v"))
    dealt = written(dealt)

    def packed(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        blob = _packed(_matrix(table.column("v")), table.column("vec_id").to_numpy().astype(np.int64))
        dim, cell, part = (x.as_py() for x in keys)
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "part": pa.array([part], pa.int64()), "n": pa.array([len(table)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def blocks(of: DataFrame, most: int) -> DataFrame:
        n = of.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
        of = of.join(n, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")))
        return written(of.select("dim", "cell", "part", "vec_id", "v").groupBy("dim", "cell", "part").applyInArrow(packed, "dim int, cell int, part long, n long, blob binary"))

    data, queries = blocks(dealt, rows), blocks(dealt.filter("is_query"), query_rows)
    kind = "dim int, cell int, part long, query_id array<long>, vec_id array<long>, score array<long>, known array<double>"

    def searched(key: tuple[pa.Scalar, ...], query: pa.Table, found: pa.Table) -> pa.Table:
        """Each block of queries against the blocks of data here; what it knows already comes with it."""
        again = "known" not in query.column_names
        blocks = [Block(b.as_py()) for b in found.column("blob")]
        where = list(zip(found.column("cell").to_pylist(), found.column("part").to_pylist(), strict=True))
        out = []
        for at in range(len(query)):
            q = Block(query.column("blob")[at].as_py())
            cell, part = query.column("cell")[at].as_py(), query.column("part")[at].as_py()
            known = np.full(len(q.ids), -np.inf) if again else np.asarray(query.column("known")[at].values)
            best = Best(len(q.ids), k, known)
            # pairs of the first turn are not compared again
            some = [c for c, (there, i) in zip(blocks, where, strict=True) if again or there != cell or i >= first]
            hope = [float(q.centre[0] @ c.centre[0] + c.tree.radius[0] * q.norm[0]) for c in some]
            for i in np.argsort(hope)[::-1]:
                search(q, some[i], best)
            r, ids, scores = best.settle()
            out.append((cell, part, q.ids[r], ids, scores, best.least))
        cell, part, query_id, ids, scores, least = zip(*out, strict=True) if out else ((),) * 6
        return pa.table({"dim": pa.array([key[0].as_py()] * len(out), pa.int32()), "cell": pa.array(cell, pa.int32()), "part": pa.array(part, pa.int64()), "query_id": _lists(query_id, pa.int64()), "vec_id": _lists(ids, pa.int64()), "score": _lists(scores, pa.int64()), "known": _lists(least, pa.float64())})

    def met(query: DataFrame, found: DataFrame, by: list[str], tasks: int) -> DataFrame:
        # few keys with much work each: dealt over more partitions than there are keys, so that few share one
        query, found = (x.repartition(max(1, tasks), *by) for x in (query, found))
        return query.groupBy(*by).cogroup(found.groupBy(*by)).applyInArrow(searched, kind)

    n = dealt.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_query"), 1)).alias("queries")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = data.filter(F.col("part") < first).join(queries.select("dim", "cell", F.col("part").alias("q_part")), ["dim", "cell"])
    start = written(met(queries.withColumn("q_part", F.col("part")), own, ["dim", "cell", "q_part"], 4 * partitions))

    q_groups = max(1, -(-n["queries"] // GROUP))
    d_groups = max(1, -(-n["rows"] // GROUP), min(-(-partitions // q_groups), -(-n["rows"] // rows)))

    def group(groups: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("cell", "part", F.lit(seed)), F.lit(groups)).cast("int")

    def each(groups: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    q = queries.join(start.select("dim", "cell", "part", "known"), ["dim", "cell", "part"])
    q = q.withColumn("q_group", group(q_groups, 5)).withColumn("d_group", each(d_groups))
    d = data.withColumn("d_group", group(d_groups, 6)).withColumn("q_group", each(q_groups))
    rest = written(met(q, d, ["dim", "q_group", "d_group"], 4 * q_groups * d_groups))

    def merged(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        some = [pa.chunked_array(table.column(c)).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("query_id", "vec_id", "score")]
        query_id, ids, scores, _ = ranked(*some, k)
        return pa.table({"query_id": query_id, "vec_id": ids, "score": scores})

    parts = start.unionByName(rest).select("dim", "cell", "part", "query_id", "vec_id", "score").groupBy("dim", "cell", "part")
    every = parts.applyInArrow(merged, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
