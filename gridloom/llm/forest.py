"""Near-duplicate vectors of one label by a forest of random-projection trees.

Every tree splits space again and again: a node takes a seeded random direction and cuts at the median
projection of the sample that reached it; a vector within `spill` of the cut goes to both sides.  The
splits are fitted on a bounded, seeded sample of unit vectors (at most `sample` in all, by smallest
hash), so the forest's size is bounded too; every vector is indexed, by walking down all trees, as deep
as leaves of about `leaf` vectors of a label ask for and the sample allows.  Vectors that meet in a leaf are
compared in double precision, so nothing below the threshold is ever linked.

Vectors don't travel for every leaf but for a tree, or a branch of it where a label has more than about
`slab` of them: a task walks on from there and compares leaf by leaf, in single precision first and in double
precision wherever rounding might decide.  A pair that meets in several leaves is counted in the first of them
only; the earlier trees are walked again for points that are in pairs, so links are counted without listing pairs: a task
gives each vector's number of links and a spanning set of links.  Equal vectors of a label are one point
with a multiplicity before anything meets.  A branch that outgrows its slab, such as a group of near copies, is
cut into pieces by hash, each pair of pieces a task's work of its own, so it is only ever held in pieces; leaves are
compared in blocks of `block` points.

Defined cases: a null label, null, zero or empty vectors, null or non-finite components: no link, the
vector is its own component.  Vectors of different lengths never link.  An empty table gives an empty
result; only vec_id, label and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.tables import components, written


def usable(v: Column | str) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    x = F.col(v) if isinstance(v, str) else v
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def _matrix(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(x: np.ndarray, leaf: int, seed: int) -> list[tuple]:
    """One tree on a sample: a list of (direction, cut, left, right, share of the sample) with negative numbers for leaves."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) <= leaf:
            leaves += 1
            return -leaves
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        p = x[rows] @ direction
        cut = float(np.median(p))
        if not (p > cut).any():
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        nodes[at] = (direction, cut, split(rows[p <= cut]), split(rows[p > cut]), len(rows) / len(x))
        return at

    root = split(np.arange(len(x)))
    return [(None, 0.0, root, root, 1.0)] if root < 0 else nodes


def walk(tree: list[tuple], x: np.ndarray, spill: float, start: int = 0, enough: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves that they reach from a node on, as numbers from -1 down; a node with a share of at
    most `enough` ends the walk too.  A row's way does not depend on the rows beside it."""
    rows_out, to_out = [np.empty(0, int)], [np.empty(0, int)]
    todo = [(start, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0 or tree[at][4] <= enough:
            rows_out.append(rows)
            to_out.append(np.full(len(rows), at))
            continue
        direction, cut, left, right, _ = tree[at]
        if direction is None:
            todo.append((left, rows))
            continue
        p = np.einsum("ij,j->i", x[rows], direction)
        todo += [(to, some) for to, some in ((left, rows[p <= cut + spill]), (right, rows[p > cut - spill])) if len(some)]
    return np.concatenate(rows_out), np.concatenate(to_out)


def _leaf_bits(tree: list[tuple], x: np.ndarray, spill: float) -> np.ndarray:
    """The leaves that each row reaches, as bits of 64-bit words."""
    rows, at = walk(tree, x, spill)
    leaf = -at - 1
    bits = np.zeros((len(x), sum(to < 0 for node in tree for to in node[2:4]) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (rows, leaf // 64), np.uint64(1) << (leaf % 64).astype(np.uint64))
    return bits


def _first(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bit that rows a and b both have, -1 if there is none."""
    out = np.full(len(a), -1)
    for k in range(0, len(a), 50_000):
        both = bits[a[k : k + 50_000]] & bits[b[k : k + 50_000]]
        word = (both != 0).argmax(axis=1)
        w = both[np.arange(len(both)), word]
        low = np.log2((w & (~w + np.uint64(1))).astype(float), where=w != 0, out=np.zeros(len(w)))
        out[k : k + 50_000] = np.where(w != 0, word * 64 + low.astype(int), -1)
    return out


def _shadow(x: np.ndarray) -> np.ndarray | None:
    """Fewer columns than unit vectors have, whose products are never below theirs: some directions, and the length of the rest."""
    dim = x.shape[1]
    if dim < 32:
        return None
    some = x @ np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, 3 * dim // 8)))[0]
    return np.column_stack([some, np.sqrt(np.maximum(1 - (some * some).sum(axis=1), 0))]).astype(np.float32)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n points' components under the links a-b."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if np.array_equal(new, up):
            return up
        up = new


def near_links(vectors: DataFrame, threshold: float = 0.93, trees: int = 8, leaf: int = 500, sample: int = 8192, spill: float = 0.05, block: int = 2048, seed: int = 3, slab: int = 1 << 16) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    good = vectors.filter(F.col("label").isNotNull() & usable("embedding"))
    wide = F.transform("embedding", lambda e: e.cast("double"))
    members = written(good.select("vec_id", F.xxhash64("label", wide).alias("point"), "label", F.col("embedding").alias("v")))
    points = members.groupBy("point").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    points = written(points.withColumn("dim", F.size("v")))

    size = points.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    chosen = points.select("point", "v", "dim").orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(sample).toPandas()
    forests = {}
    for dim, some in chosen.groupby("dim"):
        x = _unit(np.array(some["v"].tolist(), float))
        least = max(8, min(sample, sample * leaf * size["labels"] // max(size["n"], 1)))
        forests[int(dim)] = [grow(x, least, seed + 1000 * t) for t in range(trees)]
    forests = spark.sparkContext.broadcast(forests)
    alone = [(None, 0.0, -1, -1, 1.0)]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = max(1, size["labels"])
    slab = min(slab, max(min(slab, 4096), size["n"] * trees // partitions))
    together = max(1, min(trees, labels * trees // (4 * partitions)))  # trees that one journey serves, where labels alone keep all tasks busy

    @F.arrow_udf("array<int>")
    def branches(v: pa.Array, many: pa.Array) -> pa.Array:
        """Where a vector travels: tree << 20 | node, or leaf under another bit."""
        dims, many = v.value_lengths().to_numpy(), many.to_numpy()
        key, row = [np.empty(0, int)], [np.empty(0, int)]
        whole = np.flatnonzero(many <= slab)
        for t in range(0, trees, together):
            key.append(np.full(len(whole), t << 20))
            row.append(whole)
        far = np.flatnonzero(many > slab)
        for d, n in np.unique(np.stack([dims[far], many[far]], axis=1), axis=0).tolist():
            rows = far[(dims[far] == d) & (many[far] == n)]
            x = _unit(_matrix(v.take(pa.array(rows))))
            for t in range(trees):
                some, to = walk(forests.value.get(d, [alone] * trees)[t], x, spill, enough=slab / n)
                key.append(t << 20 | np.where(to < 0, 1 << 19 | -to, to))
                row.append(rows[some])
        key, row = np.concatenate(key), np.concatenate(row)
        o = np.lexsort((key, row))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[o], np.arange(len(v) + 1)), pa.int32()), pa.array(key[o], pa.int32()))

    label_size = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("many"))
    placed = written(points.join(label_size, ["label", "dim"]).select("label", "dim", "point", "v", "copies", branches.asNondeterministic()("v", "many").alias("branches")))
    placed = placed.withColumn("branch", F.explode("branches")).drop("branches")
    key = ["label", "dim", "branch"]
    pieces = placed.groupBy(*key).agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / slab)).cast("int").alias("pieces"))
    met = placed.join(pieces, key).withColumn("mine", F.pmod(F.xxhash64("point", F.lit(9)), F.col("pieces").cast("long")).cast("int"))
    other = F.sequence(F.lit(0), F.col("pieces") - 1)
    met = met.withColumn("with", F.explode(other)).withColumn("lo", F.least("mine", "with")).withColumn("hi", F.greatest("mine", "with"))

    def compared(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, branch, lo, hi = (k.as_py() for k in keys[1:])
        table = table.sort_by("point")
        raw = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        ids, copies, mine = (table.column(c).to_numpy() for c in ("point", "copies", "mine"))
        x = _unit(raw.astype(float))
        y = x.astype(np.float32)
        near = (dim + 8) * 2.0**-23  # no product in single precision is further from the one in double precision
        short = _shadow(x)
        forest = forests.value.get(dim, [alone] * trees)
        tree, node = branch >> 20, branch & (1 << 20) - 1
        count, up = np.zeros(len(ids), np.int64), [np.empty((2, 0), int)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def counted(t: int) -> None:
            """The pairs found so far in a tree, each at the first leaf where it meets."""
            nonlocal held
            if not found:
                return
            i, j, here = (np.concatenate(z) for z in zip(*found, strict=True))
            found.clear()
            held = 0
            for u in range(t + 1):
                if not len(i):
                    return
                paired = np.zeros(len(ids), bool)
                paired[i] = paired[j] = True
                place = np.cumsum(paired) - 1
                first = _first(_leaf_bits(forest[u], x[paired], spill), place[i], place[j])
                keep = first == here if u == t else first < 0
                i, j, here = i[keep], j[keep], here[keep]
            count[:] += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            root = _roots(i, j, len(ids))
            some = np.flatnonzero(root != np.arange(len(ids)))
            up.append(np.stack([some, root[some]]))

        def met_in(t: int, leaf: int, a: np.ndarray, b: np.ndarray, same: bool) -> None:
            """Pairs of the rows a and b of a leaf, block by block."""
            nonlocal held
            for p in range(0, len(a), step := min(block, 256)):  # products that stay in a core's cache
                for q in range(p if same else 0, len(b), block):
                    i, j = a[p : p + step], b[q : q + block]
                    r = None
                    if short is not None:
                        some = np.flatnonzero(short[i] @ short[j].T >= threshold - near)
                        if len(some) <= len(i) * len(j) // 100:
                            r, c = np.divmod(some, len(j))
                            s = np.einsum("ij,ij->i", y[i[r]], y[j[c]])
                    if r is None:
                        s = y[i] @ y[j].T
                        r, c = np.divmod(np.flatnonzero(s >= threshold - near), len(j))
                        s = s[r, c]
                    use = s >= threshold - near
                    if same:
                        use &= p + r < q + c
                    r, c, s = r[use], c[use], s[use]
                    sure = s >= threshold + near
                    for z in np.split(np.flatnonzero(~sure), range(20_000, len(s), 20_000)):
                        sure[z] = np.einsum("ij,ij->i", x[i[r[z]]], x[j[c[z]]]) >= threshold
                    if sure.any():
                        found.append((i[r[sure]], j[c[sure]], np.full(sure.sum(), leaf)))
                        held += len(found[-1][0])
                        if held > 500_000:
                            counted(t)

        for t in range(tree, min(trees, tree + together) if node == 0 and together > 1 else tree + 1):
            rows, at = walk(forest[t], x, spill, -(node & (1 << 19) - 1) if node >> 19 else node)
            o = np.lexsort((rows, -at))
            for some in np.split(o, np.flatnonzero(np.diff(at[o])) + 1):
                if len(some):
                    leaf, some = int(-at[some[0]] - 1), rows[some]
                    if lo == hi:
                        met_in(t, leaf, some, some, True)
                    else:  # pairs inside a piece are met where the piece is alone
                        met_in(t, leaf, some[mine[some] == lo], some[mine[some] == hi], False)
            counted(t)
        root = _roots(*np.concatenate(up, axis=1), len(ids))
        some = count > 0
        return pa.table({"a": ids[some], "b": ids[root[some]], "n": count[some]})

    # few keys with much work each: dealt over more partitions than there are keys, so that few share one
    by = [*key, "lo", "hi"]
    met = met.select(*by, "point", "v", "copies", "mine").repartition(max(partitions, min(2 * labels * -(-trees // together), 2000)), *by)
    found = written(met.groupBy(*by).applyInArrow(compared, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "point")
    root = components(found.select("a", "b")).toDF("point", "root")
    p = points.select("point", "copies", "least").join(links, "point", "left").join(root, "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = p.groupBy("root").agg(F.min("least").alias("component_id"))
    p = p.join(least, "root").select("point", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    some = members.select("vec_id", "point").join(p, "point").select("vec_id", "n_links", "component_id")
    none = vectors.filter(F.col("label").isNull() | ~usable("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = some.select(F.col("vec_id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id")).unionByName(none.withColumn("vec_id", F.col("vec_id").cast("long")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
