"""Operators on vectors against brute force and on odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import covertree, forest
from gridloom.llm.tables import components, sieve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 16)) * 0.12, rng.normal(size=(100, 16))])
    x[510:520] = x[500]
    rows = [(i, [float(np.float32(e)) for e in v], int(i % 3)) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [nan] * 16, 1), (903, [1.0] * 15 + [None], 1), (904, [inf] * 16, 1), (905, rows[0][1], None), (906, [], 0), (907, [1.0, 2.0], 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, point string").repartition(3).cache()


def usable(r):
    return r["embedding"] and all(e is not None and np.isfinite(e) for e in r["embedding"])


@pytest.mark.parametrize("block", [2048, 16])
def test_forest(vectors, block):
    rows = vectors.collect()
    good = [r for r in rows if usable(r) and any(r["embedding"]) and r["label"] is not None and len(r["embedding"]) == 16]
    x = np.array([r["embedding"] for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r["label"] for r in good])[:, None] == np.array([r["label"] for r in good]))
    np.fill_diagonal(near, False)
    want = dict(zip((r["vec_id"] for r in good), near.sum(axis=1).tolist(), strict=True))
    got = {r["vec_id"]: r for r in forest.near_links(vectors, leaf=40, block=block).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in want)
    assert found >= 0.95 * sum(want.values()) > 200 and all(got[i]["n_links"] <= n for i, n in want.items())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 908))
    assert all(r["kept"] == (r["component_id"] == i) and r["component_id"] <= i for i, r in got.items())


@pytest.fixture(scope="module")
def wide_vectors(spark):
    """40 components; ten labels, one of them large, with a crowd of near copies, equal vectors and pairs close to the threshold."""
    rng = np.random.default_rng(23)
    x = rng.normal(size=(1500, 40))
    x[:300] = x[0] + rng.normal(size=(300, 40)) * 0.1
    x[300:320] = x[0]
    for i in range(400, 800, 2):
        a, b = x[i] / np.linalg.norm(x[i]), x[i + 1] - (x[i + 1] @ x[i]) / (x[i] @ x[i]) * x[i]
        x[i + 1] = rng.uniform(0.92, 0.94) * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
    label = np.where(np.arange(1500) < 900, 0, np.arange(1500) % 10)
    return x, label, spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(3).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_forest_links_and_components(wide_vectors):
    x, label, d = wide_vectors
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while (new := np.minimum(least, np.where(near, least, len(x)).min(axis=1))).tolist() != least.tolist():
        least = new
    got = rows_of(forest.near_links(d, leaf=10, sample=400))
    assert got == [(i, int(n), int(c), bool(c == i)) for i, (n, c) in enumerate(zip(near.sum(axis=1), least, strict=True))]


def test_forest_in_pieces_and_branches(wide_vectors):
    """Branches, pieces of branches and blocks only deal out the work."""
    d = wide_vectors[2]
    whole = rows_of(forest.near_links(d, leaf=10, sample=400, spill=0.02, trees=3))
    assert rows_of(forest.near_links(d, leaf=10, sample=400, spill=0.02, trees=3, slab=100, block=64)) == whole
    one = d.withColumn("label", F.lit(1))
    assert rows_of(forest.near_links(one, leaf=10, sample=400, spill=0.02, trees=3, slab=60)) == rows_of(forest.near_links(one, leaf=10, sample=400, spill=0.02, trees=3))


def test_vectors_travel_once_a_tree(wide_vectors, monkeypatch):
    """Not once for every leaf that they reach."""
    tables = []
    monkeypatch.setattr(forest, "written", lambda df, f=forest.written: tables.append(f(df)) or tables[-1])
    forest.near_links(wide_vectors[2], leaf=10, sample=400)
    lists = [(t, c) for t in tables for c, kind in t.dtypes if kind == "array<int>"]
    (t, c), points = lists[0], lists[0][0].count()
    assert len(lists) == 1 and t.agg(F.sum(F.size(c))).first()[0] <= 8 * points


def test_top_k(vectors):
    rows = [r for r in vectors.collect() if usable(r)]
    v = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)) for r in rows}
    want = Counter()
    for q in v:
        if q % 5 == 0:
            s = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:7]
            want.update((q, k + 1, c, -z) for k, (z, c) in enumerate(s))
    got = Counter(tuple(r) for r in covertree.top_k(vectors, F.col("vec_id") % 5 == 0, k=7, rows=64, query_rows=16, cells=4).collect())
    assert got == want


def test_top_k_of_large_components(spark):
    """Products beyond 2^53 are exact."""
    rows = [(i, [float(2**29 + 7 * i), float(2**28 - 3 * i), 1.0]) for i in range(20)]
    want = sorted((-sum(int(a) * int(b) for a, b in zip(rows[0][1], rows[c][1], strict=True)), c) for c in range(1, 20))[:3]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.top_k(d, F.col("vec_id") == 0, k=3, scale=1).orderBy("rank").collect()
    assert [(-r["score"], r["vec_id"]) for r in got] == want


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_k_of_deep_trees(spark, spread):
    """Blocks of many leaves, clustered or not, in several groups; equal vectors tie."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 8))
    x = np.floor(64 * (base[rng.integers(0, 12, 3000)] + spread * rng.normal(size=(3000, 8))))
    x[2000:2400] = x[1999]
    d = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in covertree.top_k(d, F.col("vec_id") % 3 == 0, cells=2, rows=1024).collect())
    want = Counter()
    for q in range(0, 3000, 3):
        s = x @ x[q]
        s[q] = -np.inf
        want.update((q, k + 1, int(c), int(s[c])) for k, c in enumerate(np.lexsort((np.arange(3000), -s))[:20]))
    assert got == want


def test_cover_trees_hold_every_point():
    """Each point lies in one leaf, within the radius of every node above it; children share out their node's points."""
    x = np.random.default_rng(5).normal(size=(2000, 6)) * 100
    t = covertree.Tree(x)
    assert sorted(t.order) == list(range(2000)) and len(t.lo) > 8
    for i in range(len(t.lo)):
        d = np.linalg.norm(x[t.order[t.lo[i] : t.hi[i]]] - x[t.centre[i]], axis=1)
        assert d.max() <= t.radius[i]
        kids = np.arange(t.first[i], t.first[i] + t.kids[i])
        assert not len(kids) or ((t.hi - t.lo)[kids].sum() == t.hi[i] - t.lo[i] and (t.lo[kids[1:]] == t.hi[kids[:-1]]).all())


def test_top_k_of_mixed_sizes(spark):
    """Zero, small and huge vectors in one block: none is rounded for the sake of another."""
    rows = [(i, [float(e) for e in v]) for i, v in enumerate([[0, 0], [0, 0], [1, 2], [3, -1], [2**30 + 1, 5], [2**30 + 3, 7], [2**25 + 1, 1]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter()
    for q, a in rows:
        s = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q)
        want.update((q, k + 1, c, -z) for k, (z, c) in enumerate(s[:4]))
    assert Counter(tuple(r) for r in covertree.top_k(d, F.lit(True), k=4, scale=1, cells=1).collect()) == want


def test_even_directions_make_few_nodes():
    """Points that all lie far apart don't become a node each, whose pairs would be walked one by one."""
    t = covertree.Tree(np.floor(64 * np.random.default_rng(2).normal(size=(2048, 64)) / 8))
    assert len(t.lo) <= 128


def test_few_candidates_and_empty(vectors):
    two = vectors.filter("vec_id < 2")
    assert covertree.top_k(two, F.col("vec_id") == 0).count() == 1
    assert covertree.top_k(vectors.filter("false"), F.col("vec_id") == 0).count() == 0
    assert forest.near_links(vectors.filter("false")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(300) if i % 100] + [(5, 5)]
    r = components(spark.createDataFrame(links, "a long, b long")).collect()
    by = {}
    for x in r:
        by.setdefault(x["root"], set()).add(x["node"])
    assert sorted(map(len, by.values())) == [100, 100, 100]


def test_sieve(spark):
    keys = spark.range(0, 3000, 3).toDF("k")
    passes = sieve(keys)
    n = spark.range(3000).filter(passes(F.col("id")))
    assert n.filter("id % 3 = 0").count() == 1000 and n.count() < 1010
