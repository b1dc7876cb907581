"""Findings of the third round: odd last images, ties, and steps that must not grow faster than their input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import TABLES, compare

import __spark_entry__ as entry
from gridloom.operators import matching as M

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def last_image(spark, tmp_path_factory):
    """Tables whose last image holds one vector, so one cell."""
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT row_number() OVER (ORDER BY k, vec_id) - 1 AS vec_id, embedding, label FROM '{DIR}/embeddings.parquet', range(11) t(k) QUALIFY row_number() OVER (ORDER BY k, vec_id) <= 201) TO '{d}/embeddings.parquet'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d if t == 'embeddings' else DIR}/{t}.parquet'")
    return str(d), c


def test_e6_keeps_cells_without_a_cut(spark, last_image):
    d, con = last_image
    state, info, _, _ = compare(spark, con, "e6", entry.queries()["e6_compare_metrics"], entry.oracle_sql()["e6_compare_metrics"], d)
    assert state == "ok", info


def test_e6_ties_go_to_the_smaller_value(spark):
    """Equally spaced values have two cuts of equal error; values an ulp apart are one."""
    rows = [(i, n, v) for i in range(40) for n, v in enumerate((0.1 * (i + 1), 0.1 * (i + 1) + 0.3, 0.1 * (i + 1) + 0.6, 0.3 + 0.1 * (i + 1)))]
    r = M.compare_metrics(spark.createDataFrame(rows, "image_id long, label long, axis_ratio double"), ["axis_ratio"])
    got = {(x.image_id, x.label): x.cell_type for x in r.collect()}
    assert len(got) == 160
    for i in range(40):  # 0, 3, 3, 6: one or three below is the same
        assert [got[i, n] for n in range(4)] == ["epithelial", "hyphal", "hyphal", "hyphal"]


def written_in_shuffles(spark, run) -> tuple[int, int]:
    """Records that `run` writes into shuffles, and the largest mean memory of a stage's tasks, with no joins by broadcast."""
    store, key = spark.sparkContext._jsc.sc().statusStore(), "spark.sql.autoBroadcastJoinThreshold"
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages() -> dict:
        got = store.stageList(None, False, False, none, None)
        got = [got.apply(i) for i in range(got.size())]
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.peakExecutionMemory() // max(s.numTasks(), 1)) for s in got}

    before, old = stages(), spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        run()
    finally:
        spark.conf.set(key, old)
    new = [v for k, v in stages().items() if k not in before]
    return sum(r for r, _ in new), max(m for _, m in new)


def test_outline_points_travel_once(spark):
    """a region with 60 neighbours sends its outline once, not once for each."""
    from gridloom.operators import candidates as C

    n = 60
    px = [(0, k + 1, y, k * 9 + x) for k in range(n) for y in range(8) for x in range(8) if y in (0, 7) or x in (0, 7)]
    b = spark.createDataFrame(px, "image_id long, label long, y long, x long")
    pairs = spark.createDataFrame([(0, i + 1, j + 1) for i in range(n) for j in range(i + 1, n)], "image_id long, i long, j long")
    got = []
    records, _ = written_in_shuffles(spark, lambda: got.extend(C.boundary_distance(pairs, b).collect()))
    assert len(got) == n * (n - 1) // 2
    assert all((r.dist, r.iy, r.ix, r.jy, r.jx) == ((r.j - r.i) * 9 - 7, 0, (r.i - 1) * 9 + 7, 0, (r.j - 1) * 9) for r in got)
    assert records < 25 * len(pairs.collect())


def test_samples_of_segments_are_taken_at_their_tiles(spark):
    """F16, F24: a segment sends stretches to tiles and receives one value a sample, not four a parallel."""
    import math

    from gridloom.operators import filters as N

    h, w = 40, 70
    px = spark.createDataFrame([(0, y, x, (y * 7 + x * 3) % 11) for y in range(h) for x in range(w) if (y, x) != (20, 20)], "image_id long, y long, x long, v int")
    seg = [(0, k, k % 37 + 0.25, -2.0 + k % 5, (k * 5) % 38 + 0.5, 66.5 - k % 9) for k in range(120)] + [(0, 900, 3.0, 4.0, 3.0, 4.0)]
    s = spark.createDataFrame(seg, "image_id long, seg long, y0 double, x0 double, y1 double, x1 double")
    got = []
    records, _ = written_in_shuffles(spark, lambda: got.extend(N.line_profile(s, px, 3, N.image_sizes(px)).collect()))

    def at(y, x):
        y, x = round(y, 9), round(x, 9)
        if not (0 <= y <= h - 1 and 0 <= x <= w - 1):
            return 0.0
        b, a = math.floor(y), math.floor(x)
        four = [(b + p, a + q, (y - b if p else 1 - y + b) * (x - a if q else 1 - x + a)) for p in (0, 1) for q in (0, 1)]
        return sum(((r * 7 + c * 3) % 11) * u for r, c, u in four if (r, c) != (20, 20) and u)

    want = {}
    for _, k, y0, x0, y1, x1 in seg:
        n, th = math.ceil(round(math.hypot(y1 - y0, x1 - x0), 9) + 1), math.atan2(y1 - y0, x1 - x0)
        for i in range(n):
            f = i / (n - 1) if n > 1 else 0.0
            want[k, i] = sum(at(y0 + f * (y1 - y0) + j * math.cos(th), x0 + f * (x1 - x0) - j * math.sin(th)) for j in (-1, 0, 1)) / 3
    assert {(r.seg, r.i) for r in got} == set(want)
    assert all(abs(r.v - want[r.seg, r.i]) < 1e-6 for r in got)
    assert records < 3 * len(want) + h * w


def test_proposed_links_meet_only_if_they_may_be_kept(spark):
    """proposals whose hash is too large for any rank that is kept are dropped before they are compared."""
    from gridloom.functions.ordering import hash_order
    from gridloom.operators import sampling as S

    e = spark.range(20000).select((F.col("id") % 997).alias("user_id"), (F.col("id") * 7 % 1999).alias("item_id"))
    n, got = e.distinct().count(), []
    records, _ = written_in_shuffles(spark, lambda: got.extend(S.negative_links(e, 1.0, 9).collect()))
    assert len(set(got)) == len(got) == 20000 and n == 20000
    assert not set(got) & set(e.collect())
    assert records < 9 * n  # edges, their items and users, the kept proposals
    tries = F.explode(F.array(*[F.lit(t) for t in range(4)]))
    items = [r.item_id for r in e.select("item_id").distinct().orderBy("item_id").collect()]
    p = e.withColumn("t", tries).select("user_id", F.pmod(F.xxhash64("user_id", "item_id", "t", F.lit(9)), F.lit(len(items))).alias("idx"))
    p = p.join(spark.createDataFrame(list(enumerate(items)), "idx long, item_id long"), "idx").select("user_id", "item_id").distinct().join(e, ["user_id", "item_id"], "left_anti")
    first = p.orderBy(hash_order(F.concat_ws("-", "user_id", "item_id"), 9)).limit(20000).collect()
    assert {(r.user_id, r.item_id) for r in got} == {(r.user_id, r.item_id) for r in first}


def test_epochs_of_runs_are_numbered_once(spark):
    """the summary of folds reads one table of runs, which no later step numbers again."""
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    got = []
    records, _ = written_in_shuffles(spark, lambda: got.extend(entry.queries()["i19_cv_aggregate"](spark, DIR).collect()))
    assert got[0].n_folds == 21
    assert records < 8 * rows  # 8.7 a row when numbered again


def test_stream_keeps_few_early_epochs():
    """Epochs far ahead of the next one fold to their records, and nothing is kept after a sure stop."""
    from gridloom.streaming.early_stop import NEVER, Early

    rng = np.random.default_rng(3)
    epochs, scores = rng.permutation(np.arange(1000, 21000)), rng.random(20000)
    early = Early(60)
    for k in range(0, 20000, 500):
        early.add(epochs[k : k + 500], scores[k : k + 500], 10)
    by_epoch = scores[np.argsort(epochs)]
    assert len(early.first) < 20 and early.top == 20999 and early.last[-1] == early.cut < 2000
    assert early.score.tolist() == np.unique(np.maximum.accumulate(by_epoch[: early.cut - 999])).tolist()
    early.add(np.array([15000, 998, 998]), np.array([2.0, 0.25, 0.75]), 10)
    assert early.first[0] == 998 and early.score[0] == 0.25 and early.last[-1] == early.cut
    falling = Early(NEVER)
    falling.add(np.arange(50000), -np.arange(50000.0), 0)
    assert falling.first.tolist() == [0] and falling.last.tolist() == [49999]


def test_roi_boxes_meet_blocks_of_cells(spark):
    """Boxes of any size give the means over the cells they cover, and never become one row for each cell."""
    from gridloom.operators import candidates as C

    rng = np.random.default_rng(4)
    cells = [(0, y, x, float(rng.integers(100))) for y in range(-3, 20) for x in range(17) if rng.random() < 0.9]
    boxes = [(0, k, *(float(v) for v in (y, x, y + h, x + w))) for k, (y, x, h, w) in enumerate(rng.uniform([-4, -2, 0, 0], [18, 15, 12, 12], (30, 4)).round(1))]
    want = {}
    for _, k, y1, x1, y2, x2 in boxes:
        for _, y, x, v in cells:
            if all(np.floor(a) <= c <= max(np.ceil(b) - 1, np.floor(a)) for a, b, c in ((y1, y2, y), (x1, x2, x))):
                at = tuple(int(min(max(np.floor((c + 0.5 - a) / max(b - a, 1e-9) * 3), 0), 2)) for a, b, c in ((y1, y2, y), (x1, x2, x)))
                want.setdefault((k, *at), []).append(v)
    f = spark.createDataFrame(cells, "image_id long, fy long, fx long, f double")
    b = spark.createDataFrame(boxes, "image_id long, box int, y1 double, x1 double, y2 double, x2 double")
    for block in (3, 8):
        got = {(r.box, r.by, r.bx): r.f for r in C.roi_pool(f, b, 3, block).collect()}
        assert got == pytest.approx({k: np.mean(v) for k, v in want.items()})
    wide = spark.createDataFrame([(0, 0, 0.0, 0.0, 1e6, 1e6)], b.schema)
    assert [(r.by, r.bx) for r in C.roi_pool(f, wide, 3, 1 << 14).collect()] == [(0, 0)]


def test_tiles_without_inner_cells_are_rejected(spark):
    from gridloom.operators import candidates as C

    cells = [(0, t, y, x, 1.0) for t in (0, 1) for y in range(8) for x in range(8) if t == 0 or y == 0]
    t = spark.createDataFrame(cells, "image_id long, tile_id long, fy long, fx long, f double")
    with pytest.raises(Exception, match="full feature grid"):
        C.stitch_tiles(t, 2, 48, 8, 8).collect()
    assert C.stitch_tiles(t.filter("tile_id = 0"), 2, 48, 8, 8).count() == 36


def test_pieces_outlive_a_batch():
    """Batches of many texts hold some 140,000 distinct pieces; those of the batch before last are still kept."""
    import base64

    from gridloom.llm import bpe

    coder = bpe.Coder(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    asked = []
    coder._block = lambda block: asked.extend(block) or {p: (p, 1, b"") for p in block}
    for k in (0, 1, 0):
        asked.clear()
        coder.pieces([f"{k} {n}" for n in range(140_000)])
    assert not asked
    for k in range(2, 9):
        coder.pieces([f"{k} {n}" for n in range(140_000)])
        assert len(coder.known) + len(coder.older) <= 5 * bpe.KEPT


def test_negatives_are_marked_as_sampled(spark):
    """Marks keep every edge, so folds need no second meeting with the vectors, and agree with the sample."""
    from gridloom.operators import sampling as S

    rng = np.random.default_rng(6)
    rows = [(g, n, n + 1, int(g != 2 and rng.random() < 0.3)) for g in range(4) for n in range(40)]
    e = spark.createDataFrame(rows, "graph_id long, src long, dst long, true_label int")
    args = (["graph_id"], F.concat_ws("-", "src", "dst"), 0.5, 3)
    marked = S.mark_negatives(e, *args, "_t").collect()
    taken = {(r.graph_id, r.src) for r in S.sample_negatives(e, *args).collect()}
    assert len(marked) == len(rows) and {(r.graph_id, r.src) for r in marked if r._t} == taken
    for g in range(4):
        mine = [r for r in marked if r.graph_id == g]
        positive = sum(r.true_label for r in mine)
        assert sum(r._t for r in mine) == (positive + positive // 2 if positive > 1 else 40)
