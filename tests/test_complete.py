"""Whole inputs and unfinished work: nothing is cut off silently, and workers find the package."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sampling, tiles
from gridloom.plans import catalog
from gridloom.sources import views

ROOT = Path(__file__).resolve().parents[1]
DIR = "/root/testdata/sf0.001"


def test_all_vectors_are_pages_and_tiles(spark):
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    assert views.pages(spark, DIR).select("image_id", "page").distinct().count() == n
    assert views.tiles(spark, DIR).select("image_id", "tile_id").distinct().count() == n
    assert catalog.QUERIES["b1_split_channels"](spark, DIR).count() == 64 * n


def test_thin_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(11)
    px = [(k, int(y), int(x)) for k in range(40) for y, x in np.argwhere(rng.random((10, 10)) < 0.75)]
    mask = spark.createDataFrame(px, "image_id long, y long, x long")
    want = {tuple(r) for r in tiles.thin(mask, tile=64).collect()}
    for side in (3, 4):
        assert {tuple(r) for r in tiles.thin(mask, tile=side, steps=1).collect()} == want


def test_negative_links_reach_their_number(spark):
    full = [(u, i) for u in range(12) for i in range(10) if u == 0 and i < 9 or (u * 7 + i) % 10 < 8]
    edges = spark.createDataFrame(full, "user_id long, item_id long")
    left = edges.select("user_id").distinct().count() * edges.select("item_id").distinct().count() - edges.distinct().count()
    got = sampling.negative_links(edges, 1.0, 3).collect()
    assert len(got) == len({tuple(r) for r in got}) == min(len(full), left) and not {tuple(r) for r in got} & set(full)
    sparse = spark.range(300).select((F.col("id") % 60).alias("user_id"), ((F.col("id") * 7) % 97).alias("item_id")).distinct()
    n = sparse.count()
    got = {tuple(r) for r in sampling.negative_links(sparse, 2.0, 3).collect()}
    assert len(got) == 2 * n and not got & {tuple(r) for r in sparse.collect()}


def test_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
print('rows', [e.queries()[q](s, {DIR!r}).count() > 0 for q in ('g1_connected_components', 'c16_label_components')])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "rows [True, True]" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("lateness", [(), (40,)])
def test_stream_settles_gaps(spark, tmp_path, lateness):
    """Shuffled batches, epoch 0, and lost epochs: the stream agrees with the batch form, also by default."""
    from gridloom.operators.metrics import early_stop
    from gridloom.streaming import early_stop as ES

    rng = np.random.default_rng(8)
    rows = [(r, f, e, float(0.5 + 0.4 * (1 - np.exp(-e / 30)) + rng.normal() * 0.02)) for r in "AB" for f in range(2) for e in range(200) if (r, e) != ("A", 37)]
    order = sorted(rows, key=lambda x: x[2] + rng.random() * 25)
    for k in range(0, len(order), 100):
        spark.createDataFrame(order[k : k + 100], ES.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    # one run that is lost altogether but for epochs after a gap, one that never reaches the first epoch that counts
    rows += [("C", 0, e, 0.9 - e / 100) for e in (5, 6, 9, 60)] + [("D", 0, e, 0.5) for e in (0, 1, 2)]
    spark.createDataFrame(rows[-7:], ES.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    got = {(r["repeat"], r.fold): (r.best_epoch, r.stop_epoch, r.best_value) for r in ES.run_available(spark, str(tmp_path / "src"), str(tmp_path / "work"), 25, 3, 4, *lateness).collect()}
    want = {(r["repeat"], r.fold): (r.best_epoch, r.stop_epoch, r.best_value) for r in early_stop(spark.createDataFrame(rows, ES.SCHEMA), 25, 3).collect()}
    assert got == want and ("C", 0) in got and ("D", 0) not in got
