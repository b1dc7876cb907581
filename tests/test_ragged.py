"""Queries next to their SQL twins where the last image is neither full nor a rectangle."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import compare

import __spark_entry__ as entry

NAMES = ["b5_project_manual_slice", "c22_inner_boundary", "d10_node_box", "d11_edge_box", "d14_compose_masks", "f5_edge_features", "c19_distance_transform", "c29_wavelet_sym8"]


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """456 vectors: the last image of 100 ends with 6 of 10 tiles in its sixth row, that of 200 with 16 of 20 in its third."""
    d = str(tmp_path_factory.mktemp("ragged"))
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter(F.col("vec_id") < 456).coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    return con, d


@pytest.mark.parametrize("name", NAMES)
def test_twin_of_ragged_images(spark, ragged, name):
    con, d = ragged
    state, info, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], d)
    assert state == "ok", info
