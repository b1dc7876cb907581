"""A cross-section of registered queries next to their SQL twins on the smallest data set;
`tools/compare.py` runs all of them."""

import duckdb
import pytest

from compare import TABLES, compare

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = [
    "a2_parse_file_name", "a6_pixels_to_rasters", "b4_sharpness", "b7_subtract_direct", "b14_merge_channels", "b18_resize_linear",
    "b24_otsu_threshold", "b26_two_means_1d", "c2_gaussian_blur", "c10_bilateral_filter", "c13_clahe", "c17_fill_holes", "c29_wavelet_denoise",
    "d3_region_perimeter", "d6_context_ring", "e3_threshold_sweep", "e13_recall_ceiling", "f3_knn_edges", "f7_vector_knn", "f12_searchsorted_join",
    "g2_topology", "g12_gcn_aggregate", "h3_sample_negatives", "h7_link_split", "i2_degree_penalty", "i4_pr_curve", "i15_early_stop", "j7_spread_and_centroid",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    state, info, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], DIR)
    assert state == "ok", info


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0
