import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def boxes(spark, items, shape, image=0):
    """Label pixels out of half-open boxes (label, r0, r1, c0, c1) plus image sizes."""
    px = [(image, lab, y, x) for lab, r0, r1, c0, c1 in items for y in range(r0, r1) for x in range(c0, c1)]
    lab = spark.createDataFrame(px, "image_id long, label long, y long, x long")
    return lab, spark.createDataFrame([(image, *shape)], "image_id long, h long, w long")


def image(spark, shape, value, image=0):
    return spark.createDataFrame([(image, y, x, float(value(y, x))) for y in range(shape[0]) for x in range(shape[1])], "image_id long, y long, x long, v double")


HYPHA = [(1, 8, 12, 2, 14), (2, 8, 12, 16, 28), (3, 8, 12, 30, 42), (4, 8, 12, 50, 58)]
HYPHA_GT = [(10, 8, 12, 2, 42), (20, 8, 12, 50, 58)]
