"""Materialized rounds for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`, which every node can reach.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt over all shuffle partitions by `keys`, for steps whose work is long for its bytes: partitions
    joined by size would leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame, **observed: Column) -> tuple[DataFrame, dict]:
    """Write a round to the shared folder and read it back: lineage ends here and a lost
    executor costs a re-read, not a recomputation.  Aggregates in `observed` come from the
    written table and read only the columns they name."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not observed:
        return out, {}
    row = out.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in observed.items()]).first()
    return out, row.asDict()
