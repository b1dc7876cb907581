"""Sharding by a two-pass external shuffle, in DataFrame operations only.

First pass: records are scattered into buckets small enough for a task's memory.  A record's shard is
the one with the largest hash of (doc_id, shard number), so one more shard takes rows only into itself
(law `key`); inside a shard a seeded hash of the record picks one of as many buckets as the counted
bytes ask for.  Second pass: each bucket is gathered, put in an order that doesn't depend on the
scattering, permuted by Fisher-Yates (`shuffle` with a seed) and written.  A record's slot counts
through the buckets of its shard.

Defined cases: a null doc_id is a key like any other; a null text has no bytes; equal records are told
apart by nothing and fill slots of their own.  An empty table gives an empty result; columns of any
name stay inside `record`.  Records that repeat more than `hot` times in doc_id and
text are scattered by row number as well, so no bucket holds more than its share of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from gridloom.functions.rounds import shared_dir


def rendezvous(key: Column, n: int) -> Column:
    """The shard of a key: of n hashes of (key, shard) the largest decides."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))))["i"].cast("int")


def record_bytes(text: Column | str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def external_shuffle(docs: DataFrame, shards: int = 40, seed: int = 5, bucket_bytes: int = 16 << 20, hot: int = 1000, path: str | None = None) -> DataFrame:
    """(shard, bucket, slot, record): all rows of `docs`, as written to `path` (by default a folder in
    the shared one), a shard per partition folder and a slot order inside it."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    total = docs.agg(F.sum(record_bytes("text"))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    same = F.xxhash64("doc_id", "text")
    many = docs.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("same")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").alias("_id"), same.alias("same"))
    if buckets > 1 and many.take(1):
        d = d.join(many.withColumn("is_hot", F.lit(True)), "same", "left")
        d = d.withColumn("same", F.when(F.col("is_hot"), F.xxhash64("same", F.monotonically_increasing_id())).otherwise(F.col("same")))
    scattered = d.select("record", rendezvous(F.col("_id"), shards).alias("shard"), F.pmod(F.xxhash64("same", F.lit(seed)), F.lit(buckets)).cast("int").alias("bucket"))
    scattered = scattered.repartition(int(shards * buckets), "shard", "bucket")
    gathered = scattered.groupBy("shard", "bucket").agg(F.collect_list(F.struct(F.xxhash64("record", F.lit(seed)).alias("h"), "record")).alias("rows"))
    gathered = gathered.sortWithinPartitions("shard", "bucket")
    shuffled = gathered.select("shard", "bucket", F.posexplode(F.shuffle(F.sort_array("rows"), F.lit(seed))).alias("i", "x"))
    shuffled.select("shard", "bucket", "i", "x.record").write.partitionBy("shard").parquet(path)
    out = spark.read.schema(StructType().add("bucket", "integer").add("i", "integer").add("record", docs.schema).add("shard", "integer")).parquet(path)
    sizes = out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return out.join(offset, ["shard", "bucket"]).select("shard", "bucket", (F.col("start") + F.col("i")).cast("long").alias("slot"), "record")
