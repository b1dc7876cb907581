"""Importance resampling towards a target distribution by hashed n-gram features.

A text is lower-cased (A-Z only) and its separators collapse to single spaces; an overlapped regex scan,
whose lookarounds let a match begin and end at word boundaries only, then emits the span of every run of
1 to `most` words, and the crc32 of a span picks its bucket.  Each document's buckets are written once, as
packed integers; bucket counts of corpus and target, weights and scores all come from that table.

A bucket's gain is the log ratio of its smoothed shares in target and corpus, a document's weight the mean
gain of its features.  Adding Gumbel noise from a seeded hash of the doc_id turns the highest scores into
a weighted draw without replacement.  Ranks never sort all rows in one task: scores are integers, so a
histogram gives every score the number of rows above it, and rows are ordered inside one score only.

Defined cases: a null or wordless text has no features and weight 0; a null doc_id hashes as an empty one
and orders first; rows equal in doc_id are drawn by themselves, and of equal rows any order is the same
result; an empty corpus gives an empty result, an empty target counts as no features.  Only `doc_id` and
`text` are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from gridloom.llm.tables import written

#: rows that go to a Python worker at once
BATCH = 1000


def _plain() -> bytes:
    """Byte translation: letters to lower case, all other ASCII but digits to spaces."""
    return bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def spans(most: int) -> list[regex.Pattern]:
    """For each run length, the pattern of a run of words in a text with single spaces."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (m - 1)) for m in range(1, most + 1)]


def features(text: Column, most: int = 1, buckets: int = 10_000) -> Column:
    """struct(n_words, n_features, buckets): the bucket of every feature of a text, as packed integers."""
    kind, plain = _packing(buckets), _plain()

    @F.arrow_udf("n_words long, n_features long, buckets binary")
    def scan(texts: pa.Array) -> pa.Array:
        patterns, crc = spans(most), zlib.crc32
        n_words, n_features, packed = [], [], []
        for t in texts:
            line = b" ".join(t.as_py().encode().translate(plain).split()) if t.is_valid else b""
            found = [crc(m[0]) for p in patterns for m in p.finditer(line, overlapped=True)]
            n_words.append(line.count(b" ") + 1 if line else 0)
            n_features.append(len(found))
            packed.append((np.array(found, np.uint32) % np.uint32(buckets)).astype(kind).tobytes())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], ["n_words", "n_features", "buckets"])

    return scan.asNondeterministic()(text)


def _packing(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over the packed column `buckets`; a task sends one row a bucket, whatever it has read."""
    kind = _packing(buckets)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": some.astype(np.int64), "n": total[some]})

    return packed.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, from (bucket, n) of both sides; `buckets` rows reach the driver."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    g = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    ratio = (t + 1.0) * (F.coalesce(F.sum("s").over(total), F.lit(0)).cast("double") + float(buckets))
    ratio = ratio / ((s + 1.0) * (F.coalesce(F.sum("t").over(total), F.lit(0)).cast("double") + float(buckets)))
    out = np.zeros(buckets, np.int64)
    for r in g.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document; drawn ones have a rank from 1."""
    spark, kind = docs.sparkSession, _packing(buckets)
    seen = written(docs.select("doc_id", features(F.col("text"), most, buckets).alias("f")).select("doc_id", "f.*"), batch=BATCH)
    aim = target.select(features(F.col("text"), most, buckets).alias("f")).select("f.buckets")
    table = spark.sparkContext.broadcast(gains(bucket_counts(seen, buckets), bucket_counts(aim, buckets), buckets))

    @F.arrow_udf(LongType())
    def weight(packed: pa.Array) -> pa.Array:
        gain = table.value
        all_of = (gain[np.frombuffer(x.as_buffer(), kind)] for x in packed)
        return pa.array([int(g.sum()) // len(g) if len(g) else 0 for g in all_of], pa.int64())

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    scored = seen.select("doc_id", "n_words", "n_features", weight("buckets").alias("weight"), noise.alias("noise"))
    scored = written(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")))
    return drawn(scored, F.col("n_words") >= least_words, percent)


def drawn(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """`scored` with `rank`: the floor(`percent` % of eligible rows) highest scores, ties to smaller doc_id."""
    hist = scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy(F.col("score").desc())  # one row a score: bounded by the range of scores
    hist = written(hist.select(F.col("score").alias("at"), F.sum("n").over(up).alias("upto"), (F.sum("n").over(up) - F.col("n")).alias("above")))
    quota = (hist.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n")).first()["n"] * percent) // 100
    j = scored.join(hist.filter(F.col("above") < quota), eligible & (F.col("score") == F.col("at")), "left")
    place = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(place)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    top = j.filter("above is not null").select(*columns, rank.alias("rank"))
    top = top.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return top.unionByName(j.filter("above is null").select(*columns, F.lit(None).cast("long").alias("rank")))
