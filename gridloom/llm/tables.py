"""Tables between the steps of a job, and connected components of links."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from gridloom.functions.rounds import shared_dir
from gridloom.llm.words import U, mix

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_scopes: list[list[str]] = []
_known: weakref.WeakSet = weakref.WeakSet()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with `outlives`."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in _scopes.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, batch: int | None = None, outlives: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read again: what follows never repeats this step.

    `batch` rows at most go to a Python worker at once while this step runs; wide rows need few.
    A table that `outlives` its scratch scope belongs to the scope around it, if there is one.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    for scope in _scopes[: -1 if outlives else None][-1:]:
        scope.append(path)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        if batch:
            conf.set(key, str(min(batch, int(before)) if int(before) > 0 else batch))
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _known.add(out)
    return out


def is_written(df: DataFrame) -> bool:
    """Whether this very DataFrame came from `written`."""
    return df in _known


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n (null for a null key)."""
    return F.crc32(key.cast("string")) % n


def count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); nodes of a component share one root.

    Randomized contraction: in each round every node follows the member of its closed
    neighbourhood with the smallest hash, links move to the chosen nodes, and loops vanish.  Hubs
    only meet partial minima.  It ends when no link is left; each round is a written table.
    """
    e = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while count(e):
        turn = F.lit(len(maps))

        def ranked(c: str, turn: Column = turn) -> Column:
            return F.struct(F.xxhash64(F.col(c), turn).alias("h"), F.col(c).alias("id"))

        both = e.select("a", "b").union(e.select("b", "a"))
        step = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["id"].alias("root"))
        step = written(step)
        maps.append(step)
        moved = e.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").filter("ra <> rb")
        e = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).filter(F.lit(False))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = m.join(out.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(out)


def _bits(k: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(k, 41) >> U(64 - log_bits), mix(k, 42) >> U(64 - log_bits)


def marks(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of some unsigned keys may be one that `bit_field` was made from."""
    a, b = ((field[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 for at in _bits(keys, len(field).bit_length() + 2))
    return (a & b).astype(bool)


def bit_field(keys: DataFrame, log_bits: int = 23) -> np.ndarray:
    """A bit field of fixed size, a MB by default, in which every key of `keys` (one long column) sets two bits."""
    size, blocks = 1 << (log_bits - 3), 16

    def marked(batches):
        field = np.zeros(size, np.uint8)
        for b in batches:
            for at in _bits(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U), log_bits):
                np.bitwise_or.at(field, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
        parts = field.reshape(blocks, -1)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pa.record_batch({"block": pa.array(some, pa.int32()), "bits": pa.array([parts[i].tobytes() for i in some], pa.binary())})

    def joined(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        for k, x in parts.items():
            yield pa.record_batch({"block": pa.array([k], pa.int32()), "bits": pa.array([x.tobytes()], pa.binary())})

    kind = "block int, bits binary"
    field = np.zeros((blocks, size // blocks), np.uint8)
    for r in keys.mapInArrow(marked, kind).repartition(blocks, "block").mapInArrow(joined, kind).collect():
        field[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return field.ravel()


def sieve(keys: DataFrame, log_bits: int = 23) -> Callable[[Column], Column]:
    """A test on long keys that holds for every key of `keys` (one long column) and for few others.

    Only a bit field of fixed size is broadcast, so rows without a partner needn't be shuffled.  Too many
    keys only let more others pass.
    """
    shared = keys.sparkSession.sparkContext.broadcast(bit_field(keys, log_bits))

    @F.arrow_udf(BooleanType())
    def passes(column: pa.Array) -> pa.Array:
        return pa.array(marks(shared.value, column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)))

    return lambda key: passes(key)
