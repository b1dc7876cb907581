"""Dense arrays to pixel rows and back, file names, acquisitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import hash_rank


def rasters_to_pixels(df: DataFrame, width: int, array: str, key: str) -> DataFrame:
    """One row per pixel out of row-major arrays."""
    return df.select(F.col(key).alias("image_id"), F.posexplode(array).alias("pos", "v")).select(
        "image_id",
        F.expr(f"pos div {width}").alias("y"),
        F.expr(f"pos % {width}").cast("long").alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def pixels_to_rasters(df: DataFrame, keys: list[str], tile: int = 512) -> DataFrame:
    """Row-major blocks of at most tile x tile pixels, so one huge raster is many rows."""
    t = df.withColumn("ty", F.expr(f"y div {tile}")).withColumn("tx", F.expr(f"x div {tile}"))
    g = t.groupBy(*keys, "ty", "tx").agg(
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"),
    )
    return g.select(*keys, "ty", "tx", "h", "w", F.transform("p", lambda s: s["v"]).alias("data"))


def parse_file_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Folder, stem, channel list, this file's channel and the base name without it.

    Names look like `<base>_C<n>_<...>_<ch1>,<ch2>,...<.ext>`; without a usable C<n> the
    channel falls back to the stem.
    """
    file = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    chans = F.transform(F.split(F.element_at(F.split(stem, "_"), -1), ","), lambda c: F.trim(c))
    d = df.withColumn("folder", F.regexp_replace(path, r"/[^/]*$", "")).withColumn("file", file)
    d = d.withColumn("stem", stem).withColumn("channels", chans)
    d = d.withColumn("channel_no", F.regexp_extract("file", r"C(\d+)", 1).cast("int"))
    known = (F.col("channel_no") >= 1) & (F.col("channel_no") <= F.size("channels"))
    return d.withColumn("channel", F.when(known, F.get("channels", F.col("channel_no") - 1)).otherwise(F.col("stem"))).withColumn(
        "base", F.regexp_replace("stem", r"_C\d_", "_")
    )


def composite_name(parsed: DataFrame) -> DataFrame:
    """One name per file set: base plus the channel names in file order.

    The list holds one name per channel file of an acquisition, a handful by construction.
    """
    g = parsed.groupBy("folder", "base").agg(F.array_sort(F.collect_set(F.struct("file", "channel"))).alias("p"))
    return g.select(
        "folder", "base",
        F.concat(F.col("base"), F.lit("_"), F.array_join(F.transform("p", lambda s: s["channel"]), ",")).alias("name"),
    )


def find_channel(parsed: DataFrame, name: str) -> DataFrame:
    """Per file set, the first file that carries the named channel.

    The first file's channel list gives the 1-based position n, the file must contain `C<n>`.
    """
    keys = ["folder", "base"]
    ref = with_stats(parsed, keys, _ref=F.min_by(F.transform("channels", F.upper), "file"))
    n = F.array_position("_ref", name.upper())
    hit = ref.filter(n > 0).filter(F.col("file").contains(F.concat(F.lit("C"), n.cast("string"))))
    return hit.groupBy(*keys).agg(F.min("file").alias("file"))


def complete_acquisitions(df: DataFrame, roles: list[str]) -> DataFrame:
    """First file of every role per folder; folders missing a role are dropped."""
    return df.groupBy("folder").pivot("role", roles).agg(F.min("path")).dropna()


def write_chunks(df: DataFrame, path: str, chunk: int) -> None:
    """Store level/channel/plane directories whose files are clustered by chunk, so reading a
    region prunes directories first and Parquet row groups by min/max after that."""
    t = df.withColumn("ty", F.expr(f"y div {chunk}")).withColumn("tx", F.expr(f"x div {chunk}"))
    parts = ["level", "c", "z"]
    (
        t.repartitionByRange(*parts, "image_id", "ty", "tx")
        .sortWithinPartitions(*parts, "image_id", "ty", "tx", "y", "x")
        .write.mode("overwrite").partitionBy(*parts).parquet(path)
    )


def read_region(spark, path: str, level: int, c: int, z: int, ty: int, tx: int) -> DataFrame:
    d = spark.read.parquet(path)
    return d.filter(f"level = {level} AND c = {c} AND z = {z} AND ty = {ty} AND tx = {tx}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_profiles(spark, path: str) -> DataFrame:
    """Profiles of many CSV files in one frame; labels get the file's ordinal as a suffix."""
    raw = spark.read.schema("label string, distance double, intensity double").option("header", True).csv(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    files = hash_rank(raw.select("_file").distinct(), [], "_file", 0).select("_file", (F.col("rank") - 1).alias("_i"))
    return raw.join(files, "_file").select(F.concat("label", F.lit("_f"), F.col("_i").cast("string")).alias("label"), "distance", "intensity")


def read_metrics(spark, path: str) -> DataFrame:
    return spark.read.schema("repeat string, fold int, step int, tag string, value double").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark, path: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; dropped columns never leave the files."""
    return spark.read.parquet(f"{path}/nodes").drop(*drop), spark.read.parquet(f"{path}/edges").drop(*drop)


def scan_files(spark, paths: list[str], glob: str) -> DataFrame:
    """Sorted listing of the files matching a glob; file contents are never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    return f.select("path", "length", "modificationTime").orderBy("path")


