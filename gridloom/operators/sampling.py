"""Splits, samples and encodings.  Random choices order by md5(id, seed): reproducible, equal
on every cluster, and free of driver state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.columns import with_stats
from gridloom.functions.ordering import first_by, hash_order, hash_rank, running_sums
from gridloom.functions.rounds import materialize


def vector_zscore(train: DataFrame, apply_to: DataFrame, vec: str = "vec", into: tuple[str, ...] = ()) -> DataFrame:
    """Standardize every vector dimension with the mean and sample deviation of `train`, in the same
    column or in the columns `into`.

    The statistics are one row with one entry per dimension (a fixed, small width).
    """
    d = train.select(F.posexplode(vec).alias("i", "u")).groupBy("i").agg(F.avg("u").alias("m"), F.stddev_samp("u").alias("sd"))
    one = d.agg(F.array_sort(F.collect_list(F.struct("i", "m", "sd"))).alias("_s"))
    out = apply_to.crossJoin(F.broadcast(one))
    return out.withColumns({v: F.zip_with(v, "_s", lambda u, s: (u - s["m"]) / (s["sd"] + 1e-7)) for v in into or (vec,)}).drop("_s")


def column_zscore(train: DataFrame, apply_to: DataFrame, column: str) -> DataFrame:
    one = train.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return apply_to.crossJoin(F.broadcast(one)).withColumn(column, (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-7)).drop("_m", "_s")


def k_fold(ids: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    return hash_rank(ids, [], id_col, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def mark_negatives(edges: DataFrame, keys: list[str], id_col: str | Column, ratio: float, seed: int, out: str) -> DataFrame:
    """All edges, with a column that tells which of them `sample_negatives` takes."""
    s = hash_rank(edges, [*keys, "true_label"], id_col, seed)
    s = with_stats(s, keys, _p=F.sum("true_label"), _n=F.sum(1 - F.col("true_label")))
    want = F.floor(F.col("_p") * ratio)
    all_rows = (want <= 0) | (F.col("_n") == 0)
    return s.withColumn(out, F.coalesce(all_rows | (F.col("true_label") == 1) | (F.col("rank") <= want), F.lit(False))).drop("rank", "_p", "_n")


def sample_negatives(edges: DataFrame, keys: list[str], id_col: str | Column, ratio: float, seed: int) -> DataFrame:
    """All positives plus ratio times as many negatives per group; every row of a group that
    lacks positives or negatives."""
    return mark_negatives(edges, keys, id_col, ratio, seed, "_take").filter("_take").drop("_take")


def balanced_sample(df: DataFrame, cls: str, id_col: str, ratio: float, seed: int, keys: list[str] = []) -> DataFrame:
    """Up to max(floor(ratio * rarest class count), 1) rows of every present class."""
    counts = df.groupBy(*keys, cls).agg(F.count("*").alias("_c"))
    least = with_stats(counts, keys, _min=F.min("_c")).select(*keys, cls, F.greatest(F.floor(F.col("_min") * ratio), F.lit(1)).alias("_take"))
    return hash_rank(df, [*keys, cls], id_col, seed).join(least, [*keys, cls]).filter("rank <= _take").drop("rank", "_take")


def sample_per_class(df: DataFrame, cls: str, id_col: str | Column, n: int, seed: int) -> DataFrame:
    """Up to n rows per label; the top-n filter runs before the shuffle."""
    return first_by(df, [cls], [hash_order(id_col, seed)], n)


def smooth_labels(df: DataFrame, column: str, eps: float) -> DataFrame:
    y = F.col(column)
    return df.withColumn(column, y * (1 - eps) + (1 - y) * eps)


def link_split(edges: DataFrame, id_col: Column, val: float, test: float, disjoint: float, seed: int) -> DataFrame:
    """Test, validation and training edges; training edges again into supervision and message
    passing."""
    s = with_stats(hash_rank(edges, [], id_col, seed), [], _n=F.count("*"))
    n_test, n_val = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    held = n_test + n_val
    n_sup = F.floor((F.col("_n") - held) * disjoint)
    split = (
        F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= held, "val")
        .when(F.col("rank") <= held + n_sup, "supervision").otherwise("message")
    )
    return s.withColumn("split", split).drop("rank", "_n")


def index_ids(df: DataFrame, column: str) -> DataFrame:
    """Id to consecutive integer from 0 in id order, without a global window."""
    ids = df.select(column).distinct().withColumn("_one", F.lit(1))
    return running_sums(ids, [], column, {"idx": "_one"}).select(column, (F.col("idx") - 1).alias("idx"))


def negative_links(edges: DataFrame, ratio: float, seed: int) -> DataFrame:
    """User-item pairs that are not edges, ratio times as many as edges.

    Every edge proposes a few items for its user by hashing into the item index, proposals that
    are edges or repeats fall out, and rounds with new seeds go on until there are enough.  If the
    pairs that are no edges are few against what is asked for, all pairs are at most a small multiple
    of it, and every user proposes every item.  The hash rank trims to the exact count.

    The first round proposes more than is asked for, and the rank keeps the smallest hashes; so it is
    first gone through with small hashes only.  If those are enough, no other could be among the first.
    """
    pairs, size = materialize(edges.select("user_id", "item_id").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n")), n=F.sum("_n"), e=F.count(F.lit(1)))
    pairs = pairs.select("user_id", "item_id")
    items, some = materialize(index_ids(pairs, "item_id"), m=F.count(F.lit(1)))
    size |= some | pairs.agg(F.count_distinct("user_id").alias("u")).first().asDict()
    left = size["u"] * size["m"] - size["e"]
    want = min(int(size["n"] * ratio), left)
    tries = int(ratio * 2) + 2
    key = F.concat_ws("-", "user_id", "item_id")

    def fresh(proposed: DataFrame, below: str | None = None) -> DataFrame:
        p = proposed.join(items, "idx").select("user_id", "item_id")
        p = p if below is None else p.filter(hash_order(key, seed) < below)
        return p.distinct().join(pairs, ["user_id", "item_id"], "left_anti")

    if left <= 2 * want:
        every = F.sequence(F.lit(0).cast("long"), F.lit(size["m"] - 1).cast("long")) if size["m"] else F.array().cast("array<bigint>")
        found = fresh(pairs.select("user_id").distinct().withColumn("idx", F.explode(every)))
    else:
        def proposals(turn: int) -> DataFrame:
            t = F.explode(F.array(*[F.lit(turn * tries + i) for i in range(tries)]))
            return pairs.withColumn("t", t).select("user_id", F.pmod(F.xxhash64("user_id", "item_id", "t", F.lit(seed)), F.lit(size["m"])).alias("idx"))

        part = min(1.25 * want / max(tries * size["e"], 1) + 1e-3, 1.0)
        found, obs = materialize(fresh(proposals(0), f"{min(int(part * 16**8), 16**8 - 1):08x}"), n=F.count(F.lit(1)))
        turn = 0
        while obs["n"] < want:
            new = fresh(proposals(turn))
            found, obs = materialize(new if turn == 0 else found.union(new).distinct(), n=F.count(F.lit(1)))
            turn += 1
    r = found.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = [(x["_b"], x["n"]) for x in r.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).orderBy("_b").collect()]  # 4,096 rows at most
    taken, last = 0, None
    for b, n in counts:  # whole buckets, then a part of one
        if taken + n > want:
            last = b
            break
        taken += n
    if last is None:
        return r.select("user_id", "item_id")
    rest = r.filter(F.col("_b") == last).orderBy("_h", "user_id", "item_id").limit(want - taken)
    return r.filter(F.col("_b") < last).select("user_id", "item_id").unionByName(rest.select("user_id", "item_id"))


def sample_neighbours(edges: DataFrame, seeds: DataFrame, fanout: tuple[int, int], seed: int) -> DataFrame:
    """At most fanout[0] items per seed user, then at most fanout[1] users per reached item."""
    key = F.concat_ws("-", "user_id", "item_id")
    hop1 = first_by(edges.join(seeds.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], [hash_order(key, seed)], fanout[0])
    reached = hop1.select("item_id").distinct()
    hop2 = first_by(edges.join(reached, "item_id", "left_semi"), ["item_id"], [hash_order(key, seed)], fanout[1])
    return hop1.select(F.lit(1).alias("hop"), "user_id", "item_id").unionByName(hop2.select(F.lit(2).alias("hop"), "user_id", "item_id"))


def multi_hot(df: DataFrame, id_col: str, column: str, sep: str, vocabulary: list[str]) -> DataFrame:
    """Indicator column per word; a projection, since membership needs no shuffle.  A word outside
    the vocabulary is an error."""
    words = F.split(column, sep)
    unknown = F.array_except(words, F.array(*[F.lit(w) for w in vocabulary]))
    stop = F.raise_error(F.concat(F.lit("word outside the vocabulary: "), F.get(unknown, F.lit(0)))).cast(df.schema[id_col].dataType)
    checked = F.when(F.size(unknown) > 0, stop).otherwise(F.col(id_col)).alias(id_col)
    return df.select(checked, *[F.array_contains(words, w).cast("int").alias(f"w_{w}") for w in vocabulary])


def vocabulary(df: DataFrame, column: str, sep: str) -> DataFrame:
    return df.select(F.explode(F.split(column, sep)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_items(edges: DataFrame, items: DataFrame, n: int) -> DataFrame:
    top = edges.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item_id").limit(n)
    return items.join(F.broadcast(top), "item_id")  # n rows


def unseen_items(user_id, edges: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(edges.filter(F.col("user_id") == user_id), "item_id", "left_anti")
