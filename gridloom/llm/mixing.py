"""Mixing sources to target weights by capped water-filling.

Sources, ordered by code point with null last, have weights in turn; together they are to give `share`
of all words.  A source gives at most `epochs` times its size: sources are taken by the ratio of that
maximum to their weight, and as long as the next one can't hold its part of what is left it is filled
to its maximum and its excess is shared by weight among the rest.  All of it is running sums over one
row per source.

A source's target is made of whole repetitions of all its documents and of one more copy of some:
documents in seeded hash order (of doc_id and text), as long as the middle of a document lies inside the
rest of the target.  These are all documents up to one place in the order, so a source needs one cut:
sums over hash ranges find the range it lies in, and a running sum inside that range alone, over narrow
rows, finds the last document that is taken.  Whole rows meet one row a source and are never shuffled.

Defined cases: a null source is a source, null and empty texts have size 0 and are taken by whole
repetitions only, an empty table gives an empty result, and an all-empty source has target 0.  Rows equal
in doc_id and text have one place; if the cut goes through them, as many as fit are taken, whichever.
Columns of any name stay inside `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.llm.tables import WORD, written


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """`sizes` (source, source_size) with weight and target: one row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
    s = s.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("turn", F.row_number().over(fill))
    s = s.withColumn("left_size", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left_size") / F.col("left_weight"))
    level = F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.col("turn"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return s.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, seed: int = 6, buckets: int = 3, **shape) -> DataFrame:
    """(row, size, source_size, target, copies): every document (all columns, in the struct `row`) and
    how often the mix takes it.  16 ^ `buckets` hash ranges split a source."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5("text")))
    narrow = docs.select(F.col("source"), n_words("text").alias("size"), key.alias("at")).filter("size > 0").withColumn("part", F.substring("at", 1, buckets))
    empty = docs.select("source").distinct().select("source", F.lit("").alias("part"), F.lit(0).cast("long").alias("part_size"))
    parts = written(narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size")).unionByName(empty))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), **shape)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    goal = written(goal.select("source", "source_size", "target", whole.alias("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    upto = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
    edge = _by_source(parts, goal).filter("start <= rest and rest < start + part_size").select("source", "part", "start", "rest")
    inside = narrow.alias("n").join(edge.alias("e"), F.col("n.source").eqNullSafe(F.col("e.source")) & (F.col("n.part") == F.col("e.part"))).select("n.source", "at", "size", "start", "rest")
    before = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("goes", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2 <= F.col("rest"))
    at = inside.groupBy("source", "at").agg(F.count_if("goes").alias("go"), F.count(F.lit(1)).alias("same")).filter("go > 0")
    last = at.groupBy("source").agg(F.max(F.struct("at", "go", "same")).alias("last"))
    cuts = _by_source(goal, edge.select("source", "part").withColumn("found", F.lit(True)), "left")
    cuts = _by_source(cuts, last, "left").select("source", "source_size", "target", "whole", F.coalesce("last.at", "part", F.lit("")).alias("cut"), (F.col("last.go") < F.col("last.same")).alias("split"), F.col("last.go").alias("go"))
    cuts = written(cuts)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source"), n_words("text").alias("size"), key.alias("at"))
    j = _by_source(d, cuts)
    through = F.coalesce(F.col("split") & (F.col("at") == F.col("cut")), F.lit(False))
    one = F.when((F.col("size") > 0) & (F.col("at") <= F.col("cut")), 1).otherwise(0)

    def taken(rows: DataFrame, one: Column) -> DataFrame:
        return rows.select("row", "size", "source_size", "target", (F.col("whole") + one).cast("int").alias("copies"))

    if not cuts.filter("split").take(1):
        return taken(j, one)
    some = j.filter(through).withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("at")))  # equal rows only
    return taken(j.filter(~through), one).unionByName(taken(some, F.when(F.col("k") <= F.col("go"), 1).otherwise(0)))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on the source, null included."""
    r = right.withColumnRenamed("source", "that_source")
    return left.join(r, F.col("source").eqNullSafe(F.col("that_source")), how).drop("that_source")
