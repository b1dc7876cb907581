"""Line dedup by winnowing: later repeats of runs of at least `run` lines go, and of single lines of enough words.

A document is the sequence of its lines that hold a word; blank lines stay where they are and are
never counted.  Of every `run` consecutive lines the one with the smallest hash (the last of equal
ones) is selected, so two equal runs always share a selected line at the same place.  Selected lines
are joined by their hash, but not in pairs: each carries its `run` - 1 neighbours on either side, and
for every way to extend it to a run of `run` equal lines only the earliest position is kept, by a
partial minimum.  A selected line elsewhere that extends in the same way is a later repeat; longer
runs are covered by the selected lines inside them.

Order is (doc_id, text hash, line), a null doc_id first.  Rows equal in doc_id and text count as one
document: all get the same result.  An empty table gives an empty result; columns of any name stay
inside `row`.  A null text stays null; a text that loses every line becomes
empty (or its blank lines).

When `run` is 2 or more a single repeated line stays, unless `alone` is given: then lines of at least
`alone` words are also winnowed as runs of one, in texts of one line too, and both cuts are united.  The
earliest of equal lines is in no later repeat, so it always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.tables import written

NONBLANK, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def repeated_lines(docs: DataFrame, run: int = 2, alone: int | None = None) -> DataFrame:
    """(doc_id, text_hash, cut): the lines to cut from each document that has any, numbered from 0."""

    def line(s: Column, i: Column) -> Column:
        words = [] if alone is None else [s.rlike(f"(?:{NONBLANK}++{BLANK}++){{{alone - 1}}}{NONBLANK}").alias("long")]
        return F.struct(i.alias("i"), F.xxhash64(s).alias("h"), F.xxhash64(s, F.lit(1)).alias("g"), s.rlike(NONBLANK).alias("full"), *words)

    lines = F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x["full"])
    lines = F.transform(lines, lambda x: x.dropFields("full"))
    # hashes of lines, written once: texts aren't cut up again for every step
    d = written(docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("seq")))
    later = _later_runs(d, run)
    if alone is not None:
        later = later.unionByName(_later_lines(d.select("doc_id", "text_hash", F.filter("seq", lambda x: x["long"]).alias("seq"))))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("cut"))).alias("cut"))


def _later_lines(d: DataFrame) -> DataFrame:
    """(doc_id, text_hash, cut): every line of `seq` that an earlier one equals.  In windows of one line every
    line is selected and has one way to be extended, so lines are met as they are."""
    found = d.select("doc_id", "text_hash", F.explode("seq").alias("x")).select("doc_id", "text_hash", F.col("x.i").alias("i"), F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    return _later(found, ["h", "g"], "i").select("doc_id", "text_hash", F.array("i").alias("cut"))


def _later(found: DataFrame, key: list[str], start: str) -> DataFrame:
    """The rows whose key an earlier place has: keys met once are left out before the join back."""
    place = F.struct("doc_id", "text_hash", start)
    first = found.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("final")).filter("first < final").drop("final")
    return found.join(first, key).filter(place > F.col("first"))


def _later_runs(d: DataFrame, run: int) -> DataFrame:
    """(doc_id, text_hash, cut): the lines of every later repeat that a selected line shows, from the lines `seq`."""
    d = d.filter(F.size("seq") >= run)
    last = F.size("seq") - run  # start of the last run

    def smallest(start: Column) -> Column:
        """Place of the selected line among `run` lines."""
        return -F.array_min(F.transform(F.sequence(start, start + run - 1), lambda j: F.struct(F.get("seq", j)["h"].alias("h"), (-j).alias("at"))))["at"]

    d = d.withColumn("at", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), last), smallest))))
    offsets = F.filter(F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda o: F.struct(o.alias("o"), (F.col("at") - o).alias("start"))), lambda x: (x["start"] >= 0) & (x["start"] <= last))

    def context(start: Column, part: str) -> Column:
        return F.xxhash64(F.transform(F.slice("seq", start + 1, run), lambda x: x[part]))

    ways = F.transform(offsets, lambda x: F.struct(x["o"].alias("o"), x["start"].alias("start"), context(x["start"], "h").alias("k1"), context(x["start"], "g").alias("k2"), F.transform(F.slice("seq", x["start"] + 1, run), lambda y: y["i"]).alias("cut")))
    found = d.select("doc_id", "text_hash", F.get("seq", F.col("at"))["h"].alias("line"), F.explode(ways).alias("w")).select("doc_id", "text_hash", "line", "w.*")
    return _later(found, ["line", "o", "k1", "k2"], "start").select("doc_id", "text_hash", "cut")


def drop_repeated_lines(docs: DataFrame, run: int = 2, alone: int | None = None) -> DataFrame:
    """(row, text, n_lines, n_removed): every document (all columns, in the struct `row`) with its text
    after the cut, its number of lines with a word, and how many of them went."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    cut = repeated_lines(docs, run, alone)
    j = rows.join(cut, rows["id"].eqNullSafe(cut["doc_id"]) & (rows["th"] == cut["text_hash"]), "left")
    parts = F.split("row.text", "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(parts, i)), "\n"))
    full = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda s: s.rlike(NONBLANK))))
    return j.select("row", text.alias("text"), full.alias("n_lines"), F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).alias("n_removed"))
