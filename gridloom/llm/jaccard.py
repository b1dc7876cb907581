"""Groups of texts with similar sets of 5-word shingles, by filters under several global token orders.

A set of n shingles that reaches the threshold t with another shares a token with it among its first
n - ceil(t n) + 1 tokens, under any order that is the same for all sets.  Every order used here puts
rare tokens first (by frequency classes from a count sketch of fixed size over all texts) and breaks
ties by its own seeded hash.

* Texts with equal sets form one class; a class is known by a 64-bit hash of its set and goes on once
  per batch, so copies are gone before anything is shuffled.
* The first order's prefix tokens are posted with their places; two classes are only proposed by a token whose
  places and sizes leave room for enough common tokens, and a place without any such partner is dropped at
  once.  Proposals of a
  token are not all its pairs: in each turn every class is proposed to one pivot, a class that has the
  token early.  After a turn, links
  are contracted to components, and a token whose classes all lie in one component is done.  When turns
  stop to pay (few pairs between different components are left, or no progress is made), all pairs
  between different components are proposed.  No pair that could join two components is left out.
* A class has a signature of about a bit a token: bit h is odd when an odd number of its tokens falls on h.
  Two signatures differ in no more bits than their sets in tokens, so what differs in too many bits for the
  threshold goes before any set is fetched.
* A proposal must also share a prefix token under each further order; what passes all filters is
  verified exactly on the two sets, which travel once for each pair: 100 * common >= 80 * union.

Defined cases: null texts and texts without a word have empty sets, n_shingles 0, and are their own
component; fewer than five words make one shingle of the whole; rows with the same doc_id are rows of
their own.  An empty table gives an empty result; columns of any name pass through `drop_similar`.
Two different sets share a 64-bit class with a probability of N^2 / 2^65 for N texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType

from gridloom.llm.tables import bit_field, components, count, marks, scratch, written
from gridloom.llm.words import U, chunks, give_back, mix, words

WIDTH = 5
CELLS, BLOCKS = 1 << 20, 64  # of the count sketch: its size never grows
ORDERS = (101, 202, 303)


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in chunks(texts):
        w = words(part, lower=True)
        g, off = w.grams(WIDTH)
        for r in range(len(part)):
            if off[r + 1] > off[r]:
                yield np.unique(g[off[r] : off[r + 1]])
            elif w.at[r + 1] > w.at[r]:
                h = w.hash[w.at[r] : w.at[r + 1]]
                yield mix((h * np.array([3, 7, 31, 127], U)[: len(h)]).sum(dtype=U, keepdims=True), 10 + len(h))
            else:
                yield np.empty(0, U)


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """Half powers of two of the counts in each cell of a sketch over all shingles: a MB, whatever the input."""
    size = CELLS // BLOCKS

    def blocks(total: np.ndarray):
        return pa.record_batch({"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array([total[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)], pa.binary())})

    def counted(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, part in chunks(b.column(0)):
                g, _ = words(part, lower=True).grams(WIDTH)
                total += np.bincount((g >> U(44)).astype(np.int64), minlength=CELLS)
        give_back()
        if total.any():
            yield blocks(total)

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        for k, c in sums.items():
            yield pa.record_batch({"block": pa.array([k], pa.int32()), "counts": pa.array([np.minimum(2 * np.log2(1.0 + c), 255).astype(np.uint8).tobytes()], pa.binary())})

    kind = "block int, counts binary"
    got = docs.select("text").mapInArrow(counted, kind).repartition(BLOCKS, "block").mapInArrow(added, kind).collect()
    out = np.zeros(CELLS, np.uint8)
    for r in got:
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return out


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The tokens of a set that any set similar to it must share one of, in an order's sequence."""
    n = len(tokens)
    p = n - -(-percent * n // 100) + 1
    key = (classes[(tokens >> U(44)).astype(np.int64)].astype(U) << U(56)) | (mix(tokens, order) >> U(8))
    first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    return tokens[first[np.argsort(key[first])]]


def signature(hashes: np.ndarray) -> bytes:
    """The parities of a set's hashes in 2^k ranges, k by its size; a shorter one is a longer one with neighbours added."""
    log = max(6, (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes >> U(64 - log)).astype(np.int64), minlength=1 << log) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A number of tokens in which two sets differ at least, by their signatures."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    if len(x) != len(y):
        x, y = (np.bitwise_xor.reduce(s.reshape(min(len(x), len(y)), -1), axis=1) for s in (x, y))
    return int(np.count_nonzero(x != y))


def similar_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id): one row per row of `docs` (doc_id, text); the
    component is the smallest doc_id reachable by links."""
    return _grouped(docs, percent).drop("root")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """Groups with their `root`, one class of the component: it tells components apart that have the same smallest
    doc_id, or none.  Null for empty sets.  Only this result stays; the tables on the way are deleted."""
    with scratch(docs.sparkSession):
        return written(_linked(docs, percent), outlives=True)


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs))

    @F.arrow_udf("n int, cls long, post array<long>, sig binary")
    def described(texts: pa.Array) -> pa.Array:
        n, cls, post, sig, seen = [], [], [], [], set()
        for s in shingles(texts):
            n.append(len(s))
            h = mix(s, 1)
            c = int(mix(h.sum(dtype=U, keepdims=True) ^ mix(np.array([len(s)], U), 2), 3).view(np.int64)[0]) if len(s) else None
            cls.append(c)
            new = len(s) > 0 and c not in seen
            post.append(prefix(s, classes.value, ORDERS[0], percent).view(np.int64) if new else None)
            sig.append(signature(h) if new else None)
            seen.add(c)
        give_back()
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(post, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["n", "cls", "post", "sig"])

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), described.asNondeterministic()("text").alias("x"))
    d = written(d.select("doc_id", "th", "x.*"), batch=1000)
    # `lower`: at this place the set may still be similar to one of its own size or larger
    low = f"{100 + percent} * (n - at) >= {2 * percent} * n"
    posted = d.filter("post is not null").select(F.posexplode("post").alias("at", "token"), "cls", "n")
    posted = posted.select("token", "cls", F.expr("shiftleft(bigint(n), 32) | at").alias("n_at"))  # narrow rows for the shuffle
    by_token = "over (partition by token)"
    met = posted.select("*", F.expr(f"min(cls) {by_token}").alias("least"), F.expr(f"max(cls) {by_token}").alias("most")).filter("least < most")
    met = met.selectExpr("token", "cls", "int(shiftright(n_at, 32)) n", "int(n_at & 4294967295) at").distinct()
    # `room`: a partner of up to this size (times the percentage) has enough tokens left, a larger one hasn't
    by_size = "over (partition by token order by n, cls"
    met = met.withColumn("room", F.expr(f"{100 + percent} * bigint(n - at) - {percent} * bigint(n)"))
    met = met.select("*", F.expr(f"lead(n) {by_size})").alias("larger"), F.expr(f"max(room) {by_size} rows between unbounded preceding and 1 preceding)").alias("smaller"))
    met = met.filter(f"room >= {percent} * bigint(larger) or smaller >= {percent} * bigint(n)")
    met = written(met.select("token", "cls", "n", "at", F.expr(low).alias("lower")))

    # a text and the signature of each class, fetched only for classes that are proposed
    one = d.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    one = written(one.select(F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th"), "cls", "n", "sig"))

    @F.arrow_udf(BooleanType())
    def alike(n: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([(100 + percent) * differing(x.as_buffer(), y.as_buffer()) <= (100 - percent) * k for k, x, y in zip(n.to_pylist(), a, b, strict=True)], pa.bool_())

    def with_sets(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with both sets x and y: a set is fetched once and goes to each of its pairs."""
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
        wanted = written(ends.join(one.select("one_id", "one_th", "cls"), "cls"))
        field = spark.sparkContext.broadcast(bit_field(wanted.select("one_th")))

        # one function sorts texts out and packs the rest: two in a stage would be two workers a task
        @F.arrow_udf(BinaryType())
        def packed(th: pa.Array, t: pa.Array) -> pa.Array:
            use = marks(field.value, th.to_numpy(zero_copy_only=False).astype(np.int64).view(U)) & t.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(use)
            out: list[bytes | None] = [None] * len(t)
            for i, s in zip(at, shingles(t.take(pa.array(at))), strict=True):
                out[i] = s.tobytes()
            return pa.array(out, pa.binary())

        texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
        texts = texts.select("doc_id", "th", packed.asNondeterministic()("th", "text").alias("tokens")).filter("tokens is not null")
        sets = wanted.join(texts, F.col("one_id").eqNullSafe(F.col("doc_id")) & (F.col("one_th") == F.col("th")))
        return sets.groupBy("a", "b").agg(*[F.max(F.when(F.col("cls") == F.col(k), F.col("tokens"))).alias(v) for k, v in (("a", "x"), ("b", "y"))])

    @F.arrow_udf(BooleanType())
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            ok = True
            for order in ORDERS[1:]:
                if ok:
                    ok = bool(np.isin(prefix(x, classes.value, order, percent), prefix(y, classes.value, order, percent)).any())
            if ok:
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok = 100 * common >= percent * (len(x) + len(y) - common)
            out.append(ok)
        give_back()
        return pa.array(out, pa.bool_())

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that pass all filters and the exact test."""
        p = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for k in "ab":
            p = p.join(one.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")), k)
        near = alike.asNondeterministic()(F.expr("bigint(n_a) + n_b"), "sig_a", "sig_b")
        p = written(p.withColumn("ok", near).filter("ok").select("a", "b"), batch=1000)
        return with_sets(p).withColumn("ok", agree.asNondeterministic()("x", "y")).filter("ok").select("a", "b")

    # a first common token at these places leaves room for enough common tokens
    near = f"root <> other and {100 + percent} * least(n - at, m - place) >= {percent} * (n + m)"
    other = [F.col("cls").alias("b"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("root").alias("other")]
    links, root, turn, before = None, None, 0, None
    open_ = met.withColumn("root", F.col("cls"))
    while True:
        parts = open_.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("lower").cast("long")).alias("low")).groupBy("token")
        parts = parts.agg((F.sum("k") * F.sum("low") - F.sum(F.col("k") * F.col("low"))).alias("pairs"), F.sum("k").alias("k")).filter("pairs > 0")
        left = parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not left["rows"]:
            break
        if turn:  # at first every token left has a pair
            open_ = written(open_.join(parts.select("token"), "token", "left_semi"))
        last = turn > 0 and (left["pairs"] <= 4 * left["rows"] or left["pairs"] > before / 2)
        before = left["pairs"]
        low = open_.filter("lower")
        if last:  # of two sets the smaller one must be `lower`
            pairs = open_.join(low.select("token", *other), "token").filter(f"{near} and struct(m, b) < struct(n, cls)")
        else:
            # rare tokens come first, so the set with a token at the smallest place has least of its own: it is
            # likely the one that others were made from; every second turn another component is tried
            rank = [F.lit(0), F.col("at")] if turn % 2 == 0 else [F.xxhash64("root", F.lit(turn)), F.col("at")]
            pivot = low.groupBy("token").agg(F.min(F.struct(rank[0].alias("r"), rank[1].alias("s"), F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "at", "root")).alias("p")).select("token", "p.cls", "p.n", "p.at", "p.root")
            pairs = open_.join(pivot.select("token", *other), "token").filter(near)
        new = written(verified(pairs.select(F.col("cls").alias("a"), "b")), batch=250)
        links = new if links is None else links.union(new)
        root = components(links)
        if last:
            break
        turn += 1
        open_ = open_.drop("root").join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    mine = d.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    if root is not None:
        tied = mine.join(root.withColumnRenamed("node", "cls"), "cls")
        least = tied.groupBy("root").agg(F.min("first").alias("least"))
        tied = tied.join(least, "root").select("cls", "root", "least")
        mine = mine.join(tied, "cls", "left").select("cls", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "cls").alias("root"))
    else:
        mine = mine.select("cls", F.col("first").alias("component_id"), F.col("cls").alias("root"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = d.drop("post", "sig").join(mine, "cls", "left")
    return out.select("doc_id", F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "root")


def drop_similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay.  Documents with
    empty sets all stay.  Rows that are equal in doc_id and text count as copies too; of different texts
    of a group under its smallest doc_id the one with the smallest hash stays.  A group without a
    doc_id keeps one as well; groups that share a doc_id, or have none, are groups of their own."""
    g = _grouped(docs, percent)
    keep = F.col("component_id").eqNullSafe(F.col("doc_id"))
    first = g.filter(keep & (F.col("n_shingles") > 0))
    twice = first.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.min("text_hash").alias("one")).filter("k > 1")
    twice = written(first.join(twice, "root").select("doc_id", "text_hash", "one"))
    gone = g.filter(~keep).select("doc_id", "text_hash").union(twice.filter("text_hash <> one").select("doc_id", "text_hash"))

    def matches(pairs: DataFrame, how: str, out: DataFrame) -> DataFrame:
        p = pairs.toDF("that_id", "that_hash").distinct()
        return out.join(p, out["doc_id"].eqNullSafe(p["that_id"]) & (F.xxhash64(out["text"]) == p["that_hash"]), how)

    out = matches(gone, "left_anti", docs)
    if not count(twice):
        return out
    again = twice.filter("text_hash = one").select("doc_id", "text_hash")
    return matches(again, "left_anti", out).unionByName(matches(again, "left_semi", out).dropDuplicates(["doc_id", "text"]))
