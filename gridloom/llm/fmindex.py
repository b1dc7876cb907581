"""Removal of repeated word windows with FM-indexes of shards.

A window is `window` consecutive words of one text; every word covered by a window whose words also
start anywhere else, in the same text too, goes.

* Of the `gram`-word grams of a window the one with the smallest hash stands for it, so equal windows
  have equal grams.  Consecutive windows with the same gram form a segment; a segment whose gram occurs
  nowhere else can't hold a repeated window and is dropped at once.
* Segments with equal words are one, with a number of copies.  Segments go to shards by their gram; the
  windows of a gram with more than `crowd` different segments go by their own hash, equal ones as one.
  So equal windows meet in one shard, and a passage that a third of all texts share is no hot shard.
* A shard concatenates its segments and builds an FM-index: suffix array by doubling, its
  Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts.  All segments are
  streamed through it from right to left: backward search extends every match by a word, and the
  longest common prefixes cut it back to one word less than a window, so each step gives the matching
  statistic up to the window's length and the interval of all occurrences.  Where a match of the whole
  window stands for two or more occurrences, copies counted, an interval is reported.

Defined cases: null reads as no words; texts shorter than a window keep all words; equal rows repeat
each other and lose what is long enough; windows are judged on the input, not on what is left.
Grams, segments and words are compared by 64-bit hashes (segments of one gram by both).  An empty table
gives an empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.tables import sieve, written
from gridloom.llm.words import U, _WORDS, chunks, mix, words

SEGMENTS = "array<struct<gram: long, content: long, first: int, n: int>>"


class Wavelet:
    """Wavelet matrix of a sequence of small integers: ranks of a symbol by one bit vector per bit."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels, self.n = max(1, int(symbols - 1).bit_length()), len(s)
        self.bits, self.ones, self.zeros = [], [], []
        for k in range(self.levels - 1, -1, -1):
            b = (s >> k) & 1
            raw = np.packbits(b.astype(np.uint8), bitorder="little")
            packed = np.zeros(len(s) // 64 + 1, U)
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(s) - b.sum()))
            s = np.concatenate([s[b == 0], s[b == 1]])
        self.start = self._place(np.arange(symbols), np.zeros(symbols, np.int64))

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, ones, zeros) in enumerate(zip(self.bits, self.ones, self.zeros, strict=True)):
            block = i >> 6
            r = ones[block] + np.bitwise_count(bits[block] & ((U(1) << (i & 63).astype(U)) - U(1)))
            i = np.where((c >> (self.levels - 1 - level)) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._place(c, i) - self.start[c]


class FMIndex:
    """FM-index of segments of words (as hashes), with the copies each segment stands for."""

    def __init__(self, parts: list[np.ndarray], copies: np.ndarray, window: int):
        self.window, self.sizes = window, np.array([len(p) for p in parts])
        at = np.cumsum(self.sizes + 1) - self.sizes - 1  # a separator stands before each segment
        _, ids = np.unique(np.concatenate(parts), return_inverse=True)
        n = int((self.sizes + 1).sum())
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[at] = False
        text[inner] = ids + 1
        self.at, self.text = at + 1, text
        # separators differ, so suffixes are told apart inside their segments
        rank = np.where(inner, text + len(parts), np.cumsum(~inner))
        ranks, h = [], 1
        _, rank = np.unique(rank, return_inverse=True)
        while True:
            ranks.append(rank)
            if h > self.sizes.max():
                break
            second = np.zeros(n, np.int64)
            second[:-h] = rank[h:] + 1
            _, rank = np.unique(rank * (n + 1) + second, return_inverse=True)
            h *= 2
        order = np.argsort(rank, kind="stable")
        prefix, a, b = np.zeros(n, np.int64), order[:-1], order[1:]
        run = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            ok = (np.maximum(a, b) + run < n) & (run + (1 << k) <= window)
            i, j = np.minimum(a + run, n - 1), np.minimum(b + run, n - 1)
            run += np.where(ok & (ranks[k][i] == ranks[k][j]), 1 << k, 0)
        prefix[1:] = run
        del ranks
        symbols = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.tree = Wavelet(text[order - 1], symbols)
        place = np.arange(n)
        cut = prefix < window - 1
        cut[0] = True
        self.first = np.maximum.accumulate(np.where(cut, place, 0))  # of the suffixes that agree in window - 1 words
        self.after = np.minimum.accumulate(np.concatenate([np.where(cut, place, n), [n]])[::-1])[::-1]
        owner = np.searchsorted(at, order, "right") - 1
        self.weight = np.concatenate([[0], np.cumsum(copies[owner])])

    def repeated(self) -> list[np.ndarray]:
        """For each segment the starts of windows that occur twice or more."""
        hits: list[list[int]] = [[] for _ in self.sizes]
        n = len(self.text)
        lanes = np.argsort(-self.sizes, kind="stable")
        size = self.sizes[lanes]
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), n, np.int64)
        for t in range(1, int(size.max()) + 1):
            live = int(np.searchsorted(-size, -t, "right"))
            lane, start = lanes[:live], size[:live] - t
            c = self.text[self.at[lane] + start]
            if t > self.window:  # make room for one more word
                lo[:live], hi[:live] = self.first[lo[:live]], self.after[hi[:live]]
            lo[:live] = self.before[c] + self.tree.rank(c, lo[:live])
            hi[:live] = self.before[c] + self.tree.rank(c, hi[:live])
            if t >= self.window:
                for k in np.flatnonzero(self.weight[hi[:live]] - self.weight[lo[:live]] >= 2):
                    hits[lane[k]].append(int(start[k]))
        return [np.array(x, np.int32) for x in hits]


def segments(texts: pa.Array, window: int, gram: int):
    """Per text: (grams, contents, first words, numbers of windows) of its segments."""
    wide = window - gram + 1
    for _, part in chunks(texts):
        w = words(part)
        g, off = w.grams(gram)
        up, down = _WORDS(len(w.hash) + 1)
        total = np.concatenate([[U(0)], np.cumsum(w.hash * up[:-1])])
        # place of the smallest gram among `wide` from each place on (the first of equal ones)
        at, have = np.arange(len(g)), 1
        key = mix(g, 4)
        while have < wide:
            shift = min(have, wide - have)
            left, right = at[: len(at) - shift], at[shift:]
            if not len(left):
                break
            at = np.where(key[right] < key[left], right, left)
            have += shift
        for r in range(len(part)):
            m = off[r + 1] - off[r] - wide + 1  # windows
            if m <= 0:
                yield None
                continue
            pick = at[off[r] : off[r] + m]
            first = np.concatenate([[0], np.flatnonzero(np.diff(pick)) + 1])
            n = np.diff(np.concatenate([first, [m]]))
            a = w.at[r] + first
            content = mix((total[a + n + window - 1] - total[a]) * down[a], 5) + mix(n.astype(U), 6)
            yield g[pick[first]].view(np.int64), content.view(np.int64), first, n


def drop_repeats(docs: DataFrame, window: int = 35, gram: int = 12, crowd: int = 2000, shard_words: int = 250_000) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256, spans): each row of `docs` (doc_id, text) with its
    kept words joined by one space, and the removed word ranges."""
    found_type = pa.list_(pa.struct([("gram", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]))

    @F.arrow_udf(SEGMENTS)
    def cut(texts: pa.Array) -> pa.Array:
        found = list(segments(texts, window, gram))
        some = [x for x in found if x is not None]
        flat = [np.concatenate([x[k] for x in some]) if some else np.empty(0) for k in range(4)]
        values = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, found_type.value_type, strict=True)], fields=list(found_type.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([0 if x is None else len(x[0]) for x in found])]), pa.int32()), values).cast(found_type)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("row"))
    every = rows.select("row", F.explode(cut.asNondeterministic()("text")).alias("s")).select("row", "s.*")
    met = every.withColumn("uses", F.expr("count(*) over (partition by gram)")).filter("uses > 1").drop("uses")
    met = written(met, batch=2000)
    kinds = met.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "n")).alias("one"))
    crowded = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("gram", F.lit(True).alias("crowded"))
    kinds = kinds.join(crowded, "gram", "left").select("gram", "content", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded"), "one.*")
    wanted = kinds.groupBy("row").agg(F.collect_list(F.struct("gram", "content", "copies", "crowded", "first", "n")).alias("wanted"))
    wanted = written(wanted)
    source = rows.filter(sieve(wanted.select("row"))(F.col("row"))).join(wanted, "row")

    def fetched(batches):
        """The words of the wanted segments, a few texts at a time; of crowded ones each window by itself."""
        for batch in batches:
            for first_row, part in chunks(batch.column("text")):
                w = words(part)
                lists = batch.column("wanted").slice(first_row, len(part))
                s = lists.flatten()
                col = {f: s.field(f).to_numpy(zero_copy_only=False) for f in ("gram", "content", "copies", "crowded", "first", "n")}
                start = np.repeat(w.at[:-1], lists.value_lengths().to_numpy()) + col["first"]
                crowded = col["crowded"].astype(bool)
                times = np.where(crowded, col["n"], 1)
                at = np.repeat(np.arange(len(start)), times)
                j = np.where(crowded[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), -1)
                for k in range(0, len(at), 20_000):
                    i, o = at[k : k + 20_000], j[k : k + 20_000]
                    size = np.where(o < 0, col["n"][i] + window - 1, window)
                    begin = start[i] + np.maximum(o, 0)
                    off = np.concatenate([[0], np.cumsum(size)])
                    data = w.hash[np.arange(off[-1]) + np.repeat(begin - off[:-1], size)]
                    up, _ = _WORDS(int(size.max(initial=1)))
                    key = mix(np.add.reduceat(data * up[np.arange(off[-1]) - np.repeat(off[:-1], size)], off[:-1]), 8).view(np.int64) if len(i) else np.empty(0, np.int64)
                    raw = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer((off * 8).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                    yield pa.record_batch({"gram": col["gram"][i], "content": col["content"][i], "copies": col["copies"][i], "part": o.astype(np.int32), "key": np.where(o < 0, col["content"][i], key), "words": raw})

    made = source.select("text", "wanted").mapInArrow(fetched, "gram long, content long, copies long, part int, key long, words binary")
    pieces = written(made.dropDuplicates(["gram", "content", "part"]), batch=500)
    single = pieces.filter("part >= 0").groupBy("gram", "key").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"), F.lit(True).alias("single"))
    whole = pieces.filter("part < 0").select("gram", "key", "copies", "words", F.lit(False).alias("single"))
    size = pieces.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    shards = max(1, int(-(-size // shard_words)))
    shard = F.when(F.col("single"), F.xxhash64("gram", "key")).otherwise(F.xxhash64("gram"))
    dealt = whole.unionByName(single).withColumn("shard", F.pmod(shard, F.lit(shards)).cast("int"))

    def indexed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gram", "ascending"), ("key", "ascending"), ("single", "ascending")])
        parts = [np.frombuffer(x.as_buffer(), U) for x in table.column("words")]
        hits = FMIndex(parts, table.column("copies").to_numpy(), window).repeated()
        some = np.array([k for k, x in enumerate(hits) if len(x)], np.int64)
        t = table.select(["gram", "key", "single"]).take(pa.array(some, pa.int64()))
        return t.append_column("hits", pa.array([hits[k] for k in some], pa.list_(pa.int32())))

    hits = written(dealt.groupBy("shard").applyInArrow(indexed, "gram long, key long, single boolean, hits array<int>"))
    plain = hits.filter("not single").select("gram", F.col("key").alias("content"), "hits")
    apart = pieces.filter("part >= 0").join(hits.filter("single").select("gram", "key"), ["gram", "key"], "left_semi")
    apart = apart.groupBy("gram", "content").agg(F.collect_list("part").alias("hits"))
    starts = met.join(plain.unionByName(apart), ["gram", "content"]).select("row", F.transform("hits", lambda j: j + F.col("first")).alias("starts")).distinct()
    starts = starts.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    @F.arrow_udf("text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: int, last: int>>")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        text, size, gone, digest, spans = [], [], [], [], []
        for first_row, part in chunks(texts):
            w = words(part)
            raw = w.data.tobytes()
            for r in range(len(part)):
                a, b = int(w.at[r]), int(w.at[r + 1])
                s = lists[first_row + r]
                change = np.zeros(b - a + 1, np.int32)
                if s.is_valid:
                    i = np.unique(s.values.to_numpy())
                    change[i] += 1
                    change[i + window] -= 1
                lost = np.cumsum(change[:-1]) > 0
                keep = np.flatnonzero(~lost) + a
                joined = b" ".join([raw[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                text.append(joined.decode())
                size.append(b - a)
                gone.append(int(lost.sum()))
                digest.append(hashlib.sha256(joined).hexdigest())
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)], ["text", "n_words", "n_removed", "kept_sha256", "spans"])

    # texts that the sieve stops have no hit for sure and stay where they are
    starts = written(starts)
    rows = rows.withColumn("hit", sieve(starts.select("row"))(F.col("row")))
    some = rows.filter("hit").join(starts, "row", "left").select("doc_id", "text", "starts")
    none = rows.filter("not hit").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    out = some.unionByName(none).select("doc_id", kept.asNondeterministic()("text", "starts").alias("k")).select("doc_id", "k.*")
    return written(out, batch=1000)
