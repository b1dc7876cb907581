"""Phrase collocations by best-first branch-and-bound growth.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and pieces into words.  A
phrase of 2 to `most` words that occurs `least` times or more is a candidate; its score is the lowest
floor(2000000 * a / (l + r)) over its cuts into a first part (l times) and a rest (r times).

Growth.  A phrase q with first word w bounds every phrase that begins with it: whatever such a phrase's
count x <= f(q) is, its rest after w occurs x times at least, so its score is at most
2000000 * f(q) / (f(w) + f(q)), which also holds for q and never rises along a prefix chain.  After words
and pairs are counted, each wave expands the frontier's best nodes of every language: one pass over the
texts counts all their extensions by one word, to the right (growth) and to the left (which, with those to
the right, decide whether a longer phrase covers the node: counts fall along a chain, so one word more is
enough to look at).  Parts of candidates that no expansion has counted are counted by the next wave.  It
ends when no node's bound and no open candidate reaches its language's `top`-th surviving score; ties of
that score are then settled too.  A wave takes four times as many nodes as the wave before.

Scale.  A pass turns a batch into word numbers, counts phrases in numpy and sends each distinct phrase of
a batch once, as a string, so counts are exact; only whether a phrase is sent at all hangs on bit fields
of fixed size, which let a few others pass.  Counting, parts, cover and thresholds are joins and
aggregates by (language, phrase), thresholds come from histograms of scores, and every wave is a written
table.  No language is gathered in one task.

Defined cases: a null text is empty, a null language is `und` and one with the language `und`; phrases
never cross documents; equal rows count once each; an empty table gives an empty result.  Only `text` and
`lang` are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from gridloom.llm.tables import bit_field, count, marks, written
from gridloom.llm.words import U, chunks, mix, words

SCALE = 2_000_000
#: bytes of text counted together, texts that go to a Python worker at once, rows it sends back at once
BLOCK, TEXTS, SENT = 1 << 20, 400, 20_000
#: what ends a piece, and what ends a word
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPLIT = _ENDS.copy()
_SPLIT[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)


def _grown(h: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words from those of k - 1 words and the last word."""
    return mix(h * U(0xD1342543DE82EF95) + word, k)


@F.arrow_udf(LongType())
def phrase_key(lang: pa.Array, phrase: pa.Array) -> pa.Array:
    """The key of a phrase in bit fields, the same that a pass gives it."""
    w = words(phrase, _SPLIT, lower=True)
    d = lang.dictionary_encode()
    h = _lang_hashes(d.dictionary.to_pylist())[d.indices.to_numpy()] if len(lang) else np.empty(0, U)
    n, at = np.diff(w.at), w.at[:-1]
    for k in range(1, int(n.max(initial=0)) + 1):
        more = n >= k
        h[more] = _grown(h[more], w.hash[at[more] + k - 1], k)
    return pa.array(h.view(np.int64))


def _fields(tables: dict[str, DataFrame]) -> dict:
    """A broadcast bit field for every table of (lang, phrase)."""
    return {name: t.sparkSession.sparkContext.broadcast(bit_field(t.select(phrase_key("lang", "phrase")))) for name, t in tables.items()}


def counted(texts: DataFrame, sizes: range, fields: dict, least: int = 1) -> DataFrame:
    """(lang, phrase, k, a): the exact counts of phrases of `sizes` words that occur `least` times or more.

    `fields` may hold `word` and `pair`, of which all words and pairs of a phrase must be, and `grow`
    and `need`: of longer phrases only those pass whose part without the last or first word is in
    `grow`, or that are in `need` themselves.
    """

    def block(lang: pa.Array, text: pa.Array):
        w = words(text, _SPLIT, lower=True)
        if not len(w.start):
            return
        size = w.end - w.start
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        letters = _LOWER[w.data[~_SPLIT[w.data]]]
        d = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        word, names = d.indices.to_numpy().astype(np.int64), d.dictionary
        langs = lang.dictionary_encode()
        row = np.repeat(np.arange(len(text)), np.diff(w.at))
        code = langs.indices.to_numpy().astype(np.int64)[row]
        ends = np.concatenate([[0], np.cumsum(_ENDS[w.data])])
        linked = (row[1:] == row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
        h = [_grown(_lang_hashes(langs.dictionary.to_pylist())[code], w.hash, 1)]  # by length - 1 and place
        ok = np.ones(len(word), bool)  # whether a phrase of k words may begin here
        fit = {name: marks(f.value, h[0]) for name, f in fields.items() if name == "word"}
        for k in range(1, sizes.stop):
            if k > 1:
                ok = ok[:-1] & linked[k - 2 :]
                h.append(_grown(h[-1][:-1], w.hash[k - 1 :], k))
            if "word" in fit:
                ok = ok & fit["word"][k - 1 :]
            if k == 2 and "pair" in fields:
                fit["pair"] = ok & marks(fields["pair"].value, h[1])
            if k >= 2 and "pair" in fit:
                ok = ok & fit["pair"][k - 2 :]
            if k not in sizes:
                continue
            at = np.flatnonzero(ok)
            if k > 2 and "grow" in fields:
                part = marks(fields["grow"].value, h[-2])
                hit = part[at] | part[at + 1]
                if "need" in fields:
                    hit |= marks(fields["need"].value, h[-1][at])
                at = at[hit]
            key = code[at] * len(names) + word[at]
            for j in range(1, k):
                key = np.unique(key, return_inverse=True)[1] * len(names) + word[at + j]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            if len(n):
                at = at[first]
                parts = [names.take(pa.array(word[at + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
                out = pa.record_batch({"lang": langs.dictionary.take(pa.array(code[at])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "k": pa.array(np.full(len(n), k, np.int32)), "a": pa.array(n)})
                yield from (out.slice(i, SENT) for i in range(0, len(n), SENT))

    def run(batches):
        for b in batches:
            for first, text in chunks(b.column(1), BLOCK):
                yield from block(b.column(0).slice(first, len(text)), text)

    sent = texts.mapInArrow(run, "lang string, phrase string, k int, a long")
    return sent.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def share(a: Column, total: Column) -> Column:
    """floor(SCALE * a / total), exact: products may pass 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(SCALE), total.cast("decimal(20,0)"))


def nodes_of(phrases: DataFrame, single: DataFrame) -> DataFrame:
    """Phrases with `bound`, the highest score of what begins with them."""
    first = single.select("lang", F.col("phrase").alias("w"), F.col("a").alias("f"))
    j = phrases.withColumn("w", F.substring_index("phrase", " ", 1)).join(first, ["lang", "w"])
    return j.select("lang", "phrase", "k", "a", share(F.col("a"), F.col("f") + F.col("a")).alias("bound"))


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases with l, r, score of the lowest cut, and `open`: how many cuts have an uncounted part."""
    cuts = phrases.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    w = F.split("phrase", " ")
    cuts = cuts.withColumn("x", F.array_join(F.slice(w, F.lit(1), F.col("j")), " ")).withColumn("y", F.array_join(F.slice(w, F.col("j") + 1, F.col("k")), " "))
    counts = known.select("lang", "phrase", "a")
    cuts = cuts.join(counts.toDF("lang", "x", "l"), ["lang", "x"], "left").join(counts.toDF("lang", "y", "r"), ["lang", "y"], "left")
    cut = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.struct(share(F.col("a"), F.col("l") + F.col("r")).alias("score"), "j", "l", "r"))
    g = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(cut).alias("c"), F.count_if(cut.isNull()).cast("int").alias("open"))
    return g.select("lang", "phrase", "k", "a", "c.l", "c.r", F.coalesce("c.score", F.lit(SCALE)).alias("score"), "open")


def reached(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(lang, level): the highest level that at least n rows of a language reach; 0 where there are fewer."""
    hist = rows.groupBy("lang", value).agg(F.count(F.lit(1)).alias("n"))  # at most SCALE / 2 values a language
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(F.col(value).desc()))
    return hist.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= n, F.col(value))), F.lit(0)).alias("level"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, most: int = 4, covered: int = 80, wave: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, count, phrase.

    A candidate goes when a longer one that holds it has `covered` % of its count or more.  `wave` is the
    number of nodes a language expands in the first wave, four times `top` unless given.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = written(counted(texts, range(1, 2), {}), batch=TEXTS)
    total = every.groupBy("lang").agg(F.sum("a").alias("n"))
    single = every.filter(F.col("a") >= least)
    pairs = written(counted(texts, range(2, 3), _fields({"word": single}), least), batch=TEXTS)
    pair = _fields({"pair": pairs})
    found = [pairs]  # counted phrases of two words or more, by wave
    nodes = [written(nodes_of(pairs, single))]
    done = pairs.select("lang", "phrase").filter("false")
    scores = [written(scored(pairs, single.unionByName(pairs)))]
    goal, size = total.select("lang", F.lit(0).alias("level")), wave or 4 * top
    while True:
        pending = union(nodes).filter(F.col("k") < most).join(goal, "lang").filter(F.col("bound") >= F.col("level")).drop("level").join(done, ["lang", "phrase"], "left_anti")
        best = reached(pending, "bound", size)
        grow = written(pending.join(best, "lang").filter(F.col("bound") >= F.col("level")).select("lang", "phrase"))
        need = written(open_parts(union(scores), union(found), goal))
        if not count(grow) and not count(need):
            break
        new = counted(texts, range(3, most + 1), pair | _fields({"grow": grow, "need": need}), least)
        new = written(new.join(union(found).select("lang", "phrase"), ["lang", "phrase"], "left_anti"), batch=TEXTS)
        found.append(new)
        done = written(done.union(grow))
        nodes.append(written(nodes_of(new, single)))
        # candidates with uncounted parts are scored again, now that more is counted
        again = union(scores)
        waiting = again.filter("open > 0").select("lang", "phrase", "k", "a").unionByName(new)
        scores = [written(again.filter("open = 0").unionByName(scored(waiting, single.unionByName(union(found)))))]
        goal = written(total.select("lang").join(reached(survivors(scores[0], union(found), done, most, covered), "score", top), "lang", "left").select("lang", F.coalesce("level", F.lit(0)).alias("level")))
        size *= 4
    last = survivors(union(scores), union(found), done, most, covered).join(goal, "lang").filter(F.col("score") >= F.col("level"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def open_parts(scores: DataFrame, found: DataFrame, goal: DataFrame) -> DataFrame:
    """Uncounted parts of candidates that may still reach their language's level."""
    c = scores.filter("open > 0").join(goal, "lang").filter(F.col("score") >= F.col("level"))
    w = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.array(F.array_join(F.slice(w, F.lit(1), j), " "), F.array_join(F.slice(w, j + 1, F.col("k")), " "))))
    p = c.select("lang", F.explode(parts).alias("phrase")).filter(F.size(F.split("phrase", " ")) > 2).distinct()
    return p.join(found.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def survivors(scores: DataFrame, found: DataFrame, done: DataFrame, most: int, covered: int) -> DataFrame:
    """Candidates with a final score whose longer ones are counted and don't cover them."""
    w = F.split("phrase", " ")
    sides = F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k")), " "))
    cover = found.filter("k > 2").select("lang", F.explode(sides).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    settled = scores.filter("open = 0").join(done.withColumn("seen", F.lit(True)), ["lang", "phrase"], "left").filter((F.col("k") == most) | F.col("seen"))
    j = settled.join(cover, ["lang", "phrase"], "left")
    return j.filter(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True))).drop("seen", "longer")
