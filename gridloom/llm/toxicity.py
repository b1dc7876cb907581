"""Toxic passages: maximum-scoring segments over token log-odds.

Learning, from a bounded, seeded sample of labelled rows (at most `max_docs` of either class):

* tokens are words and the beginnings of longer words (a word that tells nothing by itself may begin like
  words that do);
* of documents with the same smallest 5-word shingle (copies, mostly) one is learned from;
* a half gives every token a log-odds of toxic against clean documents, with an informative
  Dirichlet prior in proportion to the token's overall frequency; a fixed step is subtracted, so an
  ordinary token costs a little and only telling tokens earn;
* lambda of the extreme-value law is the root of  E[exp(lambda s)] = 1  over clean tokens;
* tokens are learned from one half for calibration, and again from both halves for the final scores;
* the other half calibrates: a Gumbel law is fitted to the best segment of its clean documents
  (lambda S - ln n), and a logistic curve turns the two statistics of a document into a score.

Scoring scans the tokens of a whole text once and finds all maximal-scoring segments (the linear
algorithm that keeps candidate segments on a stack); only earning tokens are visited one by one,
the costs between them come from a running sum.  A passage is significant if its expected number
of chance occurrences in a text of that length is at most `expect`.

Defined cases: a null or empty text has no passage and the score of a text without evidence, labels
that are null count as absent, repeated labels of one document count as toxic if any is.  Without a
toxic or a clean learning row every score is 0.  An empty table gives an empty result.  Columns of any name
pass through `drop_toxic`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from gridloom.llm.tables import written
from gridloom.llm.words import MARKS, chunks, give_back, words

HEADS = (4, 5, 6)  # bytes of a word's beginnings that count as tokens too
PASSAGES = "array<struct<first: int, last: int, score: double, expected: double>>"


@dataclass
class Model:
    token: np.ndarray  # sorted hashes of telling tokens
    gain: np.ndarray  # their scores
    cost: float  # score of any other token
    rate: float = 1.0  # lambda
    place: float = 0.0  # Gumbel location and scale of a clean document's best segment
    scale: float = 1.0
    curve: tuple[float, ...] | None = None
    expect: float = 0.05


def segments(at: np.ndarray, gain: np.ndarray, paid: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score): tokens `at` earn `gain` > 0, and paid[i] <= 0 is what
    all tokens before at[i] that don't earn cost together."""
    stack: list[tuple] = []
    earned = 0.0
    for i, g, p in zip(at.tolist(), gain.tolist(), paid.tolist(), strict=True):
        left = earned + p
        earned += g
        new = (i, i, left, earned + p)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], i, stack[j][2], new[3])
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def _scan(texts: pa.Array, m: Model):
    """Per row: number of tokens and maximal segments."""
    for _, part in chunks(texts):
        w = words(part, MARKS, lower=True)
        loss = np.full(len(w.hash), m.cost)
        if len(m.token) and len(w.hash):
            for h in (*(w.heads(n) for n in HEADS), w.hash):  # the whole word has the last say
                k = np.minimum(np.searchsorted(m.token, h), len(m.token) - 1)
                known = m.token[k] == h
                loss[known] = np.maximum(loss[known], m.gain[k][known]) if h is not w.hash else m.gain[k][known]
        hit = np.flatnonzero(loss > 0)
        run = np.concatenate([[0.0], np.cumsum(np.minimum(loss, 0))])
        row = np.searchsorted(hit, w.at)
        for r in range(len(part)):
            n = int(w.at[r + 1] - w.at[r])
            h = hit[row[r] : row[r + 1]]
            yield n, (segments(h - w.at[r], loss[h], run[h] - run[w.at[r]]) if len(h) else [])


def _evidence(n: int, found: list, m: Model) -> tuple[float, float]:
    """-log10 of the chance that a clean text has so good a best segment; the same summed over significant ones."""
    if not found:
        return 0.0, 0.0

    def bits(s: float) -> float:
        z = (m.rate * s - np.log(max(n, 1)) - m.place) / m.scale
        p = -np.expm1(-np.exp(-min(max(z, -30.0), 500.0)))
        return float(min(-np.log10(p) if p > 0 else z / np.log(10), 60.0))

    each = sorted((bits(s) for _, _, s in found), reverse=True)
    return each[0], float(sum(x for x in each if x >= 1.0))


def _probability(n: int, found: list, m: Model) -> float:
    if m.curve is None:
        return 0.0
    best, all_ = _evidence(n, found, m)
    c = m.curve
    z = c[0] + c[1] * np.log1p(best) + c[2] * np.log1p(all_)
    return float(1 / (1 + np.exp(-min(max(z, -500), 500))))


def _tokens(sample: DataFrame) -> DataFrame:
    """(half, token, toxic, clean): documents of either class with the token, added up within batches first."""

    def count(batches):
        for b in batches:
            toxic, half = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "half"))
            h, kind = [], []
            for first, part in chunks(b.column("text")):
                w = words(part, MARKS, lower=True)
                forms = [w.hash, *(w.heads(n) for n in HEADS)]
                for r in range(len(part)):
                    u = np.unique(np.concatenate([x[w.at[r] : w.at[r + 1]] for x in forms]))
                    h.append(u)
                    kind.append(np.full(len(u), 2 * half[first + r] + toxic[first + r]))
            if h:
                u, i = np.unique(np.concatenate(h), return_inverse=True)
                n = np.bincount(4 * i + np.concatenate(kind), minlength=4 * len(u)).reshape(-1, 4)
                for k in (0, 1):
                    some = n[:, 2 * k] + n[:, 2 * k + 1] > 0
                    yield pa.record_batch({"half": np.full(some.sum(), k, np.int64), "token": u.view(np.int64)[some], "toxic": n[some, 2 * k + 1], "clean": n[some, 2 * k]})

    out = sample.select("half", "text", "toxic").mapInArrow(count, "half long, token long, toxic long, clean long")
    return out.groupBy("half", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(found: DataFrame, prior: float, step: float, sure: float, expect: float) -> Model:
    """Scores of the telling tokens of some counts."""
    size = found.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not size["t"] or not size["c"]:
        return Model(np.empty(0, np.uint64), np.empty(0), -step)
    nt, nc = float(size["t"]), float(size["c"])
    a = F.lit(prior) * (F.col("toxic") + F.col("clean"))
    yt, yc, more = F.col("toxic") + a, F.col("clean") + a, prior * (nt + nc)
    odds = F.log(yt / (F.lit(nt + more) - yt)) - F.log(yc / (F.lit(nc + more) - yc))
    z = odds / F.sqrt(1 / yt + 1 / yc)
    kept = found.select("token", odds.alias("odds"), z.alias("z"), "clean").filter((F.abs("z") >= sure) & (F.abs("odds") > step)).toPandas()
    token = kept["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    m = Model(token[order], np.clip(kept["odds"].to_numpy(float)[order] - step, -4 * step, 12), -step, expect=expect)
    if (m.gain > 0).any():
        m.rate = _root(m.gain, np.maximum(kept["clean"].to_numpy(float)[order], 0.5) / nc, m.cost)
    return m


@F.arrow_udf(LongType())
def _cluster(texts: pa.Array) -> pa.Array:
    """Smallest 5-word shingle of a text (null without words)."""
    out = []
    for _, part in chunks(texts):
        w = words(part, MARKS, lower=True)
        g, off = w.grams(5)
        for r in range(len(part)):
            h = g[off[r] : off[r + 1]] if off[r + 1] > off[r] else w.hash[w.at[r] : w.at[r + 1]]
            out.append(int(h.view(np.int64).min()) if len(h) else None)
    return pa.array(out, pa.int64())


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, prior: float = 0.05, step: float = 0.7, sure: float = 2.5, expect: float = 0.05, where: Column | None = None) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic); `where` limits the labels learned from.

    `prior` is the Dirichlet prior's weight as a share of the counts.  At most `max_docs` labelled rows of either class are used, those with the smallest seeded hash;
    their ids are all that is broadcast.  What reaches the driver are the telling tokens of that
    bounded sample and two numbers for each document of its second half.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(where) if where is not None else known
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    ids = [known.filter(F.col("toxic") == F.lit(t)).orderBy(order, "doc_id").limit(max_docs) for t in (True, False)]
    ids = ids[0].unionByName(ids[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = written(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))).withColumn("cluster", _cluster("text")), batch=1000)
    one = sample.groupBy("cluster", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sample = sample.join(F.broadcast(one), "doc_id", "left_semi")
    sample = sample.withColumn("toxic", F.col("toxic").cast("int"))
    found = written(_tokens(sample), batch=1000)
    m = _odds(found.filter("half = 0"), prior, step, sure, expect)
    if not (m.gain > 0).any():
        return m

    def statistics(batches):
        for b in batches:
            y, rows = b.column("toxic").to_pylist(), []
            for k, (n, seg) in enumerate(_scan(b.column("text"), m)):
                rows.append((y[k], n, len(seg), *(max(s for _, _, s in seg) if seg else 0.0,), [s for _, _, s in seg]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["toxic", "n", "k", "best", "each"])

    seen = sample.filter("half = 1").select("toxic", "text").mapInArrow(statistics, "toxic int, n long, k long, best double, each array<double>").toPandas()
    y = seen["toxic"].to_numpy(bool) if len(seen) else np.empty(0, bool)
    if not y.any() or y.all():
        return m
    best = seen[~y & (seen["k"] > 0)]
    x = m.rate * best["best"].to_numpy() - np.log(np.maximum(best["n"].to_numpy(), 1))
    if len(x) >= 8 and x.std() > 0:  # moments of a Gumbel law
        m.scale = max(x.std() * np.sqrt(6) / np.pi, 0.3)
        m.place = x.mean() - 0.5772156649015329 * m.scale
    ev = np.array([_evidence(n, [(0, 0, s) for s in e], m) for n, e in zip(seen["n"], seen["each"], strict=True)])
    m.curve = _logistic(np.log1p(ev), y)
    every = _odds(found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), prior, step, sure, expect)
    m.token, m.gain = every.token, every.gain  # the calibration stays the one of tokens learned apart from it
    return m


def _root(gain: np.ndarray, share: np.ndarray, cost: float) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1 over clean tokens, by bisection."""
    rest = max(1 - share.sum(), 1e-9)

    def excess(k: float) -> float:
        return float((share * np.exp(np.minimum(k * gain, 300))).sum() + rest * np.exp(k * cost) - 1)

    hi = 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and non-negative slopes by Newton steps with a small ridge."""
    use = [0, 1]
    while True:
        a = np.column_stack([np.ones(len(y)), x[:, use]])
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + 1e-2 * w
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
            d = np.linalg.solve(h, g)
            w -= d
            if np.abs(d).max() < 1e-8:
                break
        bad = [u for u, v in zip(use, w[1:], strict=True) if v < 0]
        if not bad or len(use) == 1:
            break
        use = [u for u in use if u not in bad] or [0]
    out = [float(w[0]), 0.0, 0.0]
    for u, v in zip(use, w[1:], strict=True):
        out[1 + u] = max(float(v), 0.0)
    return tuple(out)


def scored(text: Column | str, m: Model) -> Column:
    """struct(score, tokens, passages): the significant passages of a whole text as word ranges."""

    @F.arrow_udf(f"score double, tokens int, passages {PASSAGES}")
    def toxic(texts: pa.Array) -> pa.Array:
        score, size, spans = [], [], []
        for n, seg in _scan(texts, m):
            score.append(_probability(n, seg, m))
            size.append(n)
            e = [(a, b, s, float(np.exp(min(np.log(n) + m.place - m.rate * s, 50)))) for a, b, s in seg]
            spans.append([dict(zip(("first", "last", "score", "expected"), x, strict=True)) for x in e if x[3] <= m.expect])
        give_back()
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(size, pa.int32()), pa.array(spans, kind)], ["score", "tokens", "passages"])

    return toxic.asNondeterministic()(text)  # so that a later filter doesn't run it twice


def score_documents(docs: DataFrame, m: Model, held_out: Column) -> DataFrame:
    s = docs.select("doc_id", held_out.alias("held_out"), scored("text", m).alias("s"))
    return s.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.tokens").alias("n_tokens"), F.size("s.passages").alias("n_passages"), F.col("s.passages").alias("passages"))


def drop_toxic(docs: DataFrame, m: Model) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(F.struct(*cols).alias("row"), scored("text", m).alias("s")).filter("s.score < 0.5")
    return kept.select("row.*")

