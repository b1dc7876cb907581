"""Language identification by a linear-chain conditional random field over words.

A word's evidence is the sum of learned weights of its affixes (1 to 4 bytes), its byte n-grams (2 to
4) and its entries in a lexicon of each language; learned transitions tie neighbouring words, so words
of code-switched text get their own language.  Forward-backward gives every word's marginal
probabilities; a document's language has the largest mean over words with a letter, and that mean is
its score.

The field is fitted on the driver to a bounded, seeded sample of labelled rows: at most `max_rows` rows
of each language and from each at most `window` consecutive words at a hashed place.  Sequences to
learn from splice pieces of several languages, so the transitions have seen switches.  Prediction reads
whole texts.

Defined cases: `und` with score 0 for null texts, texts without a letter, and when no language could be
learned; equal means go to the language first in code point order.  An empty table gives an empty result;
only doc_id, text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.llm.words import U, Words, chunks, mix, words

BITS = 16
CHUNK = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ALPHA = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


@dataclass
class Field:
    languages: list[str]
    weight: np.ndarray  # 2^BITS x languages: affixes and n-grams
    lexicon: np.ndarray  # sorted hashes of frequent words
    entry: np.ndarray  # log share of each lexicon word by language
    trust: np.ndarray  # languages x languages: what a lexicon entry says
    move: np.ndarray  # transitions
    first: np.ndarray


def _features(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature) pairs of the chosen words of `w`, and whether each word has a letter."""
    start, size = w.start[which], w.end[which] - w.start[which]
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    data = _LOWER[w.data[at]]
    off = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(which)), size)
    letter = np.zeros(len(which), bool)
    letter[word[_ALPHA[data]]] = True
    high = np.zeros(len(which), bool)
    high[word[data >= 128]] = True
    for i in np.flatnonzero(high & ~letter):
        letter[i] = any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "ignore"))
    owner, feature = [], []
    code = np.zeros(len(data) + 4, U)
    code[: len(data)] = data.astype(U) + U(1)
    left = size[word] - (np.arange(len(data)) - off[word])  # bytes from here to the word's end
    here = np.zeros(len(data), U)
    for n in range(1, 5):
        here = here * U(257) + code[n - 1 : n - 1 + len(data)]
        fits = left >= n
        h = mix(here, n)
        if n > 1:
            owner.append(word[fits])
            feature.append(h[fits] >> U(64 - BITS))
        pre = np.flatnonzero(size >= n)
        owner.append(pre)
        feature.append(mix(h[off[pre]], 20) >> U(64 - BITS))
        owner.append(pre)
        feature.append(mix(h[off[pre + 1] - n], 30) >> U(64 - BITS))
    return np.concatenate(owner), np.concatenate(feature).astype(np.int64), letter


def _lexical(f: Field, h: np.ndarray) -> np.ndarray:
    """Lexicon entries (words x languages), zero for unknown words."""
    out = np.zeros((len(h), len(f.languages)))
    if len(f.lexicon):
        k = np.minimum(np.searchsorted(f.lexicon, h), len(f.lexicon) - 1)
        known = f.lexicon[k] == h
        out[known] = f.entry[k[known]]
    return out


def _emissions(f: Field, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials of every word, and which words have a letter; distinct words are looked at once."""
    h, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
    owner, feature, letter = _features(w, one)
    e = np.column_stack([np.bincount(owner, f.weight[feature, k], len(h)) for k in range(len(f.languages))]) + _lexical(f, h) @ f.trust
    e[~letter] = 0
    return e[back], letter[back]


def marginals(e: np.ndarray, at: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: marginal probabilities of all words of all rows (row r has words at[r]:at[r+1])."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    p = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    a, step = np.empty_like(p), np.exp(move)
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # rows with a word t
    f = None
    for t, n in enumerate(live):
        i = begin[:n] + t
        f = p[i] * (np.exp(first) if t == 0 else f[:n] @ step)
        f /= f.sum(axis=1, keepdims=True)
        a[i] = f
    b = None
    for t in range(len(live) - 1, -1, -1):
        n, later = live[t], live[t + 1] if t + 1 < len(live) else 0
        new = np.ones((n, p.shape[1]))
        if later:
            i = begin[:later] + t + 1
            new[:later] = (p[i] * b[:later]) @ step.T
            new[:later] /= new[:later].sum(axis=1, keepdims=True)
        i = begin[:n] + t
        a[i] *= new
        b = new
    return a / a.sum(axis=1, keepdims=True) if len(a) else a


def _pair_counts(e, at, move, first, m):
    """Expected transitions and starts under the field, from the marginals' own messages."""
    p = np.exp(e - e.max(axis=1, keepdims=True))
    step = np.exp(move)
    total, starts = np.zeros_like(move), m[at[:-1][np.diff(at) > 0]].sum(axis=0)
    inner = np.ones(len(e), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    i = np.flatnonzero(inner)
    # forward messages again, in one sweep over positions
    size = np.diff(at)
    f = np.empty_like(p)
    for t in range(size.max()):
        r = at[:-1][size > t] + t
        g = p[r] * (np.exp(first) if t == 0 else f[r - 1] @ step)
        f[r] = g / g.sum(axis=1, keepdims=True)
    back = m[i] / np.maximum(f[i], 1e-300) * p[i]  # what the future says of word i, times its own potential
    joint = f[i - 1][:, :, None] * step[None] * back[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return total + joint.sum(axis=0), starts


def fit(texts: list[str], labels: list[str], window: int = 40, seed: int = 1, turns: int = 60) -> Field:
    """Fit the field to labelled texts: splice their windows into sequences and climb the likelihood."""
    names = sorted(set(labels))
    n = len(names)
    rng = np.random.default_rng(seed)
    parts, tags = [], []
    for t, y in zip(texts, labels, strict=True):
        ws = t.split()
        if ws:
            i = int(rng.integers(0, max(1, len(ws) - window + 1)))
            ws = ws[i : i + window]
            cuts = sorted(rng.integers(0, len(ws) + 1, 2).tolist())
            for a, b in ((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], len(ws))):
                if b > a:
                    parts.append(ws[a:b])
                    tags.append(names.index(y))
    empty = Field(names, np.zeros((1 << BITS, n)), np.empty(0, U), np.zeros((0, n)), np.zeros((n, n)), np.zeros((n, n)), np.zeros(n))
    if not parts:
        return empty
    order = rng.permutation(len(parts))
    rows, y = [], []
    for k in range(0, len(order), 3):
        some = order[k : k + 3]
        rows.append(" ".join(w for i in some for w in parts[i]))
        y += [tags[i] for i in some for _ in parts[i]]
    y = np.array(y)
    w = words(pa.array(rows, pa.large_string()))
    h, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
    owner, feature, letter = _features(w, one)
    count = np.zeros((len(h), n))
    np.add.at(count, (back, y), 1)
    f = empty
    keep = (count.sum(axis=1) >= 3) & letter
    share = (count[keep] + 0.5) / (count[keep].sum(axis=1, keepdims=True) + 0.5 * n)
    f.lexicon, f.entry = h[keep], np.log(share * n)
    lex = _lexical(f, h)
    gold = np.zeros((len(y), n))
    gold[np.arange(len(y)), y] = 1
    use = letter[back]
    starts = np.zeros(len(y), bool)
    starts[w.at[:-1]] = True
    pairs = np.zeros((n, n))
    i = np.flatnonzero(~starts)
    np.add.at(pairs, (y[i - 1], y[i]), 1)
    firsts = gold[starts].sum(axis=0)
    params = [f.weight, f.trust, f.move, f.first]
    sums = [np.full_like(p, 1e-8) for p in params]
    for _ in range(turns):  # adaptive gradient steps on the penalized log likelihood
        e = np.column_stack([np.bincount(owner, f.weight[feature, k], len(h)) for k in range(n)]) + lex @ f.trust
        e[~letter] = 0
        e = e[back]
        m = marginals(e, w.at, f.move, f.first)
        diff = np.where(use[:, None], gold - m, 0)
        by_word = np.zeros((len(h), n))
        np.add.at(by_word, back, diff)
        grad = np.column_stack([np.bincount(feature, by_word[owner, k], 1 << BITS) for k in range(n)])
        got, begun = _pair_counts(e, w.at, f.move, f.first, m)
        for p, g, s in zip(params, [grad - 0.1 * f.weight, lex.T @ by_word - 0.1 * f.trust, pairs - got - 0.1 * f.move, firsts - begun - 0.1 * f.first], sums, strict=True):
            s += g * g
            p += 0.2 * g / np.sqrt(s)
    return f


def learn(docs: DataFrame, where: Column, max_rows: int = 400, **shape) -> Field:
    """Fit to at most `max_rows` rows of each non-null `lang` among the rows that meet `where`."""
    place = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    ids = docs.filter(where).filter("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn("k", F.row_number().over(place)).filter(F.col("k") <= max_rows).select("doc_id")
    rows = docs.filter(where).filter("lang is not null and text is not null").select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    window = shape.get("window", 40)
    parts = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    size = F.greatest(F.size(parts) - window, F.lit(0)) + 1
    some = F.array_join(F.slice(parts, (F.pmod(F.xxhash64("doc_id"), size.cast("long")) + 1).cast("int"), window), " ")
    got = rows.select("doc_id", "lang", some.alias("text")).orderBy("doc_id", "lang", "text").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got], **shape)


def predicted(text: Column | str, f: Field) -> Column:
    """struct(lang, score, n_words, switched): `switched` is the share of words in another language."""

    @F.arrow_udf("lang string, score double, n_words int, switched double")
    def label(texts: pa.Array) -> pa.Array:
        lang, score, size, switched = [], [], [], []
        for _, part in chunks(texts, CHUNK):
            w = words(part)
            if len(w.hash) and f.languages:
                e, letter = _emissions(f, w)
                m = marginals(e, w.at, f.move, f.first)
                best = m.argmax(axis=1)
            for r in range(len(part)):
                a, b = w.at[r], w.at[r + 1]
                use = np.flatnonzero(letter[a:b]) + a if b > a and f.languages else ()
                size.append(int(b - a))
                if not len(use):
                    lang.append("und")
                    score.append(0.0)
                    switched.append(0.0)
                    continue
                mean = m[use].mean(axis=0)
                k = int(mean.argmax())
                lang.append(f.languages[k])
                score.append(float(min(mean[k], 1.0)))
                switched.append(float((best[use] != k).mean()))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32()), pa.array(switched, pa.float64())], ["lang", "score", "n_words", "switched"])

    return label.asNondeterministic()(text)
