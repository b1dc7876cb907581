"""Piece encoding, resampling and collocations against their library, brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import collocations, pieces, resample
from gridloom.llm.tables import marks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, row string, buckets string, score string, a string, phrase string, `my-col` string"
LONG = " ".join(f"w{i % 97}" for i in range(250_000))  # over one block of 1 MB
ODD = ["", " ", "  a  ", "\t\n x\x00", "▁▁x ▁", "<s></s><unk><0x41>", "ＡＢ① 😀‍ \U0010ffff", "中文 字符, の", "a" * 5000, " " * 3000 + "the", "\r\n.;.!?\x0b\x0c", "Éa É. B"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = [f"t{i}" for i in range(12)] + ["The", "of", "état", "中文"]
    texts = []
    for i in range(240):
        n = r.randint(1, 90)
        texts.append("".join(words[min(int(r.expovariate(0.35)), len(words) - 1)] + r.choice([" ", " ", " ", " ", "\t", ". ", ", ", "\n"]) for _ in range(n)))
    rows = [(i, t, ["en", "de", None, "und"][i % 4] if i > 60 else "en", "s") for i, t in enumerate(texts)]
    rows += [(1000 + i, t, "xx", None) for i, t in enumerate(ODD)] + [(2000, None, None, None), (None, "null id t1 t2", "en", "s"), (None, None, "en", "s")]
    rows += [(3000, LONG, "en", "s")] + [(3001, texts[3], "en", "s")] * 3 + [(3001, "another text under one id", "de", "s")]
    return spark.createDataFrame([(*x, "r", "b", "c", "d", "p", "m") for x in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return pieces.Encoder(pieces.read_model(f.read()))


def test_pieces_equal_library(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(8)
    every = list(encoder.score)
    alphabets = ["abcdefgh ", "theing  ", "▁ a\t\n", " ", "éèñßабвгдежз中文字符日本語 ", "0123456789.,- ", "aeiourstln", "😀‍́x \x00"]
    texts = ODD + ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in alphabets for _ in range(400)]
    texts += ["".join(r.choice(every) for _ in range(r.randint(1, 8))) for _ in range(3000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == sp.encode(t), t
        assert encoder.decode(ids) == sp.decode(ids), t


def test_pieces_long_words(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(9)
    for t in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "ab" * 50_000, "\U0010ffff" * 20_000):
        assert encoder.encode(t) == sp.encode(t)


def test_pieces_need_backtracking(encoder):
    """The longest match from the left isn't always right: the failed place is left for good."""
    greedy = 0
    for word in ("▁" + w for w in ("tokenization", "unbelievable", "international", "straightforward", "nonetheless", "hasnt", "wouldve")):
        got, longest, at = encoder.split(word), [], 0
        while at < len(word):
            longest.append(next((word[at : at + n] for n in range(len(word) - at, 0, -1) if word[at : at + n] in encoder.score), word[at]))
            at += len(longest[-1])
        assert got == encoder.merged(word)
        greedy += got == longest
    assert greedy < 7


def test_decode_of_broken_ids(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for ids in ([], [3 + 0xE3, 3 + 0x81, 300], [3 + 0xFF], [259, 3 + 0x41], [1, 259], [3 + 0x20, 300]):
        assert encoder.decode(ids) == sp.decode(ids)


def test_pieces_column(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = docs.select("text", pieces.coded(spark, F.col("text"), MODEL).alias("c")).select("text", "c.*").withColumn("back", pieces.decoded(spark, F.col("ids"), MODEL)).collect()
    for r in got:
        ids = sp.encode(r["text"] or "")
        assert (r["ids"], r["n_tokens"], r["back"]) == (ids, len(ids), sp.decode(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["back"].encode()).hexdigest()
    assert docs.filter("false").select(pieces.coded(spark, F.col("text"), MODEL)).count() == 0


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def feature_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 70_000)])
def test_resample(spark, docs, most, buckets):
    target = spark.createDataFrame([(1, "the t1 of état", "x"), (2, None, "x"), (3, "t3", "x")], "item_id long, text string, doc_id string")

    def buckets_of(t):
        w = feature_words(t)
        return [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, most + 1) for i in range(len(w) - m + 1)]

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    s = Counter(b for _, t in rows for b in buckets_of(t))
    t = Counter(b for r in target.collect() for b in buckets_of(r["text"]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets)))) for b in s}
    want = []
    for i, text in rows:
        f = buckets_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(feature_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is not None, w[0] or 0))
    quota = len(eligible) * 10 // 100
    ranks = defaultdict(list)
    for k, w in enumerate(eligible):
        ranks[w].append(k + 1 if k < quota else None)
    got = resample.resample(docs, target, most, buckets).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    for r in got:
        assert r["rank"] in ranks.get(tuple(r)[:5], [None])
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, quota + 1))


def test_resample_ties_and_empty(spark, docs):
    one = spark.createDataFrame([(i % 5, 30, 30, 0, 7) for i in range(40)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = resample.drawn(one, F.col("n_words") >= 20, 25).filter("rank is not null").orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(k // 8, k + 1) for k in range(10)]
    target = docs.limit(0)
    assert resample.resample(docs.filter("false"), target).count() == 0
    assert resample.resample(docs, target).count() == docs.count()


def brute_collocations(rows, top, least, most, covered):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in some.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if 100 * a >= covered * some[p[i : i + n]]:
                        gone.add(p[i : i + n])
        kept = []
        for p, a in some.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top,wave,most,least", [(2000, None, 4, 30), (8, 3, 4, 5), (25, 2, 5, 3), (3, 1, 2, 4)])
def test_collocations(docs, top, wave, most, least):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, top=top, wave=wave, most=most, least=least)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, top, least, most, 80)


def test_collocations_edges(spark, docs):
    assert collocations.collocations(docs.filter("false")).count() == 0
    # products beyond 64 bits stay exact
    big = spark.range(1).select(collocations.share(F.lit(9_000_000_000_000_001).cast("long"), F.lit(18_000_000_000_000_003).cast("long")).alias("s")).first()["s"]
    assert big == 2_000_000 * 9_000_000_000_000_001 // 18_000_000_000_000_003


def test_phrase_keys_equal_in_columns_and_passes(spark):
    """A pass must find every phrase that a bit field was made from."""
    t = spark.createDataFrame([("en", "A b c. d"), ("und", "b c d e")], "lang string, text string")
    everything = collocations.counted(t, range(1, 5), {})
    for k in (2, 3, 4):
        only = everything.filter(F.col("k") == k)
        field = collocations.bit_field(only.select(collocations.phrase_key("lang", "phrase")))
        keys = only.select(collocations.phrase_key("lang", "phrase").alias("k")).toArrow()["k"].to_numpy()
        assert marks(field, keys.view("u8")).all()
    grown = collocations.counted(t, range(3, 5), collocations._fields({"grow": everything.filter("k in (2, 3)"), "need": everything.filter("false")}))
    assert sorted(map(tuple, grown.collect())) == sorted(tuple(r) for r in everything.filter("k > 2").collect())
    assert pa.types.is_int64(everything.select(collocations.phrase_key("lang", "phrase").alias("k")).toArrow()["k"].type)
