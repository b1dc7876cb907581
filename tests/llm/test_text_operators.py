"""Operators on texts against brute force and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, fmindex, jaccard, langid, lines, mixing, queries, shards, toxicity
from gridloom.llm.words import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, th string"
WORDS = "abcdefghij"


@pytest.fixture(scope="module")
def docs(spark):
    """Random small-alphabet texts with copies, odd rows, and extra columns named like inner ones."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(160):
        if i and rng.random() < 0.4:
            t = texts[int(rng.integers(len(texts)))].split(" ")
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(len(t)))] = "x" + str(int(rng.integers(9)))
            texts.append(" ".join(t))
        else:
            n = int(rng.integers(1, 120))
            texts.append("".join("w" + str(int(k)) + ("\n" if rng.random() < 0.2 else " ") for k in rng.integers(0, 400, n)).strip())
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", None, 0), (902, " \t\n ", "de", "", 3), (903, "one", "en", "src0", 3), (None, "null id here", "en", "src1", 12)]
    rows += [(904, "y" * 30_000 + " " + "long words " * 3000, "en", "src1", 63_000)] + [(905, "same row\nsame line\nagain", "en", "src2", 24)] * 3
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def test_words_and_grams():
    w = words(pa.array(["a b  a", None, "", "a b a c"]))
    assert w.at.tolist() == [0, 3, 3, 3, 7]
    assert w.hash[0] == w.hash[2] == w.hash[3] == w.hash[5] and len(set(w.hash.tolist())) == 3
    g, off = w.grams(2)
    assert off.tolist() == [0, 2, 2, 2, 5] and g[0] == g[2] and g[1] == g[3]


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [128, 1024, 4096])
def test_periodic_words_differ(spark, n):
    """Words that no polynomial modulo 2^64 tells apart."""
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    w = words(pa.array([x, y, x]))
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    assert w.heads(64)[0] != w.heads(64)[1] and w.heads(64)[0] == words(pa.array([x[:70]])).heads(64)[0]
    d = spark.createDataFrame([(1, x), (2, y), (3, x.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(d).collect()} == {1: 1, 2: 2, 3: 1}


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_jaccard_groups(docs):
    d = docs.filter("doc_id is not null")
    sets = shingle_sets(listed(d))
    up = {k: k for k in range(len(sets))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, len(x), least[find(k)]) for k, (i, x) in enumerate(sets))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(d).collect())
    assert got == want and any(n != i for i, _, n in got)


def test_jaccard_hub(spark):
    """Variants that are similar to a centre and hardly to each other form one group."""
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(base)]
    for v in range(40):
        t = list(base)
        for p in (5 + v, 60 + v):
            t[p] = f"v{v}-{p}"
        texts.append(" ".join(t))
    got = jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_jaccard_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n, m, common in ((1, 1, 0), (5, 60, 3), (100, 130, 90), (700, 650, 600), (1000, 1100, 20)):
        h = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64) << np.uint64(1)
        a, b = h[:n], h[n - common :]
        assert jaccard.differing(jaccard.signature(a), jaccard.signature(a)) == 0
        assert jaccard.differing(jaccard.signature(a), jaccard.signature(b)) <= n + m - 2 * common


def test_jaccard_compares_no_sets_that_signatures_tell_apart(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    often = [[f"{c}{k}" for k in range(110)] for c in "ab"]
    for g in range(20):  # even groups overlap in 0.87 of their shingles, odd ones in 0.69: all but what is frequent
        one = [f"w{x}" for x in rng.integers(0, 1 << 40, 600)]
        two = one[:200] + [f"v{x}" for x in rng.integers(0, 1 << 40, 36)] + one[236:]
        if g % 2:
            one, two = (one[:490] + end for end in often)
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    pairs, write = [], jaccard.written

    def counted(df, *a, **k):
        out = write(df, *a, **k)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i % 4 < 2 else i for i in range(40)}
    assert max(pairs) == 10


def test_drop_similar(docs):
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[905] == 1 and ids[900] == ids[901] == ids[902] == 1


def test_drop_similar_tells_groups_under_one_id_apart(spark):
    """Different texts under null and under one repeated doc_id all stay, but for copies of each other."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    near = c.replace("c39", "other")
    rows = [(i, t) for i in (None, 7) for t in ("own words of " + str(i), "a second text of " + str(i), None, "", "")]
    rows += [(None, a), (None, a), (None, b), (7, c), (7, near), (7, near), (7, d), (7, d), (3, d), (None, d), (None, e), (9, e), (9, e)]
    kept = Counter(tuple(r) for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    variant = [t for t in (c, near) if kept[(7, t)]]
    assert len(variant) == 1
    assert kept == Counter([*rows[:10], (None, a), (None, b), (7, variant[0]), (3, d), (9, e)])


def test_repeated_windows(docs):
    rows, n = listed(docs), 35
    where = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = split(t)
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((k, i))
    gone = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + n))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        w = split(t)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone[k])
        want[(i, len(w), len(gone[k]), hashlib.sha256(kept.encode()).hexdigest())] += 1
    for crowd in (2000, 1):  # also with every gram taken for a crowded one
        got = Counter(tuple(r) for r in fmindex.drop_repeats(docs, crowd=crowd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == want
    assert sum(len(g) for g in gone.values()) > 500


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, 12).astype(np.uint64) for _ in range(30)]
    copies = rng.integers(1, 3, 30)
    seen = Counter()
    for p, c in zip(parts, copies, strict=True):
        for i in range(12 - 4):
            seen[tuple(p[i : i + 5].tolist())] += int(c)
    hits = fmindex.FMIndex(parts, copies, 5).repeated()
    for p, h in zip(parts, hits, strict=True):
        assert sorted(h.tolist()) == [i for i in range(8) if seen[tuple(p[i : i + 5].tolist())] > 1]


def test_line_dedup(docs):
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(listed(d))
    seen, cut = {}, defaultdict(set)
    for i, t in rows:
        ls = [(k, x) for k, x in enumerate((t or "").split("\n")) if split(x)]
        for (a, x), (b, y) in zip(ls, ls[1:]):
            if seen.setdefault((x, y), (i, a)) != (i, a):
                cut[i] |= {a, b}
    got = {r["row"]["doc_id"]: r for r in lines.drop_repeated_lines(d).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i])
        assert got[i]["text"] == want and got[i]["n_removed"] == len(cut[i])
    assert len(cut) > 3


@pytest.mark.parametrize("alone", [1, 4, 12])
def test_line_dedup_of_single_lines(spark, docs, alone):
    """Lines of enough words go as runs of one: between unique neighbours and in texts of one line."""
    long = " ".join(f"m{k}" for k in range(12))
    more = [(2000, f"u1\n{long}\nu2"), (2001, f"u3\n\n{long}\nu4"), (2002, long), (2003, long), (2004, "m0 m1"), (2005, "m0 m1"), (2006, f"{long}\nu5\n{long}")]
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = sorted(listed(d))
    seen, cut = {}, defaultdict(set)
    for i, t in rows:
        ls = [(k, x) for k, x in enumerate((t or "").split("\n")) if split(x)]
        for (a, x), (b, y) in zip(ls, ls[1:]):
            if seen.setdefault((x, y), (i, a)) != (i, a):
                cut[i] |= {a, b}
        for a, x in ls:
            if len(split(x)) >= alone and seen.setdefault(x, (i, a)) != (i, a):
                cut[i].add(a)
    got = {r["row"]["doc_id"]: r for r in lines.drop_repeated_lines(d, alone=alone).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i])
        assert got[i]["text"] == want and got[i]["n_removed"] == len(cut[i])
    assert got[2001]["text"] == "u3\n\nu4" and got[2003]["text"] == "" and got[2006]["text"] == "u5"


def test_repeated_rows_share_a_line_result(docs):
    r = lines.drop_repeated_lines(docs.filter("doc_id = 905")).collect()
    assert len(r) == 3 and {x["n_removed"] for x in r} == {0}


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 90), ("e", 0)], "source string, source_size long")
    t = {r["source"]: r for r in mixing.targets(sizes).collect()}
    assert all(r["target"] <= 2 * r["source_size"] for r in t.values())
    assert abs(sum(r["target"] for r in t.values()) - 1.5 * 1500) < 1e-6
    level = {r["target"] / r["weight"] for r in t.values() if r["target"] < 2 * r["source_size"]}
    assert max(level) - min(level) < 1e-9
    assert all(2 * r["source_size"] / r["weight"] <= max(level) + 1e-9 for r in t.values() if r["target"] == 2 * r["source_size"])
    assert [t[s]["weight"] for s in ("a", "b", "c", "e", None)] == [5, 2, 1, 5, 2]


def test_mix(docs):
    m = mixing.mix(docs).collect()
    assert len(m) == docs.count()
    by = defaultdict(list)
    for r in m:
        assert r["size"] == len(split(r["row"]["text"])) and 0 <= r["copies"] <= 2
        by[r["row"]["source"]].append(r)
    for rs in by.values():
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["row"]["doc_id"], r["row"]["text"], r["copies"])
    assert Counter(map(key, m)) == Counter(map(key, again))


def test_external_shuffle(docs):
    out = shards.external_shuffle(docs, shards=4, bucket_bytes=4000, hot=2).collect()
    assert Counter((r["record"]["doc_id"], r["record"]["text"]) for r in out) == Counter(listed(docs))
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first = [r["record"]["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"])) if r["record"]["doc_id"] is not None]
    assert sum(a < b for a, b in zip(first, first[1:])) < 0.7 * len(first)


def test_clashing_names(spark):
    """Columns named like inner ones, or in need of quotes, change nothing."""
    d = spark.createDataFrame([(i, f"the text number {i // 2} of a few", "x") for i in range(8)], "doc_id long, text string, source string")
    for name in ("my-col", "that_id", "that_hash", "th", "cls", "record", "shard", "bucket", "size", "cut", "a b"):
        d = d.withColumn(name, F.lit(name))
    kept = jaccard.drop_similar(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]
    out = shards.external_shuffle(d, shards=2)
    assert sorted(r["record"]["my-col"] + str(r["record"]["doc_id"]) for r in out.collect()) == [f"my-col{i}" for i in range(8)]
    assert {r["row"]["cut"] for r in mixing.mix(d).collect()} == {"cut"}
    assert {r["row"]["th"] for r in lines.drop_repeated_lines(d).collect()} == {"th"}


def test_mix_cuts_through_equal_rows(spark):
    """A third of all rows equal, some under null: what the cut goes through is taken in part."""
    rows = [(7, "the same five words here", "a")] * 30 + [(None, "null id", None)] * 9 + [(i, f"w {i} and more", "a") for i in range(40)] + [(None, None, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    m = mixing.mix(d, share=0.9).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in m) == Counter((i, t) for i, t, _ in rows)
    for s in ("a", None):
        rs = [r for r in m if r["row"]["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) <= 5


def test_scratch_tables_go(spark, docs):
    import os

    from gridloom.functions.rounds import shared_dir

    def tables():
        return set(os.listdir(shared_dir(spark)))

    before = tables()
    g = jaccard.similar_groups(docs)
    assert len(tables() - before) == 1 and g.count() == docs.count()


def test_shards_grow_into_the_new_one(docs):
    r = docs.select(shards.rendezvous(F.col("doc_id"), 40).alias("a"), shards.rendezvous(F.col("doc_id"), 41).alias("b")).collect()
    assert all(x["a"] == x["b"] or x["b"] == 40 for x in r)


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, docs, encoding):
    path, pattern, e = encoding
    odd = ["  \n\n x　y's  'LL 're", "a" * 900 + "ab" * 500, "<|endoftext|> \x1c\x85 é日本語 \U0001f600\U0001fae8 ࡰ zz", None, "", "nul\0byte"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in d.select("text", bpe.coded(spark, F.col("text"), path, pattern).alias("c")).collect():
        t = r["text"] or ""
        ids = e.encode_ordinary(t)
        assert list(r["c"]["ids"]) == ids and r["c"]["n_tokens"] == len(ids)
        assert r["c"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["c"]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_segments_are_maximal():
    """The scan finds the segments that repeated splitting at the best one finds."""
    rng = np.random.default_rng(2)

    def best(s, a):
        top = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        if top[0] <= 0:
            return []
        i, j = top[2], top[3]
        return best(s[:i], a) + [(a + i, a + j - 1)] + best(s[j:], a + j)

    for _ in range(60):
        s = rng.integers(-3, 4, 12).astype(float) + rng.random(12) * 1e-3
        at = np.flatnonzero(s > 0)
        paid = np.concatenate([[0], np.cumsum(np.minimum(s, 0))])
        got = toxicity.segments(at, s[at], paid[at])
        assert [(a, b) for a, b, _ in got] == best(list(s), 0)


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    bad, rows, labels = ["vile", "scorn", "blight"], [], []
    for i in range(900):
        w = [f"w{k}" for k in rng.integers(0, 300, int(rng.integers(5, 80)))]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[k] = bad[int(rng.integers(3))]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels + [(1002, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.learn(d, y, where=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    r = {x["doc_id"]: x for x in toxicity.score_documents(d, m, F.lit(False)).collect()}
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(r[i]["predicted"] == (i % 6 == 0) for i in out) >= 0.97 * len(out)
    assert r[1000]["score"] == r[1001]["score"] < 0.5
    hit = next(x for i, x in r.items() if x["predicted"])
    text = dict(rows)[hit["doc_id"]].split()
    p = hit["passages"][0]
    assert any(b in text[p["first"] : p["last"] + 1] for b in bad)
    kept = toxicity.drop_toxic(d.withColumn("s", F.lit(1)), m)
    assert kept.columns == ["doc_id", "text", "s"] and kept.count() == sum(1 - x["predicted"] for x in r.values())


def test_toxicity_without_labels(docs, spark):
    m = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.score_documents(docs, m, F.lit(True)).collect()} == {0.0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    e, move, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    at = np.array([0, 4, 4, 7])
    want = np.zeros_like(e)
    for a, b in ((0, 4), (4, 7)):
        import itertools

        for path in itertools.product(range(3), repeat=b - a):
            s = first[path[0]] + sum(e[a + k, y] for k, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:]))
            for k, y in enumerate(path):
                want[a + k, y] += np.exp(s)
        want[a:b] /= want[a:b].sum(axis=1, keepdims=True)
    assert np.allclose(langid.marginals(e, at, move, first), want)


def test_language_crf(spark):
    rng = np.random.default_rng(6)
    stems = {"aa": ["kol", "mar", "ten"], "bb": ["xyz", "qui", "zzo"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(str(rng.choice(stems[lang])) + str(rng.choice(stems[lang])) for _ in range(12)), lang))
    rows += [(1000, None, "aa"), (1001, "12 -- 34", "aa"), (1002, "", None), (1003, "kolmar tenkol kolten xyzqui zzoxyz quizzo quiqui xyzxyz", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(d, F.col("doc_id") % 3 != 1)
    r = {x["doc_id"]: x["p"] for x in d.select("doc_id", langid.predicted("text", f).alias("p")).collect()}
    assert all(r[i]["lang"] == rows[i][2] and 0.5 < r[i]["score"] <= 1 for i in range(300))
    assert all(r[i]["lang"] == "und" and r[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert r[1003]["lang"] == "bb" and 0.2 < r[1003]["switched"] < 0.5
    nothing = langid.learn(d.filter("false"), F.lit(True))
    assert d.select(langid.predicted("text", nothing)["lang"]).distinct().collect()[0][0] == "und"


def test_empty_tables(spark, empty, encoding):
    assert jaccard.similar_groups(empty).count() == 0
    assert jaccard.drop_similar(empty).count() == 0
    assert fmindex.drop_repeats(empty).count() == 0
    assert lines.drop_repeated_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert shards.external_shuffle(empty).count() == 0
    assert empty.select(bpe.coded(spark, F.col("text"), *encoding[:2])).count() == 0
