"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, mixing, queries, toxicity
from gridloom.llm.tables import written
from gridloom.llm.words import MARKS, words
from test_text_operators import shingle_sets, split

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", None, 0), (10_002, "twice the same", "en", "s", 14), (10_002, "twice the same", "en", "s", 14)], docs.schema)
    out = [written(docs.unionByName(more))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_shape(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    assert all(s.columns == steps[0].columns for s in steps[:5]) and steps[5].columns[0] == "doc_id"


def test_toxic_documents_go(spark, steps):
    m = toxicity.learn(steps[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    r = toxicity.score_documents(steps[0], m, F.lit(False)).filter("predicted = 0").select("doc_id")
    assert Counter(rows(steps[1].select("doc_id"))) == Counter(rows(r))


def test_lines(steps):
    seen, want = {}, Counter()
    cut = defaultdict(set)
    for i, t in sorted(set(rows(steps[1].select("doc_id", "text"))), key=lambda x: x[0]):
        ls = [(k, x) for k, x in enumerate((t or "").split("\n")) if split(x)]
        for (a, x), (b, y) in zip(ls, ls[1:]):
            if seen.setdefault((x, y), (i, a)) != (i, a):
                cut[i] |= {a, b}
        for a, x in ls:
            if len(split(x)) >= queries.LINE_WORDS and seen.setdefault(x, (i, a)) != (i, a):
                cut[i].add(a)
    for r in rows(steps[1]):
        ls = None if r[1] is None else r[1].split("\n")
        left = None if ls is None else [x for k, x in enumerate(ls) if k not in cut[r[0]]]
        if not cut[r[0]] or any(split(x) for x in left):
            want[(r[0], None if left is None else "\n".join(left), *r[2:])] += 1
    assert Counter(rows(steps[2])) == want


def test_near_copies(steps):
    sets = shingle_sets(rows(steps[2].select("doc_id", "text")))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, x) in enumerate(sets):
        groups[find(k) if x else (k,)].append(i)
    assert Counter(i for (i,) in rows(steps[3].select("doc_id"))) == Counter(min(g) for g in groups.values())


def test_mix_and_encode(spark, steps):
    want = Counter()
    for r in mixing.mix(steps[3]).collect():
        if r["copies"]:
            want[tuple(r["row"])] += r["copies"]
    assert Counter(rows(steps[4])) == want
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    with open(path, "rb") as f:
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    coded = Counter()
    for r in rows(steps[4]):
        ids = ",".join(map(str, e.encode_ordinary(r[1] or "")))
        coded[(r[0], hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(rows(steps[5].select("doc_id", "ids_sha256", "decoded_sha256"))) == coded


def test_run(spark):
    r = corpus_pipeline.run(spark, DIR)
    assert r.count() > 0 and r.filter("size(ids) <> n_tokens").count() == 0


def test_empty_table_and_extra_columns(spark):
    """Columns with the operators' own names pass through all stages; an empty table gives empty results."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    for name in ("row", "that_id", "my-col", "copies", "at", "cut", "that_source", "root", "score"):
        docs = docs.withColumn(name, F.lit(name))
    for table in (docs, docs.filter("false")):
        d = written(table)
        for _, stage in corpus_pipeline.STAGES[:4]:
            d = written(stage(spark, d, DIR))
            assert d.columns == docs.columns
            assert d.filter("`my-col` <> 'my-col' or that_id <> 'that_id'").count() == 0
        coded = corpus_pipeline.STAGES[4][1](spark, d, DIR)
        assert (coded.count() > 0) == (table.count() > 0)


def best_parts(x):
    """Scores of the maximal segments by their definition: the best one, then those left and right of it."""
    out, todo = [], [(0, len(x))]
    while todo:
        first, end = todo.pop()
        best, at, run, start = 0.0, None, 0.0, first
        for i in range(first, end):
            if run <= 0:
                run, start = 0.0, i
            run += x[i]
            if run > best + 1e-9:
                best, at = run, (start, i)
        if at:
            out.append(best)
            todo += [(first, at[0]), (at[1] + 1, end)]
    return out


def test_toxicity_by_a_plain_scan(spark):
    """On the 0.01 scale: no text of the smaller one is toxic."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    gain = dict(zip(m.token.tolist(), m.gain.tolist(), strict=True))
    mark, known = re.compile("[" + re.escape("".join(chr(b) for b in range(128) if MARKS[b])) + "]+"), {}

    def worth(word):
        if word not in known:
            w = words(pa.array([word]), MARKS, lower=True)
            heads = [gain[h] for h in (int(w.heads(n)[0]) for n in toxicity.HEADS) if h in gain]
            known[word] = gain.get(int(w.hash[0]), max([m.cost, *heads]))
        return known[word]

    def toxic(text):
        x = [worth(w) for w in mark.split(text or "") if w]
        bits = []
        for s in best_parts(x):
            z = (m.rate * s - math.log(len(x)) - m.place) / m.scale
            p = -math.expm1(-math.exp(-min(max(z, -30.0), 500.0)))
            bits.append(min(-math.log10(p) if p > 0 else z / math.log(10), 60.0))
        c = m.curve
        return c is not None and c[0] + c[1] * math.log1p(max(bits, default=0.0)) + c[2] * math.log1p(sum(b for b in bits if b >= 1)) >= 0

    every = rows(docs)
    want = Counter(r for r in every if not toxic(r[1]))
    assert Counter(rows(corpus_pipeline.toxic(spark, docs, d))) == want and 0 < sum(want.values()) < len(every)


def place(doc_id, text):
    """Where a document stands in the seeded order of its source."""
    parts = ["6", *([] if doc_id is None else [str(doc_id)]), *([] if text is None else [hashlib.md5(text.encode()).hexdigest()])]
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def test_mix_by_a_plain_loop(steps):
    sources = defaultdict(list)
    for r in rows(steps[3]):
        sources[r[3]].append((place(r[0], r[1]), r[0], len(split(r[1])), r))
    size = {s: sum(x[2] for x in d) for s, d in sources.items()}
    name = {s: (s is None, s or "") for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources, key=name.get))}
    left, parts, target = 1.5 * sum(size.values()), sum(weight.values()), {}
    turns = sorted(sources, key=lambda s: (2 * size[s] / weight[s], name[s]))
    while turns and 2 * size[turns[0]] / weight[turns[0]] <= left / parts:
        s = turns.pop(0)
        target[s] = 2.0 * size[s]
        left, parts = left - target[s], parts - weight[s]
    target |= {s: weight[s] * (left / parts) for s in turns}
    want = Counter()
    for s, d in sources.items():
        whole = int(target[s] // size[s]) if size[s] else 0
        start = 0
        for _, _, n, r in sorted(d, key=lambda x: x[0]):
            want[r] += whole + (n > 0 and start + n / 2 <= target[s] - whole * size[s])
            start += n
    assert Counter(rows(steps[4])) == +want and len(sources) > 2
