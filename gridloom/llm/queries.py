"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm import bpe, collocations, covertree, fmindex, forest, jaccard, langid, lines, mixing, pieces, resample, shards, toxicity
from gridloom.llm.tables import crc_mod, documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: a single line of so many words that repeats is cut too
LINE_WORDS = 5

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def held_out(n: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder; a null id does not."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == remainder, F.lit(False))


@query("op1_language_crf")
def op1(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    field = langid.learn(docs, crc_mod(F.col("doc_id"), 3) != 1)
    r = docs.select("doc_id", held_out(3, 1).alias("held_out"), langid.predicted("text", field).alias("p"))
    return r.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.n_words", "p.switched")


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, d)).select("doc_id", "n_shingles", "component_id")


@query("op3_projection_forest")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return forest.near_links(spark.read.parquet(f"{d}/embeddings.parquet"))


@query(
    "op4_fm_index",
    r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS MATERIALIZED (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
    s AS (SELECT doc_id, p AS i, md5(string_agg(x, ' ') OVER v) AS words, count(*) OVER v AS m FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM s WHERE m = 35),
    h AS (SELECT doc_id, i AS p, true AS hit FROM r WHERE n > 1),
    k AS (SELECT doc_id, p, x, count(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM p LEFT JOIN h USING (doc_id, p)),
    g AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY 1)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)""",
)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return fmindex.drop_repeats(documents(spark, d)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_external_shuffle")
def op5(spark: SparkSession, d: str) -> DataFrame:
    out = shards.external_shuffle(documents(spark, d))
    r = out.select(F.col("record.doc_id").alias("doc_id"), shards.record_bytes("record.text").alias("size"), crc(F.col("record.text")).alias("text_crc32"), "shard", "slot")
    return r.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shards.rendezvous(F.col("doc_id"), 41).alias("grown_shard"))


@query(
    "op6_capped_water_filling",
    f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len({SQL_WORDS}) AS size, md5(concat_ws(':', '6', doc_id, md5(text))) AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
    r AS (SELECT *, source_size * 2 AS cap, source_size * 2 / weight AS ratio FROM s),
    l AS (SELECT *, row_number() OVER f AS turn, sum(source_size) OVER ()::DOUBLE * 1.5 - (sum(cap) OVER f - cap)::DOUBLE AS left_size,
          sum(weight) OVER () - (sum(weight) OVER f - weight) AS left_weight FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT *, left_size / left_weight::DOUBLE AS level FROM l),
    t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT arg_min(level, turn) FROM v WHERE ratio > level), cap::DOUBLE)) AS target FROM v),
    w AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
    c AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
    SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > 0 AND start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source""",
)
def op6(spark: SparkSession, d: str) -> DataFrame:
    m = mixing.mix(documents(spark, d))
    return m.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_toxicity")
def op7(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    m = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"), where=crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score_documents(docs, m, held_out(5, 0))


@query(
    "op8_dual_cover_trees",
    """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS v FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 20""",
)
def op8(spark: SparkSession, d: str) -> DataFrame:
    return covertree.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer the query is asked for."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op9_byte_bpe")
def op9(spark: SparkSession, d: str) -> DataFrame:
    r = documents(spark, d).select("doc_id", bpe.coded(spark, F.col("text"), *vocabulary(), ids=False).alias("c"))
    return r.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


@query(
    "op10_line_dedup",
    r"""WITH p AS MATERIALIZED (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM p WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
    r AS (SELECT a.doc_id, a.n, row_number() OVER (PARTITION BY a.t, b.t ORDER BY a.doc_id, a.n) AS k FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n = a.n + 1),
    s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, n) AS k FROM l WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 5),
    cut AS MATERIALIZED (SELECT doc_id, i FROM l JOIN (SELECT DISTINCT doc_id, n + o AS n FROM r, (VALUES (0), (1)) v(o) WHERE k > 1) USING (doc_id, n)
        UNION SELECT doc_id, i FROM s WHERE k > 1),
    kept AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS kept FROM p ANTI JOIN cut USING (doc_id, i) GROUP BY 1)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) g USING (doc_id)""",
)
def op10(spark: SparkSession, d: str) -> DataFrame:
    r = lines.drop_repeated_lines(documents(spark, d), alone=LINE_WORDS)
    return r.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op12_importance_resampling",
    r"""WITH table_of AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
    x AS (SELECT doc_id, NULL AS item, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
    w AS MATERIALIZED (SELECT doc_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM x),
    b AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(word)), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT)),
                       lambda a, y: xor(a >> 8, t[xor(a & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), table_of),
    f AS MATERIALIZED (SELECT doc_id, item, bucket FROM w JOIN b USING (word)),
    n AS (SELECT bucket, count(*) FILTER (item IS NULL)::DOUBLE AS s, count(item)::DOUBLE AS t FROM f GROUP BY 1),
    total AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
    g AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (total.s + 10000) / ((n.s + 1) * (total.t + 10000))))::BIGINT AS gain FROM n, total),
    d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE item IS NULL GROUP BY 1),
    r AS (SELECT d0.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d0.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents d0 LEFT JOIN d USING (doc_id)),
    k AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS rank, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS quota FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= quota THEN rank END AS rank FROM k""",
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    r = resample.resample(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    return r.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_sentencepiece")
def op11(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    r = documents(spark, d).select("doc_id", pieces.coded(spark, F.col("text"), public_tokenizers.path("piece_bpe_32k.model"), ids=False).alias("c"))
    return r.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


@query(
    "op13_collocations",
    r"""WITH p AS MATERIALIZED (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(range(len(p))) AS i, unnest(p) AS t
          FROM (SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
    x AS (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, range(1, 4) r(j) WHERE j < k),
    s AS (SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score, x.j FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.x JOIN f r ON r.lang = x.lang AND r.phrase = x.y),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s),
    d AS (SELECT DISTINCT b.lang, array_to_string(b.w[i:i + n - 1], ' ') AS phrase, b.a AS longer FROM c b, range(1, 4) r(i), range(2, 4) q(n) WHERE i + n - 1 <= k AND n < k),
    o AS (SELECT lang, phrase, max(longer) AS longer FROM d GROUP BY ALL),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
    v AS (SELECT m.lang, m.phrase, m.a, l, r, score, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, m.phrase) AS rank FROM m LEFT JOIN o USING (lang, phrase) WHERE m.o = 1 AND (longer IS NULL OR 100 * longer < 80 * m.a))
    SELECT lang, rank, phrase, a, l, r, n, score FROM v JOIN n USING (lang) WHERE rank <= 2000""",
)
def op13(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(documents(spark, d))
