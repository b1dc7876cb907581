"""The corpus pipeline: documents in, tokens of the kept and mixed documents out.

toxicity (toxic documents go), line dedup (later repeats of runs of lines and of longer lines are cut), n-gram Jaccard join
(one document of each group of near copies stays), mixing (documents are taken as often as the sources'
targets ask for), byte-level BPE.  All stages but the last keep the columns of documents.

Nulls: a null text is never toxic, has no lines, no near copy and no tokens; it is taken by whole
repetitions of its source.  Rows that are equal in doc_id and text count as one document for line
dedup and as copies for the near-copy stage.  An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.shipping import ship
from gridloom.llm import bpe, jaccard, lines, mixing, queries, toxicity
from gridloom.llm.tables import documents, is_written, written


def _as_documents(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` from the struct `row`, with another text."""
    return df.select(*[(F.col(text) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    ship(spark)
    kept = toxicity.drop_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return written(kept, batch=1000)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of lines of five words, are cut; a document that loses its last line with a word goes."""
    cut = lines.drop_repeated_lines(docs, alone=queries.LINE_WORDS)
    return _as_documents(cut.filter("n_removed = 0 or n_removed < n_lines"), docs, "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs).withColumn("copy", F.explode(F.expr("filter(sequence(0, copies), i -> i < copies)")))
    return taken.select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    ship(spark)
    return jaccard.drop_similar(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of the ids and of the decoded bytes."""
    ship(spark)
    coded = docs.select("doc_id", "source", bpe.coded(spark, F.col("text"), *queries.vocabulary(), keep=False).alias("c"))
    return written(coded.select("doc_id", "source", "c.n_tokens", "c.ids", "c.ids_sha256", "c.decoded_sha256"), batch=1500)


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("mixing sources", mix), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if is_written(docs) else written(docs)
    return docs
