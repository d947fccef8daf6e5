"""Corpus pipeline: stages that take documents and hand on the documents that they keep.

Toxic documents go; multi-line chunks that occur earlier go; of each group of near
duplicates the one of the smallest id stays; documents with a passage of a benchmark
item go; what is left is encoded, and decoded again. Every stage works on all that
its predecessor kept. Each row is judged by itself: ids may be null or repeat, and other
columns, whatever their names, are handed on up to the last stage. The order in which a group's documents are taken and the
network of the first stage can't be put in SQL, so there is none; the tests hold the
stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, decontam, line_dedup, minhash, toxicity
from quillmark.llm.queries import BYTE_BPE, held_out, tokenizer
from quillmark.llm.runtime import checkpoint, plainly_named, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels of the held-out fifth are not learned."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks that occur earlier; n_chars follows the text."""
    kept = line_dedup.drop_repeats(plainly_named(docs, ("doc_id", "text", "n_chars"))).drop("n_lines", "n_removed")
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, also where ids are null or repeated."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids and the text that they decode to."""
    return bpe.round_trip(docs, tokenizer(BYTE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding_decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
