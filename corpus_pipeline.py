"""A corpus pipeline: five stages over documents, each written and read again.

Toxic documents go; lines that an earlier line nearly equals go, and documents
with nothing left; of each group of near-equal documents one stays; documents
contaminated by the benchmark go; the rest is encoded to token ids and decoded.
A stage works on what the one before it kept, and all but the last return the
columns of documents.

Defined cases: a document with a null, empty or blank text passes every stage, as
nothing in it is toxic, repeated or contaminated, and gets no ids; rows that repeat a
document in full, and rows of one text under other ids, end as one row; of several
texts under one doc_id each is judged by itself; with no documents no row is left;
columns beside those of documents are kept until the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, linededup, setjoin, toxicity
from tidemark.llm.common import sha256_hex, table, text_batches
from tidemark.plans.scratch import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, and digests of the ids and of the text they decode to."""
    text_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.coded(rows, path, pattern)
    ids = F.col("ids")
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids, sha256_hex(bpe.ids_text(ids)).alias("ids_sha256"), sha256_hex(F.col("raw")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: A trained model and a tokenizer have no SQL; tests/llm compares each stage and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
