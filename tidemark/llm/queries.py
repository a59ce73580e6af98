"""The queries of the operators: thin forms that bring results into the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballhash, bpe, chat, decontamination, dualtree, linededup, orderhash, setjoin, substrings, toxicity, urlfilter, vectorcodes, warc
from .common import sha256_hex, table, text_batches


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the texts that they decode to."""
    text_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.coded(docs, path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(bpe.ids_text(F.col("ids"))).alias("ids_sha256"), sha256_hex(F.col("raw")).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is windows of the benchmark."""
    found = decontamination.annotated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), out="c")
    ids = F.concat_ws(",", "c.items")
    return found.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"), sha256_hex(ids).alias("items_sha256"), "c.contaminated")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, s, win.n, item FROM (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM places) p JOIN win ON p.n = win.n AND p.k = win.k),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def queries() -> dict:
    made = (chat.op1_chat_format, orderhash.op2_order_minhash, urlfilter.op3_url_filter, op4_bpe, substrings.op5_substring_dedup, setjoin.op6_jaccard_join, warc.op7_warc, linededup.op8_line_dedup, op9_toxicity, op10_decontamination, dualtree.op11_centroids, ballhash.op12_simhash, vectorcodes.op13_vector_codes)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op3_url_filter": urlfilter.OP3_SQL,
        "op5_substring_dedup": substrings.OP5_SQL,
        "op6_jaccard_join": setjoin.OP6_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_line_dedup": linededup.OP8_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_centroids": dualtree.OP11_SQL,
        "op13_vector_codes": vectorcodes.OP13_SQL,
    }
