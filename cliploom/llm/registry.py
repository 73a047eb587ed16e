"""The registered queries of this package: each runs one operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import alignment, embeddings, exact_dedup, merkle, merkle_sql, mixing, packing, pieces, quality, sharding, simhash, token_counts, token_files, toxicity
from cliploom.llm.common import table

#: Files of public tokenizers, given by the installed package; never copied here.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""

#: All pairs: only for tables as small as the smallest test tables.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(d.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
FROM r LEFT JOIN d ON d.vec_id = r.vec_id GROUP BY r.vec_id
"""


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, width=4)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_hash")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_ids(table(spark, sf_dir, "documents"), WORD_BPE, end=1)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the CRC-32 of the doc_id, what is received has A-Z lower-cased."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    received = F.when(changed, lowered).otherwise(F.col("text"))
    return merkle.verified(merkle.proofs(table(spark, sf_dir, "documents"), received={"text": received}))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_sharding": op2_sharding,
        "op5_token_counts": op5_token_counts,
        "op6_token_ids": op6_token_ids,
        "op3_simhash_neardup": op3_simhash_neardup,
        "op7_exact_dedup": op7_exact_dedup,
        "op10_source_mixing": op10_source_mixing,
        "op9_embedding_neardup": op9_embedding_neardup,
        "op4_toxicity": op4_toxicity,
        "op8_quality_classifier": op8_quality_classifier,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_embedding_neardup": OP9_SQL, "op11_merkle_manifest": merkle_sql.oracle()}
