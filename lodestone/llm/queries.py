"""The operators' queries over whole tables, and what SQL can say of them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lblm, matroska, packing, pii, secrets, simhash, topk, toxicity
from .common import read_table


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The key where the session's configuration has none: for the synthetic tables only, as it is no secret.
KEY, KEY_OF_TESTS = "spark.lodestone.pii.key", "synthetic tables only"


def pii_key(spark: SparkSession) -> str:
    """The secret key of pseudonyms, by the session's configuration."""
    key = spark.conf.get(KEY, None)
    if not key:
        warnings.warn(f"{KEY} is not set: pseudonyms are made with a key that is no secret", stacklevel=2)
    return key or KEY_OF_TESTS


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"), words=4, max_distance=4)
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(read_table(spark, sf_dir, "documents"), pii_key(spark))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), split_pattern())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_documents(read_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored_features(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), window=2048, end=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_pii, op3_bpe, op4_secrets, op5_lm, op6_language, op7_topk, op8_media, op9_packing, op10_toxicity)
    return {f.__name__: f for f in found}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id AND len(q.e) = len(r.e)
), t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """Only the exact search is one SQL statement over the tables; the others are held
    against plain versions in tests/llm."""
    return {"op7_topk": TOP_K_SQL}
