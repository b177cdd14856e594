"""A corpus pipeline over ``documents``: language, toxicity, near duplicates, personal data,
packing. Each stage takes what its predecessor kept, as written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, packing, pii, similar, toxicity
from lodestone.llm.common import cut, ensure_checkpoint_dir, read_table, remove
from lodestone.llm.queries import pii_key, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language: null, or without a letter. That is all it rejects, also
    where the table names no language to learn."""
    docs = _with_text(docs)
    model = langid.fit(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model, keep=tuple(docs.columns))
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, trained on the table of labels, predicts to be toxic."""
    docs = _with_text(docs)
    judged = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")), keep=tuple(docs.columns))
    return judged.where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows
    that share this id or have none, the one with the least key of its text. Rows of other
    groups stay, whatever their ids."""
    docs = _with_text(docs)
    first = cut(similar.first_of_groups(docs, words=5, similarity=0.8, max_distance=4)).withColumnRenamed("doc_id", "first_id")
    keyed = docs.withColumn("_key", similar.text_key())
    same = keyed.doc_id.eqNullSafe(F.col("first_id")) & (F.col("_key") == F.col("key"))
    kept = keyed.join(first, same, "left_semi")
    again = first.where("rows > 1")
    if not again.isEmpty():  # rows with the same id and text
        kept = keyed.join(first.where("rows = 1"), same, "left_semi").union(keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"]))
    return kept.drop("_key")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the text."""
    docs = _with_text(docs)
    done = pii.pseudonymised(docs, pii_key(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns, *[c for c in ("n_chars",) if c not in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), window=2048, end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: Learnt models and tokenizers are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder. What a
    stage has read is removed once its own result is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
