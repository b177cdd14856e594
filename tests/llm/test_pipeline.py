"""The pipeline's stages against what they must keep."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from .helpers import SCHEMA, WORDS

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't installed")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(11)
    text = lambda n=80: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows, marks = [], []
    for i in range(200):
        bad = i % 5 == 0
        rows.append((i, text() + (" scumbag" if bad else ""), "en" if i % 2 else "de", "s", 1))
        marks.append((i, 1, int(bad)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[1][1], "en", "s", 1), (202, None, "en", "s", 1), (203, "123 456", None, "s", 1), (204, "mail a@b.org or 4111 1111 1111 1111 now", "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_stages(spark, tables):
    import corpus_pipeline as P

    folder, texts = tables
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "simhash", "pii", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    clean = P.language(spark, docs, folder)
    assert ids(docs) - ids(clean) == {202, 203} and clean.columns == docs.columns
    kind = P.toxic(spark, clean, folder)
    assert ids(clean) - ids(kind) == {i for i in range(200) if i % 5 == 0} and kind.columns == docs.columns
    once = P.near_duplicates(spark, kind, folder)
    assert ids(kind) - ids(once) == {200, 201} and once.count() == len(ids(once))
    safe = P.personal_data(spark, once, folder)
    changed = safe.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old").collect()
    assert [r.doc_id for r in changed] == [204] and "a@b.org" not in changed[0].text and safe.columns == docs.columns
    pieces = P.packed(spark, safe, folder)
    assert ids(pieces) == ids(safe)
    assert P.run(spark, folder).select("doc_id").distinct().count() == len(ids(safe))


def test_null_and_shared_ids_are_no_duplicates(spark):
    import random

    import corpus_pipeline as P

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(60))
    alone = [(None, text(), "en", "s", 1) for _ in range(20)] + [(5, text(), "en", "s", 1) for _ in range(3)]
    twice = text()
    copies = [(7, twice, "en", "s", 1), (7, twice, "en", "s", 1), (None, twice, "en", "s", 1)]
    last = text()
    nameless = [(None, last, "en", "s", 1), (None, last, "en", "s", 1)]
    docs = spark.createDataFrame(alone + copies + nameless, SCHEMA)
    kept = P.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(r[0], r[1]) for r in alone] + [(7, twice), (None, last)], key=str)


def test_every_language_is_learnt_and_none_is_no_reason(spark):
    import corpus_pipeline as P
    from lodestone.llm import langid

    names = [f"x{i:02d}" for i in range(70)]
    rows = [(i * 100 + k, f"{name}word " * 5, name, "s", 1) for i, name in enumerate(names) for k in range(2 if i == 69 else 3)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert sorted(n for own in model.members.values() for n in own) == names
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "123", None, "s", 1), (3, None, None, "s", 1)], SCHEMA)
    assert [r.doc_id for r in P.language(spark, docs, "").collect()] == [1]


def test_personal_data_of_other_tables(spark):
    """Columns may be missing; null, empty and repeated rows stay."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "write to a@b.org"), (1, "write to a@b.org"), (None, None), (2, "")], "doc_id long, text string")
    rows = P.personal_data(spark, docs, "").collect()
    long = len("write to u" + "0" * 16 + "@pseudonym.invalid")
    assert {(r.doc_id, r.n_chars) for r in rows} == {(None, None), (1, long), (2, 0)} and len(rows) == 4
    assert rows[0].asDict().keys() == {"doc_id", "text", "n_chars"}
