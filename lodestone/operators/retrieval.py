"""Value linking: fuzzy tokens with BM25, edit distance, vectors; fusion and re-ranking.

Everything works on a table of mentions at once. Values have (label, prop, value),
mentions (qid, phrase, label, prop); results (qid, value, score, rank), ties by value.
"""

from __future__ import annotations

import functools
import math
import warnings
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.2, 0.75
FIELD = ["label", "prop"]


def property_values(frame: DataFrame, label: str, props: dict[str, Column]) -> DataFrame:
    """Distinct trimmed non-empty values of properties; arrays by item."""
    parts = []
    for name, c in props.items():
        kind = frame.select(c.alias("c")).schema["c"].dataType.typeName()
        value = F.explode(c) if kind == "array" else c
        rows = frame.select(F.lit(label).alias("label"), F.lit(name).alias("prop"), value.alias("value"))
        parts.append(rows.withColumn("value", F.col("value").cast("string")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select("label", "prop", F.trim("value").alias("value")).where("value is not null and value <> ''").distinct()


def contexts_of(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where wanted texts occur as values, whatever the case."""
    keys = wanted.select(F.lower(F.trim("value")).alias("key")).distinct()
    return values.withColumn("key", F.lower("value")).join(keys, "key", "left_semi").drop("key")


def missing_embeddings(values: DataFrame, embedded: DataFrame) -> DataFrame:
    return values.join(embedded, [*FIELD, "value"], "left_anti")


def signatures(token: Column) -> Column:
    """A token and its one-character deletions: two tokens within one edit share one."""
    n = F.length(token)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))
    return F.array_distinct(F.concat(F.array(token), cuts))


def close_tokens(queries: DataFrame, known: DataFrame, fuzziness: int = 1) -> DataFrame:
    """(label, prop, q, token): tokens within ``fuzziness`` (0 or 1) edits, by an equi-join
    on shared deletions instead of a comparison of all pairs."""
    if fuzziness not in (0, 1):
        raise ValueError("fuzziness is 0 or 1")
    if fuzziness == 0:
        return known.join(queries.withColumnRenamed("q", "token"), [*FIELD, "token"]).select(*FIELD, F.col("token").alias("q"), "token")
    a = queries.select(*FIELD, "q", F.explode(signatures(F.col("q"))).alias("sig"))
    b = known.select(*FIELD, "token", F.explode(signatures(F.col("token"))).alias("sig"))
    return a.join(b, [*FIELD, "sig"]).where(X.within_edits(F.col("q"), F.col("token"), 1)).select(*FIELD, "q", "token").distinct()


def ranked(rows: DataFrame, k: int | None = None, score: str = "score", *ties: Column) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), *(ties or (F.col("value"),)))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def fuzzy_topk(values: DataFrame, mentions: DataFrame, k: int = 10, fuzziness: int = 1, floor: float = 0.1) -> DataFrame:
    """Any token of the phrase within the edits; score BM25 over the tokens of the field's
    values. Blank phrases find nothing."""
    tokens = values.select(*FIELD, "value", F.regexp_extract_all(F.lower("value"), F.lit(r"(?U)\w+"), F.lit(0)).alias("tokens"))
    tokens = tokens.withColumn("dl", F.size("tokens"))
    size = tokens.groupBy(*FIELD).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    postings = tokens.select(*FIELD, "value", "dl", F.explode("tokens").alias("token")).groupBy(*FIELD, "value", "dl", "token").agg(F.count("*").alias("tf"))
    known = postings.groupBy(*FIELD, "token").agg(F.count("*").alias("df"))
    asked = mentions.select("qid", *FIELD, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("phrase"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("q"))
    met = close_tokens(asked.select(*FIELD, "q").distinct(), known, fuzziness)
    hits = asked.join(met, [*FIELD, "q"]).select("qid", *FIELD, "token").distinct()
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(postings, [*FIELD, "token"]).join(known, [*FIELD, "token"]).join(size, FIELD).groupBy("qid", "value").agg(F.sum(part).alias("score"))
    best = scored.groupBy("qid", "value").agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    return ranked(best.withColumn("score", F.round("score", 9)), k)


def rerank(candidates: DataFrame, mentions: DataFrame, k: int | None = None) -> DataFrame:
    """Exact x2, else containment either way x1.5; x(1 + 0.4 coverage), x1/(1 + 0.05
    extras); stable on ties."""
    rows = candidates.withColumnRenamed("rank", "old").join(mentions.select("qid", "phrase"), "qid")
    p, v = X.collapsed(F.col("phrase")), X.collapsed(F.col("value"))
    pt, vt = X.word_set(F.col("phrase")), X.word_set(F.col("value"))
    n = F.size(pt)
    shared = F.size(F.array_intersect(pt, vt))
    factor = F.when(p == v, 2.0).when(F.contains(v, p) | F.contains(p, v), 1.5).otherwise(1.0)
    coverage = F.when(n > 0, 1 + 0.4 * shared / F.greatest(n, F.lit(1))).otherwise(1.0)
    extras = 1 / (1 + 0.05 * F.size(F.array_except(vt, pt)))
    out = rows.withColumn("score", F.round(F.col("score") * factor * coverage * extras, 9))
    return ranked(out, k, "score", F.col("old")).select("qid", "value", "score", "rank")


def search(values: DataFrame, mentions: DataFrame, k: int = 10, fuzziness: int = 1) -> DataFrame:
    """Over-fetch, re-rank, cut."""
    blank = mentions.where(F.trim("phrase") != "")
    return rerank(fuzzy_topk(values, blank, max(2 * k, 20), fuzziness), blank, k)


def in_blocks(queries: DataFrame, rows: DataFrame, keys: list[str], rows_per_block: int) -> DataFrame:
    """Queries joined with all rows of their keys: rows are dealt into blocks by their places,
    queries go to every block, so no key is one task's."""
    blocks = max(1, math.ceil(rows.count() / rows_per_block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return asked.join(dealt, [*keys, "block"])


def lev_topk(values: DataFrame, mentions: DataFrame, k: int = 10, least: float = 0.0, rows_per_block: int = 16_384) -> DataFrame:
    """Edit-distance similarity to every value of the mention's field, in blocks of values; the
    mentions are the stated side. Each task keeps k for a mention before they meet."""
    rows = in_blocks(mentions, values, FIELD, rows_per_block).withColumn("score", F.round(X.lev_similarity(F.col("phrase"), F.col("value")), 9))
    return ranked(rows.where(F.col("score") >= least).select("qid", "value", "score"), k)


def _block_best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of a block the k best values of each query, by a matrix product; norms once a vector."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"qid": [], "value": [], "score": []})

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_list()).astype(np.float64)
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norms > 0, norms, 1.0)

    rows = rows.sort_values("value", kind="stable")
    values, starts = np.unique(rows["value"].to_numpy(), return_index=True)
    e, out = unit(rows["e"]).T, []
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        best = np.maximum.reduceat(np.round(unit(some["q"]) @ e, 6), starts, axis=1)
        top = np.argsort(-best, 1, kind="stable")[:, :k]  # ties in the order of values
        out.append(pd.DataFrame({"qid": np.repeat(some["qid"].to_numpy(), top.shape[1]), "value": values[top].ravel(), "score": np.take_along_axis(best, top, 1).ravel()}))
    return pd.concat(out)


def vector_topk(index: DataFrame, queries: DataFrame, k: int = 10, rows_per_block: int = 4096) -> DataFrame:
    """Exact cosine top-k. index: (value, embedding), queries: (qid, embedding). Rows are
    dealt into blocks by their places; queries go to every block, and each block keeps k for
    a query before they meet. Of rows with one value the best counts; null vectors take no
    part, a zero vector counts as of length 1, and only equal lengths meet."""
    index, queries = index.where("embedding is not null"), queries.where("embedding is not null")
    blocks = max(1, math.ceil(index.count() / rows_per_block))
    dim = F.size("embedding").alias("dim")
    right = index.select("value", F.col("embedding").alias("e"), dim, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    left = queries.select("qid", F.col("embedding").alias("q"), dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    kinds = f"qid {dict(queries.dtypes)['qid']}, value {dict(index.dtypes)['value']}, score double"
    near = left.groupBy("dim", "block").cogroup(right.groupBy("dim", "block")).applyInPandas(functools.partial(_block_best, k=k), kinds)
    return ranked(near.groupBy("qid", "value").agg(F.max("score").alias("score")), k)


def cascade(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """The first list, then what only the second has; score counts down."""
    rows = first.select("qid", "value", F.lit(0).alias("arm"), "rank").union(second.select("qid", "value", F.lit(1), "rank"))
    best = rows.groupBy("qid", "value").agg(F.min(F.struct("arm", "rank")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.arm", "at.rank", "value")
    total = Window.partitionBy("qid")
    out = best.withColumn("rank", F.row_number().over(order)).withColumn("score", (F.count("*").over(total) - F.col("rank") + 1).cast("double"))
    return out.where(F.col("rank") <= k).select("qid", "value", "score", "rank")


def reciprocal_rank(first: DataFrame, second: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    rows = first.select("qid", "value", "rank").union(second.select("qid", "value", "rank"))
    out = rows.groupBy("qid", "value").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return ranked(out, k)


def weighted(first: DataFrame, second: DataFrame, k: int = 10, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Min-max scaled per list (no span: 1), weighed; a missing side counts 0."""

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        own = Window.partitionBy("qid")
        low, high = F.min("score").over(own), F.max("score").over(own)
        return rows.select("qid", "value", F.when(high > low, (F.col("score") - low) / F.when(high > low, high - low)).otherwise(1.0).alias(name))

    both = scaled(first, "a").join(scaled(second, "b"), ["qid", "value"], "full")
    score = weights[0] * F.coalesce("a", F.lit(0.0)) + weights[1] * F.coalesce("b", F.lit(0.0))
    return ranked(both.select("qid", "value", F.round(score, 9).alias("score")), k)


FUSIONS = {"cascade": cascade, "rrf": reciprocal_rank, "weighted": weighted}


def fused(first: DataFrame, second: DataFrame, mode: str = "cascade", k: int = 10) -> DataFrame:
    """Both lists give up to 2k; an unknown mode is warned of and falls back to the cascade."""
    if mode not in FUSIONS:
        warnings.warn(f"unknown fusion {mode!r}: one of {', '.join(FUSIONS)}; the cascade is taken", stacklevel=2)
    pool = lambda d: d.where(F.col("rank") <= 2 * k)
    return FUSIONS.get(mode, cascade)(pool(first), pool(second), k)


def union_in_order(*arms: DataFrame) -> DataFrame:
    """Candidates in the order of arms, each value once."""
    rows = reduce(lambda a, b: a.union(b), [a.select("qid", "value", F.lit(i).alias("arm"), "rank") for i, a in enumerate(arms)])
    best = rows.groupBy("qid", "value").agg(F.min(F.struct("arm", "rank")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.arm", "at.rank", "value")
    return best.select("qid", "value", F.row_number().over(order).alias("rank"))


def deepened(values: DataFrame, mentions: DataFrame, known: DataFrame, depth: int, round_: int) -> DataFrame:
    """More candidates in a later round: 5, 3, then 1 beyond the depth, without known ones."""
    k = depth + (5, 3, 1)[min(round_, 2)]
    return search(values, mentions, k).join(known.select("qid", "value"), ["qid", "value"], "left_anti")


def closest_value(values: DataFrame, mentions: DataFrame) -> DataFrame:
    """Top value over the whole graph by Jaro-Winkler similarity, ties by value."""
    from ..functions.udf import jaro_winkler

    rows = in_blocks(mentions.select("qid", "phrase"), values.select("value").distinct(), [], 16_384)
    scored = rows.select("qid", "value", F.round(jaro_winkler(F.lower("phrase"), F.lower("value")), 6).alias("score"))
    return ranked(scored, 1)
