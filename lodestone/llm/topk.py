"""Exact top-k inner products by no-random-access aggregation.

Each component of the vectors is a list of its values over a block of rows, and a query
reads the lists in the order of its own components' magnitudes, heaviest first. For
every row of the block it keeps the sum of the products read so far; what is unread is
bounded from both sides by the norms of the unread parts (Cauchy-Schwarz). The k-th best
lower bound is the threshold: rows whose upper bound is below it are outsiders, and no
further list is read for them. Rows that stay until the last list have their final
score, so nothing is ever looked up by row.

Blocks are clusters of rows. They form a sorted list too, by the upper bound that centre
and radius give; a query reads it from the top and stops at the first block that can't
hold a row that qualifies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: Rows, at most, that are read to the end first, so that a query has a threshold.
SEED = 512
#: A block's first lists are read at once: so many that the unread part's usual bound is this share of what is missing to the threshold.
SHARE = 0.6


@dataclass
class Block:
    """A cluster of rows as lists: component by row."""

    at: np.ndarray  # places of its rows
    lists: np.ndarray
    squares: np.ndarray
    norms: np.ndarray  # squared
    centre: np.ndarray
    radius: float
    reach: float


def blocks_of(x: np.ndarray, size: int, kind: type) -> list[Block]:
    """A first block of rows spread over all, then rows by the nearest of some pivots; large
    clusters are cut, small ones share a block."""
    own = x.astype(np.float64)
    every = max(8, math.ceil(len(x) / SEED))
    seeds, others = np.arange(0, len(x), every), np.flatnonzero(np.arange(len(x)) % every)
    places, n = [seeds, *([others] if len(others) else [])], len(others)
    if n > size:
        parts = math.ceil(2 * n / size)
        pivots = own[others[np.arange(parts) * n // parts]]
        nearest = np.concatenate([(own[others[i : i + 8192]] @ pivots.T - (pivots**2).sum(1) / 2).argmax(1) for i in range(0, n, 8192)])
        order = np.argsort(nearest, kind="stable")
        places = [seeds]
        for cluster in np.split(others[order], np.flatnonzero(np.diff(nearest[order])) + 1):
            if len(places) > 1 and len(places[-1]) + len(cluster) <= size:
                places[-1] = np.concatenate([places[-1], cluster])
            else:
                places += np.array_split(cluster, math.ceil(len(cluster) / size))
    out = []
    for at in places:
        rows = own[at]
        centre, squares = rows.mean(0), (rows**2).T
        norms = squares.sum(0)
        radius = math.sqrt(((rows - centre) ** 2).sum(1).max(initial=0.0))
        lists = [np.ascontiguousarray(m, kind) for m in (rows.T, squares)]
        out.append(Block(at, *lists, norms.astype(kind), centre, radius, math.sqrt(norms.max(initial=0.0))))
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = 4096, step: int = 12) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query row (ids, scores) of its best k in ``x``, its own id left out, ties to
    the smaller id; and for each query how many list entries it read and how many rows'
    final scores it came to. Integers of up to 2^26; sums are exact in the float kind used."""
    d = x.shape[1]
    high = float(np.abs(x).max(initial=0))
    kind = np.float32 if high * max(high, float(np.abs(queries).max(initial=0))) * max(1, d) < 2**24 else np.float64
    slack = 1 + (1e-5 if kind is np.float32 else 1e-12)  # of rounded roots and products
    blocks = blocks_of(x, min(block, max(256, len(x) // 8)), kind)
    q64 = queries.astype(np.float64)
    lengths = np.sqrt((q64**2).sum(1))
    middle = q64 @ np.array([b.centre for b in blocks]).T
    top = middle + lengths[:, None] * np.array([b.radius for b in blocks]) * slack + 1e-6 * (1 + np.abs(middle))
    orders = np.argsort(-np.abs(q64), 1, kind="stable")
    typical = np.sqrt(1 - np.arange(d + 1) / d)
    ones, slots = np.ones(d, kind), np.arange(len(queries))
    work = np.zeros((len(queries), 2), np.int64)
    tails = np.sqrt(np.cumsum(np.take_along_axis(q64, orders, 1)[:, ::-1] ** 2, 1)[:, ::-1]) * slack  # of each query's lists from a place on
    tails = np.hstack([tails, np.zeros((len(queries), 1))])
    least = np.full(len(queries), -math.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    order = np.hstack([np.zeros((len(queries), 1), int), 1 + np.argsort(-top[:, 1:], 1, kind="stable")])
    for turn in order.T:  # each query's next block; queries that read the same block follow each other
        turn = np.where(top[slots, turn] < np.where(turn > 0, least, -math.inf), -1, turn)
        for i in np.argsort(turn, kind="stable")[(turn < 0).sum() :].tolist():
            b, dims = turn[i], orders[i]
            rows, q = blocks[b], q64[i, dims].astype(kind)
            own, bar = ids[rows.at], float(least[i])
            m = d
            if bar > middle[i, b]:  # so many lists that most rows are outsiders afterwards
                m = min(d, int(np.searchsorted(-tails[i] * typical, -SHARE * (bar - middle[i, b]) / rows.reach)))
            sums = q[:m] @ np.take(rows.lists, dims[:m], 0)
            work[i, 0] += m * len(own)
            alive = np.flatnonzero(own != query_ids[i])
            if m < d:
                left = rows.norms - ones[:m] @ np.take(rows.squares, dims[:m], 0)
                gap = kind(tails[i, m]) * np.sqrt(np.maximum(left, 0))
                alive = np.flatnonzero((sums + gap >= bar) & (own != query_ids[i]))
                left = left[alive]
            sums = sums[alive]
            while m < d and len(alive):
                to = min(d, m + step)
                new = np.take(np.take(rows.lists, dims[m:to], 0), alive, 1)
                sums = sums + q[m:to] @ new
                work[i, 0] += new.size
                m = to
                if m < d:
                    left = left - ones[: len(new)] @ (new * new)
                    gap = kind(tails[i, m]) * np.sqrt(np.maximum(left, 0))
                    if len(alive) > k:
                        bar = max(bar, float(np.partition(sums - gap, len(alive) - k)[len(alive) - k]))
                    stay = np.flatnonzero(sums + gap >= bar)
                    alive, sums, left = alive[stay], sums[stay], left[stay]
            work[i, 1] += len(alive)
            if len(alive):
                who, final = np.r_[found[i][0], own[alive]], np.r_[found[i][1], sums.astype(np.float64)]
                if len(final) > k:
                    keep = final >= np.partition(final, len(final) - k)[len(final) - k]
                    who, final = who[keep], final[keep]
                rank = np.lexsort((who, -final))[:k]
                found[i] = who[rank], final[rank]
                if len(rank) == k:
                    bar = max(bar, float(final[rank[-1]]))
            least[i] = bar
    return [(who, final.astype(np.int64)) for who, final in found], work


#: Queries and rows of a cell of the grid, at most (in expectation).
QUERIES, ROWS = 4096, 65_536
RESULT = "query_id long, vec_id long, score long"
WORK = "query_id long, entries_read long, entries long, rows_resolved long, rows long"


def _cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block: int, work: bool) -> pd.DataFrame:
    names = [c.split()[0] for c in (WORK if work else RESULT).split(", ")]
    if not len(queries) or not len(rows):
        return pd.DataFrame({c: [] for c in names}, dtype="int64")
    rows = rows.sort_values("vec_id", kind="stable")
    ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    x, q = (np.stack(t["v"].to_list()).astype(np.int64) for t in (rows, queries))
    found, done = search(q, q_ids, x, ids, k, block)
    if work:
        columns = q_ids, done[:, 0], np.full(len(q), x.size), done[:, 1], np.full(len(q), len(x))
    else:
        columns = np.repeat(q_ids, [len(w) for w, _ in found]), np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])
    return pd.DataFrame(dict(zip(names, columns)))


def quantised(vectors: DataFrame, scale: int = 64, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    x = F.col(column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_column).isNotNull() & whole & (F.size(x) > 0)).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v")
    )


def _grid(vectors: DataFrame, k: int, every: int, scale: int, queries_per_cell: int, rows_per_cell: int, block: int, work: bool) -> DataFrame:
    # rows are dealt by their places in what was written, not by ids, which may be shared
    rows = cut(quantised(vectors, scale)).withColumn("place", F.monotonically_increasing_id())
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked, cores = rows.count(), asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    n_rows = max(1, math.ceil(n / rows_per_cell))
    n_queries = max(1, math.ceil(n_asked / queries_per_cell), min(math.ceil(cores / n_rows), math.ceil(n_asked / 128)))
    spread = lambda parts, seed: F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dim = F.size("v").alias("dim")
    right = rows.select("vec_id", "v", dim, spread(n_rows, 1).alias("rb"), all_of(n_queries).alias("qb"))
    left = asked.select("vec_id", "v", dim, spread(n_queries, 2).alias("qb"), all_of(n_rows).alias("rb"))
    key = ["dim", "rb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(partial(_cell, k=k, block=block, work=work), WORK if work else RESULT)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, queries_per_cell: int = QUERIES, rows_per_cell: int = ROWS, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by
    ``every``, its k highest integer inner products among all rows of other ids and the
    same length; fewer rows give fewer. Ties go to the smaller vec_id.

    Vectors that are null or empty, hold null or non-finite components, or have no id
    take no part; rows are told apart by vec_id, repeated rows are rows. The grid of query
    and row blocks has cells of a fixed expected size; each gives k rows for a query at most.
    """
    found = _grid(vectors, k, every, scale, queries_per_cell, rows_per_cell, block, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def work_of(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, queries_per_cell: int = QUERIES, rows_per_cell: int = ROWS, block: int = 4096) -> DataFrame:
    """What ``top_k`` reads: for each query the list entries read of all, and the rows whose
    final score was resolved of all."""
    done = _grid(vectors, k, every, scale, queries_per_cell, rows_per_cell, block, True)
    return done.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("entries_read", "entries", "rows_resolved", "rows")])
