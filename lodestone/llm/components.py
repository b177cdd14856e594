"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Each node's neighbours (large: the greater
    ones; small: the lesser ones and itself) are linked to its least neighbour."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    met = near.join(least, near.u == least.c)
    moved = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``: root is the least node it is connected to.

    Both steps keep the components and only ever hold as many rows as there are links.
    A hub's neighbours meet only in partial minima and in joins that adaptive execution
    can split. Null ends, self links and repeated links are ignored; no links, no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"{a} is not null and {b} is not null and {a} <> {b}"
    )
    edges = cut(edges.distinct())
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
        edges = cut(_star(_star(edges, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
