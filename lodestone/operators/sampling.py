"""Deterministic samples, quotas and assignments; order by hashes, never by chance."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def seeded(key: Column, seed: int) -> Column:
    """A place in a fixed shuffled order, the same in any engine with MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def placed(df: DataFrame, group: str, key: str, name: str = "_place") -> DataFrame:
    """``df`` with each row's place (from 0) within its group by ``key``. Rows are sorted over
    ranges, so a group may lie in many tasks; the ranges' counts, one row for each range and
    group, give where each goes on. Null groups are a group."""
    rows = checkpointed(df.repartitionByRange(group, key).sortWithinPartitions(group, key))
    rows = rows.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = rows.groupBy("_range", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_range").alias("_r"), "_group", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = rows.join(parts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """The first ``per_stratum`` of each stratum in a shuffled order. Up to 1,000 are kept by each
    task before strata meet (Spark's limit for groups), so a hot stratum is no task's."""
    order = Window.partitionBy(*strata).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_stratum).drop("_n")


def proportional_sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """About k rows: from each stratum max(1, round(k * its share))."""
    total = df.agg(F.count("*").alias("_all"))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size")).crossJoin(F.broadcast(total))
    quota = sizes.select(stratum, F.greatest(F.lit(1), F.round(k * F.col("_size") / F.col("_all"), 0).cast("int")).alias("_quota"))
    order = Window.partitionBy(stratum).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(order)).join(quota, stratum).where("_n <= _quota").drop("_n", "_quota")


def census(df: DataFrame, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"))


def round_robin(df: DataFrame, group: str, key: str, reviewers: int) -> DataFrame:
    """reviewer = place within the group modulo the number of reviewers."""
    return placed(df.select(group, key), group, key).select(group, key, (F.col("_place") % reviewers).cast("int").alias("reviewer"))


def rotating_pairs(df: DataFrame, group: str, key: str, annotators: list[str]) -> DataFrame:
    """Two different annotators for each row, all pairs in turn."""
    pairs = [(a, b) for i, a in enumerate(annotators) for b in annotators[i + 1 :]]
    place = (F.col("_place") % len(pairs)).cast("int")
    names = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])
    pair = F.get(names, place)
    return placed(df.select(group, key), group, key).select(group, key, pair["first"].alias("first"), pair["second"].alias("second"))


def rebalanced(df: DataFrame, strategy: str, key: str, caps: dict[str, int], need: int) -> DataFrame:
    """Donors in the order of ``caps``: of each strategy at most its cap, in all ``need``."""
    rank = F.lit(None).cast("int")
    cap = F.lit(0)
    for i, (name, most) in enumerate(caps.items()):
        rank = F.when(F.col(strategy) == name, i).otherwise(rank)
        cap = F.when(F.col(strategy) == name, most).otherwise(cap)
    own = Window.partitionBy(strategy).orderBy(key)
    donors = df.withColumn("_r", rank).where("_r is not null").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap)
    sizes = donors.groupBy("_r").agg(F.count("*").alias("_k"))
    before = sizes.select("_r", F.coalesce(F.sum("_k").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each strategy
    return donors.join(before, "_r").where(F.col("_before") + F.col("_n") <= need).drop("_r", "_n", "_before")


class QuotaSampler:
    """Stateful: the strategy with the largest deficit against its target share comes
    first; a capped strategy is passed over once its cap is reached."""

    def __init__(self, targets: dict[str, float], caps: dict[str, float] | None = None):
        self.targets, self.caps, self.taken = targets, caps or {}, Counter()

    def order(self) -> list[str]:
        n = sum(self.taken.values()) + 1
        deficit = {s: t * n - self.taken[s] for s, t in self.targets.items()}
        open_ = [s for s in self.targets if s not in self.caps or self.taken[s] + 1 <= self.caps[s] * n]
        return sorted(open_, key=lambda s: (-deficit[s], s))

    def take(self, eligible: set[str]) -> str | None:
        choice = next((s for s in self.order() if s in eligible), None)
        if choice:
            self.taken[choice] += 1
        return choice


def quota_choices(df: DataFrame, group: str, key: str, eligible: str, targets: dict[str, float], caps: dict[str, float] | None = None) -> DataFrame:
    """(group, key, strategy): the sampler run in key order within each group."""

    def run(rows):
        sampler = QuotaSampler(targets, caps)
        rows = rows.sort_values(key)
        rows["strategy"] = [sampler.take(set(e)) for e in rows[eligible]]
        return rows[[group, key, "strategy"]]

    kinds = dict(df.dtypes)
    return df.select(group, key, eligible).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, strategy string")


def distribution(df: DataFrame, strategy: str, targets: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(strategy, n, share, flagged): shares outside the tolerance around their target."""
    total = df.agg(F.count("*").alias("_all"))
    goal = F.lit(None).cast("double")
    for name, t in targets.items():
        goal = F.when(F.col(strategy) == name, t).otherwise(goal)
    rows = df.groupBy(strategy).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    share = F.col("n") / F.col("_all")
    return rows.select(strategy, "n", F.round(share, 6).alias("share"), F.coalesce(F.abs(share - goal) > tolerance, F.lit(True)).alias("flagged"))


def seed_of(*parts: object) -> int:
    """The first 8 bytes of SHA-256 of the parts joined by a pipe."""
    import hashlib

    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def generator(*parts: object) -> random.Random:
    return random.Random(seed_of(*parts))
