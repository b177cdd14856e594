"""Intervals, agreement, verdicts and stratified reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96, clamp: bool = True) -> Column:
    """struct(low, high); n = 0: null (clamped form) or 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    d = 1 + z * z / m
    mid = (p + z * z / (2 * m)) / d
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    low, high = mid - half, mid + half
    if clamp:
        return F.struct(F.when(n > 0, F.greatest(low, F.lit(0.0))).alias("low"), F.when(n > 0, F.least(high, F.lit(1.0))).alias("high"))
    return F.struct(F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(0.0)).alias("high"))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """(a, b, n, kappa) for each pair of annotators over (item, annotator, label); expected
    agreement of 1 gives null."""
    r = ratings.where("label is not null").select("item", "annotator", "label")
    x = r.select("item", F.col("annotator").alias("a"), F.col("label").alias("la"))
    y = r.select("item", F.col("annotator").alias("b"), F.col("label").alias("lb"))
    pairs = x.join(y, "item").where("a < b").groupBy("a", "b", "la", "lb").agg(F.count("*").alias("k"))
    total = pairs.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("k")).otherwise(0)).alias("same"))
    left = pairs.groupBy("a", "b", F.col("la").alias("label")).agg(F.sum("k").alias("ka"))
    right = pairs.groupBy("a", "b", F.col("lb").alias("label")).agg(F.sum("k").alias("kb"))
    chance = left.join(right, ["a", "b", "label"]).groupBy("a", "b").agg(F.sum(F.col("ka") * F.col("kb")).alias("e"))
    rows = total.join(chance, ["a", "b"], "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return rows.select("a", "b", "n", F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def _item_counts(ratings: DataFrame, least: int) -> DataFrame:
    counts = ratings.where("label is not null").groupBy("item", "label").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("item").agg(F.sum("c").alias("m")).where(F.col("m") >= least)
    return counts.join(sizes, "item")


def gwet_ac1(ratings: DataFrame) -> DataFrame:
    """(items, ac1) over items with two ratings or more; fewer than two categories: null."""
    c = _item_counts(ratings, 2)
    per_item = c.groupBy("item").agg((F.sum(F.col("c") * (F.col("c") - 1)) / F.max(F.col("m") * (F.col("m") - 1))).alias("agree"))
    overall = per_item.agg(F.count("*").alias("items"), F.avg("agree").alias("pa"))
    share = c.groupBy("label").agg(F.sum(F.col("c") / F.col("m")).alias("s")).crossJoin(F.broadcast(overall))
    q = F.col("s") / F.col("items")
    out = share.agg(F.max("items").alias("items"), F.max("pa").alias("pa"), F.count("*").alias("k"), F.sum(q * (1 - q)).alias("v"))
    pe = F.col("v") / (F.col("k") - 1)
    return out.select(F.coalesce("items", F.lit(0)).alias("items"), F.round(F.when(F.col("k") >= 2, (F.col("pa") - pe) / (1 - pe)), 6).alias("ac1"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """(n, alpha), nominal; no expected disagreement: 1; one rating or none: null."""
    c = _item_counts(ratings, 2)
    per_label = c.groupBy("label").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("o"))
    out = per_label.agg(F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))
    n = F.coalesce("n", F.lit(0))
    do = 1 - F.col("o") / F.col("n")
    de = 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return out.select(n.alias("n"), F.round(F.when(n > 1, F.when(de == 0, 1.0).otherwise(1 - do / F.when(de != 0, de))), 6).alias("alpha"))


def collapsed_verdicts(ratings: DataFrame) -> DataFrame:
    """(item, verdict): a source error wins, then an adjudication, then unanimity (unsure
    is never final); everything else is pending. Calibration rows don't count."""
    rows = ratings.where("not coalesce(calibration, false)")
    out = rows.groupBy("item").agg(
        F.max(F.coalesce(F.col("label") == "source_error", F.lit(False))).alias("source"),
        F.max(F.when(F.col("annotator") == "adjudicator", F.col("label"))).alias("adjudicated"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("label").alias("n"),
    )
    same = (F.col("low") == F.col("high")) & (F.col("low") != "unsure") & (F.col("n") >= 2)
    verdict = F.when(F.col("source"), "source_error").when(F.col("adjudicated").isNotNull(), F.col("adjudicated")).when(same, F.col("low")).otherwise("pending")
    return out.select("item", verdict.alias("verdict"))


def stratified(items: DataFrame, strata: list[str], good: Column) -> DataFrame:
    """(stratum, value, n, k, low, high) for all rows, each stratum, and each crossing."""
    places = [F.struct(F.lit("ALL").alias("stratum"), F.lit("ALL").alias("value"))]
    places += [F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("-")).alias("value")) for s in strata]
    places += [
        F.struct(F.lit(f"{a}*{b}").alias("stratum"), F.concat_ws("/", F.coalesce(F.col(a).cast("string"), F.lit("-")), F.coalesce(F.col(b).cast("string"), F.lit("-"))).alias("value"))
        for i, a in enumerate(strata) for b in strata[i + 1 :]
    ]
    rows = items.select(F.explode(F.array(*places)).alias("s"), good.cast("int").alias("g"))
    out = rows.groupBy("s.stratum", "s.value").agg(F.count("*").alias("n"), F.sum("g").alias("k"))
    ci = wilson(F.col("k"), F.col("n"))
    return out.select("stratum", "value", "n", "k", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


def decision(verdict: Column, policy: str = "strict") -> Column:
    """keep, remove or revert: pending rows are kept unless the policy is strict."""
    return F.when(verdict == "valid", "keep").when(verdict == "source_error", "remove").when(verdict == "invalid", "revert").when(F.lit(policy == "strict"), "remove_pending").otherwise("keep")


def adjudication_worklist(ratings: DataFrame) -> DataFrame:
    """(item, votes) of items in dispute: ``A=valid; B=invalid``, raters sorted, blanks -."""
    vote = F.concat_ws("=", "annotator", F.coalesce("label", F.lit("-")))
    rows = ratings.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list(vote)), "; ").alias("votes"), F.count_distinct("label").alias("k"), F.count("*").alias("n"), F.count("label").alias("given"))
    return rows.where("k > 1 or given < n").select("item", "votes")
