"""Perturbed mentions, their validity, and repairs of texts that hold them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udf import spliced, word_occurrences
from .sampling import generator

FIELD = ["label", "prop"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def casing(value: str, rng) -> str | None:
    forms = [f for f in (value.lower(), value.upper(), value.title(), value.swapcase()) if f != value]
    return rng.choice(sorted(set(forms))) if forms else None


def typo(value: str, rng) -> str | None:
    """One edit of a letter, never the first: swap, drop, double or replace."""
    spots = [i for i in range(1, len(value)) if value[i].isalpha()]
    if len(value) < 4 or not spots:
        return None
    i = rng.choice(spots)
    kind = rng.choice(("swap", "drop", "double", "replace"))
    if kind == "swap" and i + 1 < len(value) and value[i] != value[i + 1]:
        return value[:i] + value[i + 1] + value[i] + value[i + 2 :]
    if kind == "drop":
        return value[:i] + value[i + 1 :]
    if kind == "double":
        return value[:i] + value[i] + value[i:]
    return value[:i] + rng.choice([c for c in LETTERS if c != value[i].lower()]) + value[i + 1 :]


def partial(value: str, df: dict[str, int]) -> str | None:
    """The token of the lowest frequency, the longer of equals."""
    tokens = value.split()
    return min(tokens, key=lambda t: (df.get(t.lower(), 0), -len(t), t)) if len(tokens) > 1 else None


def abbreviation(value: str) -> str | None:
    tokens = [t for t in value.split() if t.lower() not in ("of", "the", "and", "for")]
    return "".join(t[0].upper() for t in tokens) if len(tokens) > 1 else None


def perturbed(values: DataFrame, seed: int = 42, aliases: DataFrame | None = None) -> DataFrame:
    """(label, prop, value, strategy, mention): every strategy that applies, seeded by row.
    ``aliases`` has (value, alias)."""
    tokens = values.select(*FIELD, "value", F.explode(F.array_distinct(F.split(F.lower("value"), r"\s+"))).alias("t"))
    counted = tokens.join(tokens.groupBy(*FIELD, "t").agg(F.count("*").alias("df")), [*FIELD, "t"])
    rows = counted.groupBy(*FIELD, "value").agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("dfs"))

    def run(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                rng = generator(seed, r.label, r.prop, r.value)
                made = {"casing": casing(r.value, rng), "typo": typo(r.value, rng), "partial": partial(r.value, dict(r.dfs)), "abbrev": abbreviation(r.value)}
                out += [(r.label, r.prop, r.value, s, m) for s, m in made.items() if m and m != r.value]
            yield pd.DataFrame(out, columns=[*FIELD, "value", "strategy", "mention"])

    made = rows.mapInPandas(run, "label string, prop string, value string, strategy string, mention string")
    if aliases is not None:
        made = made.union(values.join(aliases, "value").where("alias <> value").select(*FIELD, "value", F.lit("alias"), F.col("alias")))
    return made


def validity(edits: DataFrame, values: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: valid) to (label, prop, value, strategy, mention).

    A mention that is another value of the field, whatever the case, collides. A partial
    one must be contained in no other value; a typo must not lie within one edit of
    another. Fields without values are unchecked. Distances are compared through shared
    deletions and containment through shared words, so nothing is paired with all values.
    """
    from .retrieval import signatures

    e = edits.withColumn("_m", F.lower("mention")).withColumn("_v", F.lower("value")).withColumn("_id", F.xxhash64(*edits.columns))
    v = values.select(*FIELD, F.lower("value").alias("_o")).distinct()
    other = lambda d: d.where("_o <> _v").select("_id").distinct()
    collide = other(e.join(v.withColumn("_m", F.col("_o")), [*FIELD, "_m"])).withColumn("collision", F.lit(True))
    words = lambda c: F.explode(F.array_distinct(F.split(c, r"\s+")))
    first = F.element_at(F.array_sort(F.transform(F.split("_m", r"\s+"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    held = e.where("strategy = 'partial'").withColumn("_t", first).join(v.withColumn("_t", words(F.col("_o"))), [*FIELD, "_t"]).where(F.contains(F.col("_o"), F.col("_m")))
    contained = other(held).withColumn("not_unique", F.lit(True))
    typos = e.where("strategy = 'typo'").withColumn("_s", F.explode(signatures(F.col("_m"))))
    near = typos.join(v.withColumn("_s", F.explode(signatures(F.col("_o")))), [*FIELD, "_s"]).where(X.osa_distance(F.col("_m"), F.col("_o")) <= 1)
    margin = other(near).withColumn("near", F.lit(True))
    fields = v.select(*FIELD).distinct().withColumn("known", F.lit(True))
    rows = e.join(collide, "_id", "left").join(contained, "_id", "left").join(margin, "_id", "left").join(fields, FIELD, "left")
    reason = F.when(F.col("known").isNull(), "unchecked").when(F.col("collision"), "collision").when(F.col("not_unique"), "not_unique").when(F.col("near"), "margin")
    return rows.select(*edits.columns, reason.alias("reason"))


def distinctive_token(values: DataFrame) -> DataFrame:
    """(label, prop, value, token): the token in the fewest values, the longer of equals."""
    tokens = values.select(*FIELD, "value", F.explode(F.array_distinct(F.split(F.lower("value"), r"\s+"))).alias("token"))
    df = tokens.groupBy(*FIELD, "token").agg(F.count("*").alias("df"))
    best = F.min_by("token", F.struct("df", -F.length("token"), "token"))
    return tokens.join(df, [*FIELD, "token"]).groupBy(*FIELD, "value").agg(best.alias("token"))


def applicability_ceiling(cells: DataFrame) -> DataFrame:
    """(graph, strategy, ceiling) of (graph, strategy, attested, probe_rate, precision,
    pool_share, synthetic): attested plus what probing adds; synthetic graphs have no aliases."""
    extra = F.col("precision") * F.col("probe_rate") * F.col("pool_share")
    ceiling = F.when(F.col("synthetic") & (F.col("strategy") == "alias"), 0.0).otherwise(F.least(F.lit(1.0), F.col("attested") + extra))
    return cells.select("graph", "strategy", F.round(ceiling, 6).alias("ceiling"))


def extracted(question: str, literals: list[str]) -> list[tuple[int, int, str]]:
    """Spans of literals in a question, the longest first at each place, overlaps dropped."""
    found = sorted(((s, e, v) for v in literals for s, e in word_occurrences(question, v)), key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for span in found:
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def entity_spans(rows: DataFrame) -> DataFrame:
    """(qid, start, end, value) of (qid, question, literals)."""

    def run(batches):
        for p in batches:
            out = [(q, *s) for q, t, ls in zip(p["qid"], p["question"], p["literals"]) if t is not None and ls is not None for s in extracted(t, list(ls))]
            yield pd.DataFrame(out, columns=["qid", "start", "end", "value"])

    return rows.select("qid", "question", "literals").mapInPandas(run, f"qid {dict(rows.dtypes)['qid']}, start int, end int, value string")


def repaired(rows: DataFrame) -> DataFrame:
    """Adds ``outcome`` (unchanged, repaired, dropped) and ``fixed`` to (original, value,
    mention, text): the edit is replayed on the original."""

    def run(batches):
        for p in batches:
            fixed = [None if None in x else spliced(*x) for x in zip(p["original"], p["value"], p["mention"])]
            p["fixed"] = fixed
            p["outcome"] = ["dropped" if f is None else "unchanged" if f == t else "repaired" for f, t in zip(fixed, p["text"])]
            yield p

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, fixed string, outcome string")


#: Patterns and words of entities that leaked into a text without being a value.
MONTHS = r"(january|february|march|april|may|june|july|august|september|october|november|december)"
ORDINAL_DATE, ISO_DATE = r"\b\d{1,2}(st|nd|rd|th)\b.*\d{4}", r"\d{4}-\d{2}-\d{2}"
NUMBERS, DESCRIPTOR, LONG_NUMBER = r"\d{2,}[-/.]\d{2,}", r"\b(number|no\.?|id|badge|phone|nhs|account|card|ip)\b", r"\d{5,}"
DOMAIN = r"\.(com|jp|org|net)\b"
SCHEMA_WORDS = (
    "accountholders", "accountholder", "moneytransfer", "moneytransfers", "purchases", "creditcards", "bankaccounts", "is_primary_suspect", "utc", "after", "tournament",
    "politicians", "country", "countries", "ceos", "crime participants", "home", "oceans", "aircraft manufacturers", "terrorist", "serial killer",
)


def leak_class(entity: Column) -> Column:
    """Classes of entities that no field holds; the first that fits. Null is read as empty."""
    e = F.coalesce(entity, F.lit(""))
    low = F.lower(e)
    return (
        F.when(low.rlike(MONTHS) | low.rlike(ORDINAL_DATE) | e.rlike(ISO_DATE), "A_date_datetime_leak").when(e.rlike(NUMBERS) | low.rlike(DESCRIPTOR) | e.rlike(LONG_NUMBER), "B_id_descriptor_leak")
        .when(low.isin(*SCHEMA_WORDS), "C_schema_or_common_noun").when(low.rlike(DOMAIN) | (low == "com"), "D_fragment_literal").otherwise("E_unmatched_maybe_format")
    )


def leak_action(result: Column, class_: Column) -> Column:
    """What to do with a row by its backfill result: unresolved ones are held if they are of the
    last class, else dropped; confirmed ones are set to ok; others stay."""
    return F.when(result == "unresolved", F.when(class_.startswith("E_"), "hold_E").otherwise("drop")).when(result.isin("ok_backfilled", "auto_ok_casing"), "flip_ok").otherwise("none")


def backfilled_validity(edits: DataFrame, values: DataFrame) -> DataFrame:
    """(mention, value, strategy, state) over every field that holds the value: ok if each
    is valid, casing always; without a field unresolved. It is the verdict that is tested."""
    contexts = edits.select("mention", "value", "strategy").withColumn("_k", F.lower("value")).join(values.select(*FIELD, F.lower("value").alias("_k")).distinct(), "_k")
    judged = validity(contexts.select(*FIELD, "value", "strategy", "mention"), values)
    verdict = judged.groupBy("mention", "value", "strategy").agg(F.max(F.col("reason").isNotNull()).alias("bad"))
    rows = edits.select("mention", "value", "strategy").join(verdict, ["mention", "value", "strategy"], "left")
    state = F.when(F.col("strategy") == "casing", "ok").when(F.col("bad").isNull(), "unresolved").when(F.col("bad"), "fail").otherwise("ok")
    return rows.select("mention", "value", "strategy", state.alias("state"))


def reasons(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy(F.concat_ws(":", "strategy", "reason").alias("reason")).agg(F.count("*").alias("n"))


def typo_to_partial(edits: DataFrame, values: DataFrame) -> DataFrame:
    """Typos whose value has a valid partial form take that form; others stay."""
    tokens = distinctive_token(values).where("token <> lower(value)")
    candidates = edits.where("strategy = 'typo'").join(tokens, [*FIELD, "value"]).select(*FIELD, "value", F.lit("partial").alias("strategy"), F.col("token").alias("mention"))
    good = validity(candidates, values).where("reason is null").select(*FIELD, "value", F.col("mention").alias("_p"))
    rows = edits.join(good, [*FIELD, "value"], "left")
    swap = (F.col("strategy") == "typo") & F.col("_p").isNotNull()
    return rows.select(*FIELD, "value", F.when(swap, "partial").otherwise(F.col("strategy")).alias("strategy"), F.when(swap, F.col("_p")).otherwise(F.col("mention")).alias("mention"))


def nested_difficulty(rows: DataFrame) -> DataFrame:
    """The difficulty of gold_cypher put into the struct _aug_meta where there is one."""
    from .evaluate import difficulty

    level = difficulty(F.col("gold_cypher"))["level"]
    return rows.withColumn("_aug_meta", F.when(F.col("_aug_meta").isNotNull(), F.col("_aug_meta").withField("difficulty", level)))
