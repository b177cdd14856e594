"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a run of characters of keys. By its characters it belongs to a class
(hex, digits with letters, letters of both cases) with its own alphabet and threshold.
A window slides over it; the counts of its characters, as digits of a string, and the
sum of c * log2(c) are carried along: a step changes the two counts of the character that
leaves and the one that enters.
The entropy of a window of w is log2(w) - sum / w. A candidate whose highest window
reaches its class's threshold is a span, unless it is on the allow list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import number_of, with_matches

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Classes in order: name, pattern of the whole candidate, alphabet, threshold in bits.
CLASSES = (
    ("entropy_hex", r"^(?=.*[a-fA-F])(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 3.0),
    ("entropy_mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6),
    ("entropy_cased", r"^(?=.*[a-z][A-Z])(?=.*[A-Z][a-z])[A-Za-z+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.9),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[a-z+/_=-]*[A-Z0-9])[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: UUIDs, paths and dated names, repeats, placeholders, ordered runs.
ALLOW = (
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^(?:/?[A-Za-z]+[/_-])++[A-Za-z]*[0-9]{0,4}$",  # possessive: a loop, where a greedy group would be a recursion
    r"^[A-Za-z_-]+[0-9]{1,8}$",
    r"(.)\1{7,}",
    r"(?i)example|placeholder|dummy|changeme|xxxx|0123456789|1234567890|abcdefgh",
)


NONE = 0x20  # a count of 0 in the string of counts


def window_entropy(value: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy in bits of any ``window`` characters (94 at most) of
    ``value``, all of ``alphabet``; of the whole value if it is shorter."""
    if not 0 < window <= 0x7E - NONE:
        raise ValueError(f"a window has 1 to {0x7E - NONE} characters")
    sums = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    chars = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    size = F.length(value)
    gone = F.concat(F.array_repeat(F.lit(0), window), F.slice(chars, F.lit(1), F.greatest(size - window, F.lit(0))))
    moves = F.zip_with(chars, F.slice(gone, F.lit(1), size), lambda c, g: F.struct(c.alias("come"), g.alias("gone")))

    def count(counts: Column, k: Column) -> Column:
        return F.ascii(F.substring(counts, k, F.lit(1))) - NONE

    def put(counts: Column, k: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + NONE), k, F.lit(1))

    def step(acc: Column, x: Column) -> Column:  # what it returns is copied at each step: nothing long may be carried along
        come, gone, at = x["come"], x["gone"], acc["at"] + 1
        leaves = (come != gone) & (gone > 0)
        down = count(acc["counts"], F.greatest(gone, F.lit(1)))
        left = F.when(leaves, put(acc["counts"], gone, down - 1)).otherwise(acc["counts"])
        up = count(left, come)
        counts = F.when(come == gone, acc["counts"]).otherwise(put(left, come, up + 1))
        change = F.get(sums, up + 1) - F.get(sums, up) + F.when(leaves, F.get(sums, down - 1) - F.get(sums, down)).otherwise(0.0)
        total = acc["total"] + F.when(come == gone, F.lit(0.0)).otherwise(change)
        full = F.least(at, F.lit(window)).cast("double")
        entropy = F.log2(full) - total / full
        best = F.when(((at >= window) | (at == acc["size"])) & (entropy > acc["best"]), entropy).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"), at.alias("at"), acc["size"].alias("size"))

    zero = F.struct(
        F.lit(chr(NONE) * len(alphabet)).alias("counts"), F.lit(0.0).cast("double").alias("total"), F.lit(0.0).cast("double").alias("best"), F.lit(0).alias("at"), size.alias("size")
    )
    return F.aggregate(moves, zero, step, lambda acc: acc["best"])


def _suspicious(value: Column, window: int) -> Column:
    """The class of a candidate whose entropy reaches the class's threshold, or null."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | value.rlike(pattern)
    kind = F
    for name, pattern, alphabet, least in CLASSES:
        high = window_entropy(value, alphabet, window) >= least
        kind = kind.when(value.rlike(pattern), F.when(high, F.lit(name)))
    return F.when(~allowed, kind)


def secret_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (kind, start, end, value), by
    start and then kind as listed (assign, access, hex, then the entropy classes).

    Offsets are code points, end exclusive. Null text: empty, no spans. Repeated rows and
    null doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_matches(text, {**BASE, "candidate": CANDIDATE}).drop("text")
    assign = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    suspects = F.filter(
        F.transform("candidate", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _suspicious(s["value"], window).alias("kind"))),
        lambda s: s["kind"].isNotNull(),
    )
    found = found.select("doc_id", assign.alias("assign"), "access", "hex", F.when(F.size("candidate") > 0, suspects).alias("suspects"))

    def named(spans: Column, order: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    more = F.transform(
        F.coalesce("suspects", F.expr("array()").cast("array<struct<start:int,end:int,value:string,kind:string>>")),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
    )
    spans = F.array_sort(F.concat(*[named(F.col(k), i, k) for i, k in enumerate(BASE)], more))
    return found.select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row."""
    found = secret_spans(docs, window)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [number_of("spans", k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].startswith("entropy"))).cast("long").alias("n_entropy"),
    )
