"""Matches of patterns with their places, by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: An aggregate copies what it carries at each step, so spans are made in parts of so many.
PART = 64


def placed(matches: Column, gaps: Column) -> Column:
    """(start, end, value) of each match in code points, end exclusive, given all matches
    and the texts between them."""
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    count = F.ceil(F.size(matches) / F.lit(PART)).cast("int")
    parts = _once(pairs, lambda p: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(p, i * PART + 1, F.lit(PART))))
    long = lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["m"]))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).alias("spans"))

    def of_part(part: Column, before: Column) -> Column:
        zero = F.struct(F.aggregate(before, F.lit(0), lambda a, b: a + b).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(part, zero, step, lambda acc: acc["spans"])

    lengths = lambda ps: F.transform(ps, long)
    return _once(parts, lambda ps: _once(lengths(ps), lambda ls: F.flatten(F.transform(ps, lambda part, i: of_part(part, F.slice(ls, F.lit(1), i))))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, in which the value is computed once, whatever lambdas it stands in."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_matches(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Adds, for each name, the array of all leftmost non-overlapping matches' places.
    Texts without a match are not split."""
    found = df.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{n}") for n, p in patterns.items()])
    spans = [
        F.when(F.size(f"_{n}") > 0, placed(F.col(f"_{n}"), F.split(text, p, -1))).otherwise(F.array().cast(SPAN)).alias(n)
        for n, p in patterns.items()
    ]
    return found.select(*df.columns, *spans)


def number_of(spans: str, kind: str) -> Column:
    """How many of an array of spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
