"""Evidence, existence gates, validation and snapping of query literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cypher.parser import Match, Query, parse, walk
from ..functions import text as X
from ..plans.catalog import GraphCatalog
from .retrieval import FIELD

#: Property names that name a thing.
NAME_LIKE = ("name", "title", "label", "fullname", "full_name")


def grounded(mention: Column, values: Column) -> Column:
    """Containment either way after squeezing; an empty mention is not grounded."""
    m = X.squeezed(mention)
    return F.when(m == "", F.lit(False)).otherwise(F.exists(values, lambda v: F.contains(X.squeezed(v), m) | F.contains(m, X.squeezed(v))))


def existing(claims: DataFrame, values: DataFrame) -> DataFrame:
    """(label, prop, value) that exist as they are."""
    return claims.join(values, [*FIELD, "value"], "left_semi")


def validated(claims: DataFrame, catalog: GraphCatalog, values: DataFrame) -> DataFrame:
    """Claims of kinds label, edge and value, with a problem where the catalog says no. A
    bad label suppresses the verdicts on its values and edges."""
    spark = claims.sparkSession
    labels = spark.createDataFrame([(x,) for x in catalog.labels()], "label string")
    triples = [t for a, r, b in catalog.triples() for t in ((a, r, b), (b, r, a))]
    edges = spark.createDataFrame(sorted(set(triples)), "label string, type string, other string")
    known = labels.withColumn("_l", F.lit(True))
    rows = claims.join(known, "label", "left").join(edges.withColumn("_e", F.lit(True)), ["label", "type", "other"], "left")
    rows = rows.join(values.withColumn("_v", F.lit(True)), [*FIELD, "value"], "left")
    problem = (
        F.when(F.col("_l").isNull(), F.when(F.col("kind") == "label", "unknown label"))
        .when((F.col("kind") == "edge") & F.col("_e").isNull(), "no such edge")
        .when((F.col("kind") == "value") & F.col("_v").isNull(), "no such value")
    )
    return rows.withColumn("problem", problem).drop("_l", "_e", "_v")


def literals(text: str) -> list[tuple[str | None, str, str]]:
    """(label, property, value) of string equalities in a query; function wrappers around
    the property are looked through, other comparisons left out."""
    out: list[tuple[str | None, str, str]] = []

    def visit(query: Query, labels: dict[str, str]) -> None:
        for clause in (c for b in query.branches for c in b):
            exprs = []
            if isinstance(clause, Match):
                for p in clause.paths:
                    for x in [*p.nodes, *p.rels]:
                        own = (x.labels if hasattr(x, "labels") else x.types) or [labels.get(x.var)]
                        if x.var and own[0]:
                            labels[x.var] = own[0]
                        out.extend((own[0], k, v[1]) for k, v in x.props.items() if v[0] == "lit" and isinstance(v[1], str))
                        exprs.append(x.where)
                exprs.append(clause.where)
            elif hasattr(clause, "query"):
                visit(clause.query, labels)
            elif hasattr(clause, "items"):
                exprs += [clause.where, *[i[0] for i in clause.items]]
            for e in exprs:
                for x in walk(e):
                    if x[0] in ("exists", "count", "collect"):
                        visit(x[1], labels)
                    if x[0] == "bin" and x[1] == "=":
                        for side, value in ((x[2], x[3]), (x[3], x[2])):
                            while side[0] == "fn" and len(side[3]) == 1:
                                side = side[3][0]
                            if side[0] == "prop" and side[1][0] == "var" and value[0] == "lit" and isinstance(value[1], str):
                                out.append((labels.get(side[1][1]), side[2], value[1]))

    visit(parse(text), {})
    return list(dict.fromkeys(out))


def first_judge(mention: str, candidates: list[tuple[str, float]], least: float = 0.5) -> str | None:
    """The offline default: the best candidate above a threshold, else none."""
    return candidates[0][0] if candidates and candidates[0][1] >= least else None


Judge = Callable[[str, list[tuple[str, float]]], str | None]


def snapped(catalog: GraphCatalog, values: DataFrame, text: str, judge: Judge = first_judge, k: int = 5) -> str:
    """A query with literals that don't exist replaced by an existing one. What exists is
    never touched, a replacement is one of the candidates, both kinds of quotes are met."""
    from .retrieval import lev_topk

    spark = values.sparkSession
    claims = [(i, *c) for i, c in enumerate(literals(text)) if c[0] in catalog.labels()]
    if not claims:
        return text
    rows = spark.createDataFrame(claims, "qid int, label string, prop string, value string")
    absent = rows.join(values, [*FIELD, "value"], "left_anti").withColumnRenamed("value", "phrase")
    found: dict[int, tuple[str, list]] = {r["qid"]: (r["phrase"], []) for r in absent.collect()}
    for r in lev_topk(values, absent, k).orderBy("qid", "rank").collect():
        found[r["qid"]][1].append((r["value"], r["score"]))
    for phrase, candidates in found.values():
        choice = judge(phrase, candidates)
        if choice is not None and choice in [c for c, _ in candidates]:
            for q in "'\"":
                escaped = choice.replace("\\", "\\\\").replace(q, "\\" + q)
                text = text.replace(f"{q}{phrase}{q}", f"{q}{escaped}{q}")
    return text


def field_menu(catalog: GraphCatalog, used: set[tuple[str, str]] = frozenset()) -> list[tuple[str, str]]:
    """Fields that name things, without used ones."""
    fits = lambda p: p.lower() in NAME_LIKE or p.lower().endswith(("name", "title"))
    return [(label, p) for label, n in catalog.nodes.items() for p in n.props if fits(p) and (label, p) not in used]


def registry(catalog: GraphCatalog) -> list[tuple[str, str, str | None, str]]:
    """(tool, label or type, property, kind), one for each field and structure."""
    rows = [(f"{label}.{p}".lower(), label, p, "node") for label, n in catalog.nodes.items() for p in n.props]
    rows += [(f"{e.type}.{p}".lower(), e.type, p, "rel") for e in catalog.edges for p in e.props]
    return rows + [(f"{a}-{r}-{b}".lower(), r, None, "structure") for a, r, b in catalog.triples()]


def routed(catalog: GraphCatalog, descriptors: DataFrame, n: int = 3) -> DataFrame:
    """(qid, tool, score, rank): tools by shared words of a descriptor; the wanted kind first."""
    from pyspark.sql import Window

    tools = descriptors.sparkSession.createDataFrame(registry(catalog), "tool string, owner string, prop string, kind string")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    a = descriptors.select("qid", F.col("kind").alias("wanted"), F.explode(words(F.col("descriptor"))).alias("w"))
    b = tools.select("tool", "kind", F.explode(words(F.regexp_replace("tool", "_", " "))).alias("w"))
    scored = a.join(b, "w").groupBy("qid", "tool", "wanted", "kind").agg(F.count("*").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.col("kind").eqNullSafe(F.col("wanted"))), F.desc("score"), "tool")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("qid", "tool", "score", "rank")


def expanded(catalog: GraphCatalog, chosen: list[str], demanded: set[str]) -> list[str]:
    """The chosen tools and the first node tool of each demanded label that none covers."""
    rows = registry(catalog)
    covered = {owner for tool, owner, _, kind in rows if tool in chosen and kind == "node"}
    extra = [min(t for t, owner, _, kind in rows if owner == label and kind == "node") for label in sorted(demanded - covered) if label in catalog.nodes and catalog.nodes[label].props]
    return [*chosen, *extra]


def backfilled(evidence: dict[str, list[str]], recovered: dict[str, list[str]]) -> dict[str, list[str]]:
    return {**{k: v for k, v in recovered.items() if k not in evidence}, **evidence}


def collapsed_results(values: Column) -> Column:
    """One level flattened, nulls dropped, each once."""
    return F.array_distinct(F.array_compact(F.flatten(values)))


def formatted(evidence: list[dict]) -> str:
    """The block that goes into a prompt; {} for none."""
    import json

    return json.dumps({e["mention"]: {c["label"] + "." + c["property"]: c["values"] for c in e["candidates"]} for e in evidence}, ensure_ascii=False) if evidence else "{}"
