"""Rewrites of parsed queries: what a query touches, and the nodes it returns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import GraphCatalog
from .binder import Binder, State
from .parser import Match, Projection, parse


class NotRewritable(ValueError):
    """The query has no leading MATCH, or what it matches can't be told apart."""


def _matched(branch: list) -> list:
    """The clauses before the first projection; WITH of plain variables is passed over."""
    out = []
    for clause in branch:
        if isinstance(clause, Match):
            out.append(clause)
        elif isinstance(clause, Projection) and not clause.final and all(e == ("var", n) for e, n, _ in clause.items) and clause.limit is None and clause.skip is None:
            if clause.where is not None:
                out.append(Match([], clause.where))
        else:
            break
    if not out or not out[0].paths:
        raise NotRewritable("no leading MATCH")
    return out


def _named(clauses: list) -> tuple[list, list[str]]:
    """Every node and relationship gets a name."""
    names, out = [], []
    for i, clause in enumerate(clauses):
        paths = []
        for j, p in enumerate(clause.paths):
            nodes = [replace(n, var=n.var or f"pn_{i}_{j}_{k}") for k, n in enumerate(p.nodes)]
            rels = [replace(r, var=r.var or f"pr_{i}_{j}_{k}") for k, r in enumerate(p.rels)]
            names += [x.var for x in [*nodes, *rels]]
            paths.append(replace(p, nodes=nodes, rels=rels))
        out.append(replace(clause, paths=paths))
    return out, list(dict.fromkeys(names))


def provenance(catalog: GraphCatalog, text: str) -> DataFrame:
    """(id): the distinct ids of all nodes and relationships that a query's patterns match;
    the branches of a UNION together."""
    frames = []
    for branch in parse(text).branches:
        clauses, names = _named(_matched(branch))
        binder = Binder(catalog)
        state = State(None, {})
        for clause in clauses:
            state = binder.match(clause, state) if clause.paths else binder.filtered(clause.where, state)
        ids = []
        for n in names:
            info = state.scope.get(n)
            if info is not None and info.kind in ("node", "rel"):
                ids.append(F.array(F.when(F.col(f"`{n}__id`").isNotNull(), F.concat_ws(":", f"`{n}__label`", f"`{n}__id`"))))
            elif info is not None and f"{n}__ids" in state.df.columns:
                ids.append(F.col(f"`{n}__ids`"))
        frames.append(state.df.select(F.explode(F.array_compact(F.concat(*ids))).alias("id")))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def returned_node(text: str) -> str | None:
    """The single variable that each returned column is a whole node or property of."""
    final = parse(text).branches[-1][-1]
    if not isinstance(final, Projection) or len(parse(text).branches) > 1:
        return None
    owners = set()
    for e, _, _ in final.items:
        if e[0] == "var":
            owners.add(e[1])
        elif e[0] == "prop" and e[1][0] == "var":
            owners.add(e[1][1])
        else:
            return None
    return owners.pop() if len(owners) == 1 else None


def node_projection(catalog: GraphCatalog, text: str) -> DataFrame:
    """(id): the distinct nodes behind a query's rows. ORDER BY counts only with a limit."""
    var = returned_node(text)
    if var is None:
        raise NotRewritable("the columns don't come from one node")
    query = parse(text)
    final = query.branches[0][-1]
    order = final.order if final.limit is not None or final.skip is not None else []
    items = [(("fn", "elementid", False, [("var", var)]), "id", True)]
    query.branches[0][-1] = replace(final, items=items, order=order, distinct=not order)
    return Binder(catalog).query(query, State(None, {})).df.distinct()


def node_set_verdict(catalog: GraphCatalog, pred: str, gold: str) -> DataFrame:
    """(verdict): whether a prediction, where the gold query returns one whole node, is
    about the same set of nodes. It may only turn a failed comparison into a match."""
    final = parse(gold).branches[0][-1]
    if len(final.items) != 1 or final.items[0][0][0] != "var":
        raise NotRewritable("the gold query doesn't return one whole node")
    a, b = node_projection(catalog, pred).withColumn("d", F.lit(1)), node_projection(catalog, gold).withColumn("d", F.lit(2))
    sides = a.union(b).groupBy("id").agg(F.sum("d").alias("d"))
    return sides.agg((F.coalesce(F.min("d"), F.lit(3)) == 3).alias("verdict"))
