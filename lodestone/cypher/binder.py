"""From parsed queries to DataFrames.

A variable is a set of columns ``var__id``, ``var__label`` and ``var__<property>`` (nodes
and relationships) or one column ``var`` (values). Patterns become equi-joins that start
at what is bound or most selective and grow along relationships; OPTIONAL MATCH, EXISTS,
COUNT and COLLECT become outer, semi, anti and grouped joins on the outer variables'
ids. Catalyst prunes the columns that nothing reads and pushes filters to the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..plans.catalog import EdgeSource, GraphCatalog
from .parser import AGGREGATES, Call, CypherError, Match, NodePattern, Projection, Query, RelPattern, Unwind, has_aggregate, parse, variables, walk


@dataclass
class Var:
    kind: str  # node, rel, value, path
    labels: list[str] = field(default_factory=list)
    props: list[str] = field(default_factory=list)


@dataclass
class State:
    """Rows so far (None: one row without columns), variables, and columns that every
    projection keeps (the outer keys of a subquery)."""

    df: DataFrame | None
    scope: dict[str, Var]
    keys: list[str] = field(default_factory=list)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


class Binder:
    #: Levels after which an unbounded path is given up.
    most_hops = 100
    #: Pairs of path ends above which the work at a node is dealt to several tasks.
    most_pairs = 1_000_000

    def __init__(self, catalog: GraphCatalog, params: dict | None = None):
        self.catalog, self.params, self.fresh = catalog, params or {}, 0

    def new(self, prefix: str) -> str:
        self.fresh += 1
        return f"_{prefix}{self.fresh}"

    def run(self, text: str) -> DataFrame:
        return self.query(parse(text), State(None, {})).df

    # queries
    def query(self, query: Query, start: State) -> State:
        ends = [self.branch(b, start) for b in query.branches]
        if len(ends) == 1:
            return ends[0]
        first = ends[0]
        if any(set(e.scope) != set(first.scope) for e in ends):
            raise CypherError("all branches of a UNION return the same columns")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [e.df for e in ends])
        if not query.all:
            ids = [c for c in df.columns if not any(c.startswith(f"{v}__") and not c.endswith(("__id", "__label")) for v, i in first.scope.items() if i.kind in ("node", "rel"))]
            df = df.dropDuplicates(ids)
        return State(df, first.scope, first.keys)

    def branch(self, clauses: list, state: State) -> State:
        for clause in clauses:
            if isinstance(clause, Match):
                state = self.match(clause, state)
            elif isinstance(clause, Unwind):
                expr = self.value(clause.expr, state)
                df = self.rows(state).withColumn(clause.var, F.explode(expr))
                state = State(df, {**state.scope, clause.var: Var("value")}, state.keys)
            elif isinstance(clause, Call):
                state = self.call(clause, state)
            else:
                state = self.project(clause, state)
        return state

    def rows(self, state: State) -> DataFrame:
        return self.catalog.spark.range(1).select() if state.df is None else state.df

    def call(self, clause: Call, state: State) -> State:
        imports = clause.imports
        if imports is None and isinstance(clause.query.branches[0][0], Projection):
            imports = sorted(variables([i[0] for i in clause.query.branches[0][0].items]) & set(state.scope))
        if not imports:
            inner = self.query(clause.query, State(None, {}))
            df = inner.df if state.df is None else state.df.crossJoin(inner.df)
            return State(df, {**state.scope, **inner.scope}, state.keys)
        start, keys = self.outer_keys(state, imports)
        inner = self.query(clause.query, start)
        new = {v: i for v, i in inner.scope.items() if v not in state.scope}
        cols = [c for c in inner.df.columns if any(c == v or c.startswith(f"{v}__") for v in new)]
        df = self.keyed_join(state.df, inner.df.select(*[col(k) for k in keys], *[col(c) for c in cols]), keys, "inner")
        return State(df, {**state.scope, **new}, state.keys)

    # subqueries
    def id_columns(self, scope: dict[str, Var], names: list[str]) -> list[str]:
        return [c for v in names for c in ([f"{v}__id", f"{v}__label"] if scope[v].kind in ("node", "rel") else [v])]

    def outer_keys(self, state: State, names: list[str]) -> tuple[State, list[str]]:
        """The distinct bindings of outer variables, with copies of their ids that the
        subquery keeps."""
        ids = self.id_columns(state.scope, names)
        keep = [c for c in state.df.columns if any(c == v or c.startswith(f"{v}__") for v in names)]
        keys = {c: f"_k_{c}" for c in ids}
        df = state.df.select(*[col(c) for c in keep]).dropDuplicates(ids)
        df = df.select("*", *[col(c).alias(k) for c, k in keys.items()])
        return State(df, {v: state.scope[v] for v in names}, list(keys.values())), list(keys.values())

    def keyed_join(self, df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
        conditions = [df[f"`{k[3:]}`"].eqNullSafe(other[f"`{k}`"]) for k in keys]
        condition = reduce(lambda a, b: a & b, conditions, F.lit(True))
        return df.join(other, condition, how).drop(*keys) if how not in ("left_semi", "left_anti") else df.join(other, condition, how)

    def subquery(self, inner: Query, state: State) -> tuple[State, list[str]]:
        used = self.names_in(inner)
        shared = [v for v in state.scope if v in used]
        if not shared:
            return self.query(inner, State(None, {})), []
        start, keys = self.outer_keys(state, shared)
        return self.query(inner, start), keys

    def names_in(self, query: Query) -> set[str]:
        out: set[str] = set()
        for clause in (c for b in query.branches for c in b):
            exprs: list = []
            if isinstance(clause, Match):
                exprs.append(clause.where)
                for p in clause.paths:
                    for x in [*p.nodes, *p.rels]:
                        out |= {x.var} if x.var else set()
                        exprs += [x.where, *x.props.values()]
            elif isinstance(clause, Unwind):
                exprs.append(clause.expr)
            elif isinstance(clause, Call):
                out |= self.names_in(clause.query)
            else:
                exprs += [i[0] for i in clause.items] + [o[0] for o in clause.order] + [clause.where]
            for e in exprs:
                out |= variables(e)
                for x in walk(e):
                    if x[0] in ("exists", "count", "collect"):
                        out |= self.names_in(x[1])
        return out

    def resolved(self, expr: tuple, state: State) -> tuple[tuple, State]:
        """Subqueries inside an expression become columns of the rows."""
        if not isinstance(expr, tuple):
            return expr, state
        if expr and expr[0] in ("exists", "count", "collect"):
            name = self.new("sub")
            end, keys = self.subquery(expr[1], state)
            groups = [col(k) for k in keys]
            if expr[0] == "collect":
                item = next(v for v in end.scope)
                agg = F.collect_list(self.variable(item, end)).alias(name)
                default = F.array()
            else:
                agg, default = F.count(F.lit(1)).alias(name), F.lit(0)
            grouped = end.df.groupBy(*groups).agg(agg) if groups else end.df.agg(agg)
            df = self.keyed_join(state.df, grouped, keys, "left") if keys else self.rows(state).crossJoin(grouped)
            df = df.withColumn(name, F.coalesce(col(name), default) if expr[0] != "collect" else F.coalesce(col(name), default.cast(grouped.schema[name].dataType)))
            if expr[0] == "exists":
                df = df.withColumn(name, col(name) > 0)
            return ("var", name), State(df, {**state.scope, name: Var("value")}, state.keys)
        out = []
        for x in expr:
            if isinstance(x, tuple):
                x, state = self.resolved(x, state)
            elif isinstance(x, list):
                items = []
                for y in x:
                    y, state = self.resolved(y, state)
                    items.append(y)
                x = items
            out.append(x)
        return tuple(out), state

    def filtered(self, where: tuple | None, state: State) -> State:
        """Conjuncts one by one; EXISTS and NOT EXISTS by semi and anti joins."""
        if where is None:
            return state
        if where[0] == "bin" and where[1] == "AND":
            return self.filtered(where[3], self.filtered(where[2], state))
        inner, how = (where[1], "left_anti") if where[0] == "not" else (where, "left_semi")
        if inner[0] == "exists" and state.df is not None:
            end, keys = self.subquery(inner[1], state)
            if keys:
                return replace(state, df=self.keyed_join(state.df, end.df.select(*[col(k) for k in keys]), keys, how))
        kept = dict(state.scope)
        expr, state = self.resolved(where, state)
        df = self.rows(state).where(self.value(expr, state))
        return State(df.drop(*[v for v in state.scope if v not in kept]), kept, state.keys)

    # patterns
    def match(self, clause: Match, state: State) -> State:
        names = {x.var for p in clause.paths for x in [*p.nodes, *p.rels] if x.var} | {p.var for p in clause.paths if p.var}
        if not clause.optional:
            return self.patterns(clause, state)
        shared = [v for v in state.scope if v in names or v in self.names_in(Query([[clause]]))]
        if state.df is None:
            raise CypherError("OPTIONAL MATCH needs rows before it")
        if not shared:
            end = self.patterns(clause, State(None, {}))
            return State(state.df.join(end.df, F.lit(True), "left"), {**state.scope, **end.scope}, state.keys)
        start, keys = self.outer_keys(state, shared)
        end = self.patterns(clause, start)
        new = {v: i for v, i in end.scope.items() if v not in state.scope}
        cols = [c for c in end.df.columns if any(c == v or c.startswith(f"{v}__") for v in new)]
        df = self.keyed_join(state.df, end.df.select(*[col(k) for k in keys], *[col(c) for c in cols]), keys, "left")
        return State(df, {**state.scope, **new}, state.keys)

    def patterns(self, clause: Match, state: State) -> State:
        nodes: dict[str, NodePattern] = {}
        steps: list[tuple[str, RelPattern, str]] = []
        paths: list[tuple] = []
        for p in clause.paths:
            line = []
            for n in p.nodes:
                name = n.var or self.new("n")
                if name in nodes:
                    old = nodes[name]
                    nodes[name] = NodePattern(name, old.labels or n.labels, {**old.props, **n.props}, old.where if n.where is None else n.where if old.where is None else ("bin", "AND", old.where, n.where))
                else:
                    nodes[name] = replace(n, var=name)
                line.append(name)
            rels = [replace(r, var=r.var or self.new("r")) for r in p.rels]
            if p.shortest:
                paths.append((p, line, rels[0]))
            else:
                steps += list(zip(line, rels, line[1:]))
                if p.var:
                    paths.append((p, line, rels))
        labels = self.infer(nodes, steps + [(line[0], r, line[1]) for p, line, r in paths if p.shortest], state)
        wanted = self.equalities(clause.where)
        done: set[str] = {n for n in nodes if n in state.scope}
        for n in done:
            state = self.node_filter(nodes[n], state)
        left = list(steps)
        loose = self.loose(nodes, steps, paths, state)
        while left or len(done) + len(loose) < len(nodes):
            ready = [s for s in left if s[0] in done or s[2] in done]
            if not ready:
                # the node with an equality first, then by how many labels it may have
                rest = [n for n in nodes if n not in done and n not in loose]
                n = min(rest, key=lambda n: (not (nodes[n].props or n in wanted), len(labels[n]), rest.index(n)))
                state = self.scan_node(nodes[n], labels[n], state)
                done.add(n)
                continue
            step = next((s for s in ready if s[0] in done and s[2] in done), ready[0])
            left.remove(step)
            a, r, b = step
            if a not in done:
                a, b = b, a
                r = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
            state = self.expand(a, r, b, nodes, labels, state)
            done.add(b)
        state = self.unique(steps, state)
        tests = self.conjuncts(clause.where)
        for p, line, r in paths:
            if not p.shortest:
                state = self.named_path(p.var, line, r, state)
                continue
            # what concerns only the rows so far or only one end is tested before the search
            own = {n: self.scan_node(nodes[n], labels[n], State(None, {})) for n in line if n not in state.scope}
            for t in [t for t in tests if not any(x[0] in ("exists", "count", "collect") for x in walk(t))]:
                n = next((n for n in own if variables(t) == {n}), None)
                if n:
                    own[n] = self.filtered(t, own[n])
                elif variables(t) and variables(t) <= set(state.scope):
                    state = self.filtered(t, state)
                else:
                    continue
                tests.remove(t)
            state = self.shortest(p, line, r, own, state)
        return reduce(lambda s, t: self.filtered(t, s), tests, state)

    def conjuncts(self, where: tuple | None) -> list[tuple]:
        if where is None:
            return []
        return [*self.conjuncts(where[2]), *self.conjuncts(where[3])] if where[0] == "bin" and where[1] == "AND" else [where]

    def loose(self, nodes: dict, steps: list, paths: list, state: State) -> set[str]:
        """Ends of shortest paths that nothing else binds or asks for: their search joins them,
        so not all their pairs are made."""
        uses = {n: set().union(*[variables(e) for e in [*p.props.values(), p.where]]) for n, p in nodes.items()}
        rels = set().union(*[variables(e) for _, r, _ in steps for e in [*r.props.values(), r.where]])
        found = {n for p, line, _ in paths if p.shortest and line[0] != line[1] for n in line}
        bound = {n for a, _, b in steps for n in (a, b)} | set(state.scope) | rels
        return {n for n in found - bound if not uses[n] - {n} and not any(n in u for m, u in uses.items() if m != n)}

    def equalities(self, where: tuple | None) -> set[str]:
        if where is None:
            return set()
        if where[0] == "bin" and where[1] == "AND":
            return self.equalities(where[2]) | self.equalities(where[3])
        if where[0] == "bin" and where[1] in ("=", "IN") and where[2][0] == "prop" and where[2][1][0] == "var":
            return {where[2][1][1]}
        return set()

    def edges_of(self, r: RelPattern) -> list[EdgeSource]:
        known = self.catalog.types()
        for t in r.types:
            if t not in known:
                raise CypherError(f"unknown relationship type {t}")
        return [e for e in self.catalog.edges if not r.types or e.type in r.types]

    def infer(self, nodes: dict, steps: list, state: State) -> dict[str, list[str]]:
        """Labels that each node can have, by the catalog's triples."""
        every = self.catalog.labels()
        labels: dict[str, list[str]] = {}
        for n, p in nodes.items():
            for label in p.labels:
                if label not in every:
                    raise CypherError(f"unknown label {label}")
            bound = state.scope[n].labels if n in state.scope and state.scope[n].kind == "node" else every
            labels[n] = [x for x in bound if not p.labels or x in p.labels]
        for _ in range(len(nodes) + 1):
            for a, r, b in steps:
                if r.hops and r.hops != (1, 1):
                    continue
                fits = [t for t in self.directed(r, labels[a], labels[b])]
                labels[a] = [x for x in labels[a] if any(f == x for f, _, _, _ in fits)]
                labels[b] = [x for x in labels[b] if any(t == x for _, t, _, _ in fits)]
        return labels

    def directed(self, r: RelPattern, near: list[str], far: list[str]) -> list[tuple[str, str, EdgeSource, bool]]:
        """(near label, far label, edges, reversed) that fit."""
        out = []
        for e in self.edges_of(r):
            if r.direction in ("out", "both") and e.source in near and e.target in far:
                out.append((e.source, e.target, e, False))
            if r.direction in ("in", "both") and e.target in near and e.source in far:
                out.append((e.target, e.source, e, True))
        return out

    def node_filter(self, p: NodePattern, state: State) -> State:
        tests = [("bin", "=", ("prop", ("var", p.var), k), v) for k, v in p.props.items()]
        for t in [*tests, *([p.where] if p.where is not None else [])]:
            state = self.filtered(t, state)
        if p.labels and p.var in state.scope and set(state.scope[p.var].labels) - set(p.labels):
            state = replace(state, df=state.df.where(col(f"{p.var}__label").isin(p.labels)))
        return state

    def scan_node(self, p: NodePattern, labels: list[str], state: State) -> State:
        own = State(self.catalog.scan(labels, p.var), {p.var: Var("node", labels, self.catalog.props_of(labels))})
        outer = any(variables(e) - {p.var} for e in [*p.props.values(), p.where])
        if not outer:
            own = self.node_filter(p, own)
        df = own.df if state.df is None else state.df.crossJoin(own.df)
        out = State(df, {**state.scope, **own.scope}, state.keys)
        return self.node_filter(p, out) if outer else out

    def edge_rows(self, r: RelPattern, near: list[str], far: list[str], var: str) -> DataFrame | None:
        frames = []
        fits = self.directed(r, near, far)
        for back in (False, True):
            some = [e for _, _, e, b in fits if b == back]
            if some:
                df = self.catalog.edge_scan(some, var, back)
                if back and r.direction == "both":  # a loop is met once
                    df = df.where((col(f"{var}__near") != col(f"{var}__far")) | (col(f"{var}__nearlabel") != col(f"{var}__farlabel")))
                frames.append(df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def expand(self, a: str, r: RelPattern, b: str, nodes: dict, labels: dict, state: State) -> State:
        if r.hops and r.hops != (1, 1):
            edges = self.walks(a, r, labels, state)
            info = Var("path")
        else:
            edges = self.edge_rows(r, labels[a], labels[b], r.var)
            types = sorted({e.type for _, _, e, _ in self.directed(r, labels[a], labels[b])})
            info = Var("rel", types, self.catalog.edge_props(types))
            if edges is None:
                edges = self.catalog.edge_scan(self.edges_of(r) or self.catalog.edges, r.var).where(F.lit(False))
            own = State(edges, {r.var: info})
            for k, v in r.props.items():
                own = self.filtered(("bin", "=", ("prop", ("var", r.var), k), v), own)
            own = self.filtered(r.where, own)
            edges = own.df
        df = self.rows(state)
        near = df[f"`{a}__id`"] == edges[f"`{r.var}__near`"]
        if len(labels[a]) > 1 or info.kind == "path":
            near &= df[f"`{a}__label`"] == edges[f"`{r.var}__nearlabel`"]
        if b in state.scope:
            both = near & (df[f"`{b}__id`"] == edges[f"`{r.var}__far`"]) & (df[f"`{b}__label`"] == edges[f"`{r.var}__farlabel`"])
            out = State(df.join(edges, both), {**state.scope, r.var: info}, state.keys)
            return out
        df = df.join(edges, near)
        target = self.scan_node(nodes[b], labels[b], State(None, {})) if not any(variables(e) - {b} for e in [*nodes[b].props.values(), nodes[b].where]) else None
        other = target.df if target else self.catalog.scan(labels[b], b)
        far = df[f"`{r.var}__far`"] == other[f"`{b}__id`"]
        if len(labels[b]) > 1 or info.kind == "path":
            far &= df[f"`{r.var}__farlabel`"] == other[f"`{b}__label`"]
        out = State(df.join(other, far), {**state.scope, r.var: info, b: Var("node", labels[b], self.catalog.props_of(labels[b]))}, state.keys)
        return out if target else self.node_filter(nodes[b], out)

    def walks(self, a: str, r: RelPattern, labels: dict, state: State) -> DataFrame:
        """Paths of low to high edges, none used twice, from the nodes bound to ``a``."""
        low, high = r.hops
        every, v = self.catalog.labels(), r.var
        hop = self.edge_rows(replace(r, hops=None), every, every, "_h").select(
            F.concat_ws(":", "_h__label", "_h__id").alias("_h"), "_h__near", "_h__nearlabel", "_h__far", "_h__farlabel"
        )
        start = state.df.select(col(f"{a}__id").alias(f"{v}__near"), col(f"{a}__label").alias(f"{v}__nearlabel")).distinct()
        level = start.select("*", col(f"{v}__near").alias(f"{v}__far"), col(f"{v}__nearlabel").alias(f"{v}__farlabel"), F.array().cast("array<string>").alias(f"{v}__ids"))
        found = [level] if low == 0 else []
        for k in range(1, (self.most_hops if high is None else high) + 1):
            met = level.join(hop, (level[f"`{v}__far`"] == hop["_h__near"]) & (level[f"`{v}__farlabel`"] == hop["_h__nearlabel"]))
            level = met.where(~F.array_contains(f"{v}__ids", F.col("_h"))).select(
                f"{v}__near", f"{v}__nearlabel", F.col("_h__far").alias(f"{v}__far"), F.col("_h__farlabel").alias(f"{v}__farlabel"), F.array_append(f"{v}__ids", F.col("_h")).alias(f"{v}__ids")
            )
            if high is None:
                level = self.cut(level)
                if level.isEmpty():
                    break
            if k >= low:
                found.append(level)
        else:
            if high is None:
                raise CypherError(f"an unbounded path exceeds {self.most_hops} hops")
        return reduce(lambda x, y: x.unionByName(y), found) if found else level.where(F.lit(False))

    def cut(self, df: DataFrame) -> DataFrame:
        from ..sources.shared import checkpointed

        return checkpointed(df)

    def unique(self, steps: list, state: State) -> State:
        """A relationship is met once in a MATCH."""
        tests = []
        single = [r for _, r, _ in steps if state.scope[r.var].kind == "rel"]
        for i, x in enumerate(single):
            for y in single[:i]:
                if x.var != y.var and set(state.scope[x.var].labels) & set(state.scope[y.var].labels):
                    same = col(f"{x.var}__id") == col(f"{y.var}__id")
                    if len(state.scope[x.var].labels) > 1 or len(state.scope[y.var].labels) > 1:
                        same &= col(f"{x.var}__label") == col(f"{y.var}__label")
                    tests.append(~same)
        walks = [r for _, r, _ in steps if state.scope[r.var].kind == "path"]
        for i, w in enumerate(walks):
            tests += [~F.array_contains(f"{w.var}__ids", F.concat_ws(":", f"{s.var}__label", f"{s.var}__id")) for s in single]
            tests += [~F.arrays_overlap(f"{w.var}__ids", f"{u.var}__ids") for u in walks[:i]]
        return replace(state, df=reduce(lambda df, t: df.where(t), tests, state.df))

    def named_path(self, var: str, line: list[str], rels: list, state: State) -> State:
        hops = [F.size(f"{r.var}__ids") if state.scope[r.var].kind == "path" else F.lit(1) for r in rels]
        df = state.df.withColumn(f"{var}__len", reduce(lambda a, b: a + b, hops, F.lit(0)).cast("long"))
        return State(df, {**state.scope, var: Var("path")}, state.keys)

    def shortest(self, p, line: list[str], r: RelPattern, own: dict[str, State], state: State) -> State:
        """Breadth first from the side with fewer distinct nodes: each level joins the last one
        to the edges and drops what was met before. The last edge of a path is joined from the
        other side, so only wanted ends are met; pairs of fewer edges are dropped. Path counts
        are carried along. ``own`` has the ends that aren't among the rows yet."""
        low, high = r.hops or (1, 1)
        every, last = self.catalog.labels(), self.most_hops if high is None else high
        ends = [["_s", "_sl"], ["_t", "_tl"]]
        of = lambda n, end: [col(f"{n}__id").alias(end[0]), col(f"{n}__label").alias(end[1])]
        wanted = None if own else self.cut(state.df.select(*[c for n, end in zip(line, ends) for c in of(n, end)]).distinct())
        sides = [self.cut((wanted.select(*end) if wanted is not None else (own[n] if n in own else state).df.select(*of(n, end))).distinct()) for n, end in zip(line, ends)]
        start, end = ends
        direction = r.direction
        if sides[1].count() < sides[0].count():
            (end, start), sides = ends, sides[::-1]
            direction = {"out": "in", "in": "out", "both": "both"}[direction]
        hop = self.edge_rows(replace(r, hops=None, direction=direction), every, every, "_h").select("_h__near", "_h__nearlabel", "_h__far", "_h__farlabel")
        level = sides[0].select("*", F.col(start[0]).alias("_m"), F.col(start[1]).alias("_ml"), F.lit(1).cast("long").alias("_n"))
        into = sides[1].join(hop, (F.col(end[0]) == F.col("_h__far")) & (F.col(end[1]) == F.col("_h__farlabel")))
        into = self.cut(into.groupBy(*end, F.col("_h__near").alias("_m"), F.col("_h__nearlabel").alias("_ml")).agg(F.count("*").alias("_n")))
        same = level.join(sides[1], (F.col("_m") == F.col(end[0])) & (F.col("_ml") == F.col(end[1])))
        found = [same.where(F.lit(low == 0)).select(*ends[0], *ends[1], "_n", F.lit(0).cast("long").alias("_d"))]
        seen, before = level, None
        for k in range(1, last + 1):
            met = self.meeting(level, into, start)
            if met is not None:
                met = met.where((F.col("_s") != F.col("_t")) | (F.col("_sl") != F.col("_tl")))
                for other, how in ((wanted, "left_semi"), (before, "left_anti")):
                    met = met if other is None else met.join(other, [*ends[0], *ends[1]], how)
                met = met.groupBy(*ends[0], *ends[1]).agg(F.sum("_n").alias("_n")).withColumn("_d", F.lit(k).cast("long"))
                if k < last:
                    met = self.cut(met)
                    before = met if before is None else before.unionByName(met)
                found.append(met)
            if k == last:
                break
            step = level.join(hop, (F.col("_m") == F.col("_h__near")) & (F.col("_ml") == F.col("_h__nearlabel")))
            step = step.groupBy(*start, F.col("_h__far").alias("_m"), F.col("_h__farlabel").alias("_ml")).agg(F.sum("_n").alias("_n"))
            level = self.cut(step.join(seen, [*start, "_m", "_ml"], "left_anti"))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        met = reduce(lambda x, y: x.unionByName(y), found)
        if p.shortest == "all":
            met = met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
        on = lambda n, end: (col(f"{n}__id") == F.col(end[0])) & (col(f"{n}__label") == F.col(end[1]))
        bound = [on(n, end) for n, end in zip(line, ends) if n not in own]
        out = state.df.join(met, reduce(lambda x, y: x & y, bound)) if bound else met
        for n, end in zip(line, ends):
            out = out.join(own[n].df, on(n, end)) if n in own else out
        out = out if bound or state.df is None else state.df.crossJoin(out)
        var = p.var or self.new("p")
        out = out.withColumn(f"{var}__len", F.col("_d")).drop("_s", "_sl", "_t", "_tl", "_n", "_d")
        return State(out, {**state.scope, **{n: s.scope[n] for n, s in own.items()}, var: Var("path")}, state.keys)

    def meeting(self, one: DataFrame, other: DataFrame, start: list[str]) -> DataFrame | None:
        """Rows of both that meet at a node, None if none do. A node where many meet is dealt
        out: rows of the first by their start, to each part of which go all of the second."""
        count = lambda df, name: df.groupBy("_m", "_ml").agg(F.count("*").alias(name))
        both = count(one, "_x").join(count(other, "_y"), ["_m", "_ml"])
        pairs = both.agg(F.sum(F.col("_x") * F.col("_y"))).first()[0]
        if not pairs:
            return None
        other = other.withColumnRenamed("_n", "_o")
        on = ["_m", "_ml"]
        if pairs > self.most_pairs:
            tasks = pairs // self.most_pairs + 1
            parts = both.select("_m", "_ml", F.least("_x", F.ceil(F.col("_x") * F.col("_y") / self.most_pairs)).alias("_w"))
            on = ["_m", "_ml", "_p"]
            one = one.join(parts, ["_m", "_ml"]).withColumn("_p", F.pmod(F.xxhash64(*start), "_w")).drop("_w").repartition(tasks, *on)
            other = other.join(parts, ["_m", "_ml"]).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1))).drop("_w").repartition(tasks, *on)
        return one.join(other, on).select("_s", "_sl", "_t", "_tl", (F.col("_n") * F.col("_o")).alias("_n"))

    # projections
    def project(self, p: Projection, state: State) -> State:
        items = ([(("var", v), v, True) for v in state.scope if not v.startswith("_")] if p.star else []) + p.items
        names = [n for _, n, _ in items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have one name")
        if not p.final and any(not given and e[0] != "var" for e, _, given in items):
            raise CypherError("an expression in WITH needs a name")
        state = State(self.rows(state), state.scope, state.keys)
        exprs = []
        for e, n, _ in items:
            e, state = self.resolved(e, state)
            exprs.append((e, n))
        order = []
        for e, up in p.order:
            e = next((("var", n) for x, n in [(i[0], i[1]) for i in items] if x == e), e)
            order.append((e, up))
        grouped = any(has_aggregate(e) for e, _ in exprs)
        extra = []
        for i, (e, up) in enumerate(order):
            if grouped and has_aggregate(e):  # ordered by an aggregate that is no column
                extra.append(self.new("order"))
                exprs.append((e, extra[-1]))
                order[i] = (("var", extra[-1]), up)
        if grouped:
            state, scope, df = self.aggregated(exprs, state)
        else:
            scope, columns, seen = {}, [col(k) for k in state.keys], set()
            for e, n in exprs:
                scope[n] = self.info(e, state)
                columns += self.item_columns(e, n, state)
            names_out = {n for _, n in exprs}
            hidden = []
            if order and not p.distinct:
                need = set().union(*[variables(e) for e, _ in order]) - names_out
                hidden = [c for c in state.df.columns if any(c == v or c.startswith(f"{v}__") for v in need if v in state.scope)]
            df = state.df.select(*columns, *[col(c) for c in hidden])
            sort_scope = {**{v: state.scope[v] for v in state.scope if any(c == v or c.startswith(f"{v}__") for c in hidden)}, **scope}
        if grouped:
            sort_scope, hidden = dict(scope), extra
            for n in extra:
                del scope[n]
        out = State(df, scope, state.keys)
        if p.distinct:
            ids = state.keys + self.id_columns_any(scope)
            out = replace(out, df=out.df.dropDuplicates(ids))
        if order:
            keys = []
            sortable = State(out.df, sort_scope, state.keys)
            for e, up in order:
                e, sortable = self.resolved(e, sortable)
                c = self.value(e, sortable)
                keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
            out = replace(out, df=sortable.df.orderBy(*keys))
        if p.skip is not None:
            out = replace(out, df=out.df.offset(self.number(p.skip)))
        if p.limit is not None:
            out = replace(out, df=out.df.limit(self.number(p.limit)))
        if hidden:
            out = replace(out, df=out.df.drop(*hidden))
        out = self.filtered(p.where, out)
        return self.returned(out) if p.final and not state.keys else out

    def id_columns_any(self, scope: dict[str, Var]) -> list[str]:
        return [c for v, i in scope.items() for c in ([f"{v}__id", f"{v}__label"] if i.kind in ("node", "rel") else [f"{v}__len"] if i.kind == "path" else [v])]

    def returned(self, state: State) -> State:
        """Nodes and relationships become structs, paths their length."""
        columns = [self.variable(v, state).alias(v) for v in state.scope]
        return State(state.df.select(*columns), {v: Var("value") for v in state.scope}, state.keys)

    def number(self, e: tuple) -> int:
        value = self.params[e[1]] if e[0] == "param" else e[1]
        if not isinstance(value, int) or value < 0:
            raise CypherError("SKIP and LIMIT take a whole number")
        return value

    def info(self, e: tuple, state: State) -> Var:
        return state.scope[e[1]] if e[0] == "var" and e[1] in state.scope else Var("value")

    def item_columns(self, e: tuple, name: str, state: State) -> list[Column]:
        if e[0] == "var" and e[1] in state.scope and state.scope[e[1]].kind != "value":
            v = e[1]
            return [col(c).alias(f"{name}__{c[len(v) + 2:]}") for c in state.df.columns if c.startswith(f"{v}__")]
        return [self.value(e, state).alias(name)]

    def aggregated(self, exprs: list, state: State) -> tuple[State, dict, DataFrame]:
        """Items without an aggregate are the groups; nodes group by id."""
        keys, scope, carried = [col(k) for k in state.keys], {}, []
        aggs: dict[str, Column] = {}

        def lifted(e):
            if isinstance(e, tuple) and e and e[0] == "fn" and e[1] in AGGREGATES:
                name = self.new("agg")
                aggs[name] = self.aggregate(e, state)
                return ("var", name)
            if isinstance(e, tuple):
                return tuple(lifted(x) for x in e)
            return [lifted(x) for x in e] if isinstance(e, list) else e

        late = []
        for e, n in exprs:
            if has_aggregate(e):
                late.append((lifted(e), n))
                continue
            info = self.info(e, state)
            scope[n] = info
            if info.kind in ("node", "rel"):
                for c in state.df.columns:
                    if c.startswith(f"{e[1]}__"):
                        part = c[len(e[1]) + 2 :]
                        (keys if part in ("id", "label") else carried).append(col(c).alias(f"{n}__{part}") if part in ("id", "label") else F.first(col(c)).alias(f"{n}__{part}"))
            else:
                keys += self.item_columns(e, n, state)
        df = state.df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()], *carried)
        inner = State(df, {**scope, **{n: Var("value") for n in aggs}}, state.keys)
        for e, n in late:
            # what a mixed item reads beside its aggregates is one of the groups
            e = self.regrouped(e, exprs)
            df = df.withColumn(n, self.value(e, replace(inner, df=df)))
            scope[n] = Var("value")
        df = df.drop(*aggs)
        return state, {n: scope[n] for _, n in exprs}, df

    def regrouped(self, e, exprs: list):
        for x, n in exprs:
            if e == x and not has_aggregate(x):
                return ("var", n)
        if isinstance(e, tuple):
            return tuple(self.regrouped(x, exprs) if isinstance(x, (tuple, list)) else x for x in e)
        return [self.regrouped(x, exprs) for x in e] if isinstance(e, list) else e

    def aggregate(self, e: tuple, state: State) -> Column:
        _, name, distinct, args = e
        if name == "count" and args[0][0] == "star":
            return F.count(F.lit(1))
        arg = args[0]
        node = arg[0] == "var" and arg[1] in state.scope and state.scope[arg[1]].kind in ("node", "rel")
        if node and name == "count":
            v = arg[1]
            ids = [col(f"{v}__id")] + ([col(f"{v}__label")] if len(state.scope[v].labels) > 1 else [])
            return F.count_distinct(*ids) if distinct else F.count(ids[0])
        x = self.value(arg, state)
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "sum":
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
        if name == "avg":
            return F.avg(F.when(x.isNotNull(), x)) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
        if name == "collect":
            return F.collect_set(x) if distinct else F.collect_list(x)
        return {"min": F.min, "max": F.max, "stdev": F.stddev_samp}.get(name, F.max)(x) if name != "percentilecont" else F.percentile(x, self.value(args[1], state))

    # expressions
    def variable(self, name: str, state: State) -> Column:
        info = state.scope.get(name)
        if info is None:
            raise CypherError(f"{name} is not bound here")
        if info.kind == "path":
            return col(f"{name}__len") if f"{name}__len" in state.df.columns else F.size(f"{name}__ids").cast("long")
        if info.kind == "value":
            return col(name)
        have = set(state.df.columns)
        props = [col(f"{name}__{p}").alias(p) for p in info.props if f"{name}__{p}" in have]
        return F.when(col(f"{name}__id").isNotNull(), F.struct(col(f"{name}__label").alias("_label"), col(f"{name}__id").alias("_id"), *props))

    def property(self, owner: tuple, name: str, state: State) -> Column:
        if owner[0] == "var" and owner[1] in state.scope and state.scope[owner[1]].kind in ("node", "rel"):
            c = f"{owner[1]}__{name}"
            return col(c) if c in state.df.columns and name in state.scope[owner[1]].props else F.lit(None)
        x = self.value(owner, state)
        kind = self.kind_of(owner, state)
        if isinstance(kind, T.StructType):
            return x[name] if name in kind.names else F.lit(None)
        return scalar.component(x, kind, name)

    def type_of(self, x: Column, state: State) -> T.DataType:
        return self.rows(state).select(x.alias("x")).schema["x"].dataType

    def kind_of(self, e: tuple, state: State) -> T.DataType:
        return self.type_of(self.value(e, state), state)

    def value(self, e: tuple, state: State) -> Column:
        kind = e[0]
        v = lambda x: self.value(x, state)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise CypherError(f"no value for ${e[1]}")
            return scalar.literal(self.params[e[1]])
        if kind == "var":
            return self.variable(e[1], state)
        if kind == "prop":
            return self.property(e[1], e[2], state)
        if kind == "haslabel":
            return col(f"{e[1][1]}__label") == e[2]
        if kind == "not":
            return ~v(e[1])
        if kind == "neg":
            return -v(e[1])
        if kind == "isnull":
            owner = e[1]
            if owner[0] == "var" and owner[1] in state.scope and state.scope[owner[1]].kind in ("node", "rel"):
                x = col(f"{owner[1]}__id")
            else:
                x = v(owner)
            return x.isNotNull() if e[2] else x.isNull()
        if kind == "bin":
            return self.binary(e, state)
        if kind == "list":
            return F.array(*[v(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[v(x).alias(k) for k, x in e[1].items()])
        if kind == "index":
            if e[1][0] == "var" and e[1][1] in state.scope and state.scope[e[1][1]].kind in ("node", "rel"):
                return self.dynamic(e[1][1], v(e[2]), state)
            return scalar.item(v(e[1]), v(e[2]))
        if kind == "slice":
            return scalar.sliced(v(e[1]), v(e[2]) if e[2] else None, v(e[3]) if e[3] else None)
        if kind == "comp":
            return self.comprehension(e, state)
        if kind == "case":
            out = F
            for condition, result in e[2]:
                test = v(condition) if e[1] is None else v(e[1]) == v(condition)
                out = out.when(test, v(result))
            return out.otherwise(v(e[3])) if e[3] is not None else out
        if kind == "fn":
            return self.function(e, state)
        raise CypherError(f"{kind} is not possible here")

    def dynamic(self, name: str, key: Column, state: State) -> Column:
        """A property by a computed name: a string, as types may differ."""
        out = F
        for p in state.scope[name].props:
            c = f"{name}__{p}"
            if c in state.df.columns:
                text = F.array_join(col(c), ",") if isinstance(state.df.schema[c].dataType, T.ArrayType) else col(c).cast("string")
                out = out.when(key == p, text)
        return out if out is not F else F.lit(None).cast("string")

    def comprehension(self, e: tuple, state: State) -> Column:
        _, var, source, where, out = e
        x = self.value(source, state)
        holder: dict[str, Column] = {}
        outer = self

        class Inner(Binder):
            def variable(self, name: str, state: State) -> Column:
                return holder[name] if name in holder else outer.variable(name, state)

            def kind_of(self, e: tuple, state: State) -> T.DataType:
                kept = dict(holder)
                holder[var] = F.get(x, F.lit(0))  # an item outside the function has the type
                try:
                    return outer.type_of(self.value(e, state), state)
                finally:
                    holder.update(kept)

        inner = Inner(self.catalog, self.params)
        scope = replace(state, scope={k: i for k, i in state.scope.items() if k != var})

        def at(c: Column, expr: tuple) -> Column:
            holder[var] = c
            return inner.value(expr, scope)

        kept = x if where is None else F.filter(x, lambda c: at(c, where))
        return F.transform(kept, lambda c: at(c, out)) if out is not None else kept

    def binary(self, e: tuple, state: State) -> Column:
        _, op, a, b = e
        ids = [x[1] if x[0] == "var" and x[1] in state.scope and state.scope[x[1]].kind in ("node", "rel") else None for x in (a, b)]
        if all(ids) and op in ("=", "<>"):
            same = (col(f"{ids[0]}__id") == col(f"{ids[1]}__id")) & (col(f"{ids[0]}__label") == col(f"{ids[1]}__label"))
            return same if op == "=" else ~same
        x, y = self.value(a, state), self.value(b, state)
        if op in ("AND", "OR"):
            return x & y if op == "AND" else x | y
        if op == "XOR":
            return x != y
        if op == "=":
            return x == y
        if op == "<>":
            return x != y
        if op in ("<", "<=", ">", ">="):
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op == "IN":
            if b[0] == "list":
                if not b[1]:
                    return F.lit(False)
                if all(i[0] == "lit" for i in b[1]):
                    return x.isin(*[i[1] for i in b[1]])
            return F.array_contains(y, x)
        if op == "CONTAINS":
            return x.contains(y)
        if op == "STARTS":
            return x.startswith(y)
        if op == "ENDS":
            return x.endswith(y)
        if op == "=~":
            if b[0] not in ("lit", "param"):
                raise CypherError("=~ takes a literal pattern")
            pattern = b[1] if b[0] == "lit" else self.params[b[1]]
            return x.rlike(f"^(?:{pattern})$")
        return scalar.arithmetic(op, x, y, self.kind_of(a, state), self.kind_of(b, state))

    def function(self, e: tuple, state: State) -> Column:
        _, name, _, args = e
        if name in AGGREGATES:
            raise CypherError(f"{name} is not possible here")
        if args and args[0][0] == "var" and args[0][1] in state.scope and state.scope[args[0][1]].kind != "value":
            v, info = args[0][1], state.scope[args[0][1]]
            if name == "labels":
                return F.array(col(f"{v}__label"))
            if name == "type":
                return col(f"{v}__label")
            if name == "id":
                return col(f"{v}__id")
            if name == "elementid":
                return F.concat_ws(":", col(f"{v}__label"), col(f"{v}__id"))
            if name == "length" and info.kind == "path":
                return self.variable(v, state)
            if name == "size" and info.kind == "path":
                return self.variable(v, state)
            if name == "keys":
                have = [p for p in info.props if f"{v}__{p}" in state.df.columns]
                return F.array_compact(F.array(*[F.when(col(f"{v}__{p}").isNotNull(), F.lit(p)) for p in have]))
            if name == "properties":
                return self.variable(v, state).dropFields("_label", "_id")
        values = [self.value(a, state) for a in args]
        return scalar.call(name, values, [self.kind_of(a, state) for a in args])


def run(catalog: GraphCatalog, text: str, params: dict | None = None) -> DataFrame:
    """The rows of a query, as a DataFrame that nothing has computed yet."""
    return Binder(catalog, params).run(text)
