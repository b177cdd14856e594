"""The graph language: parsing, refusals, semantics on a tiny graph."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.cypher.binder import Binder, run
from lodestone.cypher.parser import CypherError, WriteRefused, parse
from lodestone.cypher.rewrite import NotRewritable, node_projection, node_set_verdict, provenance
from lodestone.operators.grounding import literals
from lodestone.plans.catalog import EdgeSource, GraphCatalog, NodeSource


@pytest.fixture(scope="module")
def graph(spark):
    c = F.col
    people = spark.createDataFrame([(1, "Ann", 30, ["x", "y"]), (2, "Bob", None, []), (3, "Cy", 20, None), (4, "Di", 40, ["y"])], "id int, name string, age int, tags array<string>")
    cities = spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "id int, name string")
    knows = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 4, 4), (5, 1, 2)], "eid int, a int, b int")
    lives = spark.createDataFrame([(1, 1, 1, 2001), (2, 2, 1, None), (3, 3, 2, 2003)], "eid int, a int, b int, since int")
    return GraphCatalog(
        spark,
        [NodeSource("Person", people, "id", {"name": c("name"), "age": c("age"), "tags": c("tags")}), NodeSource("City", cities, "id", {"name": c("name")})],
        [EdgeSource("KNOWS", "Person", "Person", knows, c("a"), c("b"), c("eid")), EdgeSource("LIVES", "Person", "City", lives, c("a"), c("b"), c("eid"), {"since": c("since")})],
    )


def rows(graph, text, **params):
    return [tuple(r) for r in run(graph, text, params).collect()]


@pytest.mark.parametrize("text", ["CREATE (n) RETURN n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) DETACH DELETE n", "MERGE (n:A) RETURN n", "MATCH (n) REMOVE n.x RETURN n"])
def test_writes_are_refused(text):
    with pytest.raises(WriteRefused):
        parse(text)


@pytest.mark.parametrize("text", ["", "MATCH (n RETURN n", "RETURN", "MATCH (n)-[:X]->(m RETURN n", "MATCH (n) RETURN n UNION RETURN 1 AS n UNION ALL RETURN 2 AS n", "MATCH (n) WHERE RETURN n", "RETURN 'open"])
def test_malformed_queries(text):
    with pytest.raises(CypherError):
        parse(text)


def test_unknown_names(graph):
    for text in ("MATCH (n:Ship) RETURN n", "MATCH ()-[:OWNS]->() RETURN 1 AS x", "MATCH (n:Person) RETURN m.name", "MATCH (n:Person) WITH n.name AS a RETURN n.age", "RETURN nosuch(1) AS x", "RETURN $x AS x"):
        with pytest.raises(CypherError):
            run(graph, text).collect()
    assert rows(graph, "MATCH (n:City) RETURN n.height AS h") == [(None,), (None,)]


def test_bags_loops_and_uniqueness(graph):
    assert rows(graph, "MATCH (a:Person)-[:KNOWS]->(b) RETURN count(*) AS n") == [(5,)]
    assert rows(graph, "MATCH (a:Person)-[:KNOWS]-(b) RETURN count(*) AS n") == [(9,)]  # the loop once
    assert rows(graph, "MATCH (a {name:'Ann'})-[:KNOWS]->(b)<-[:KNOWS]-(c) RETURN count(*) AS n") == [(2,)]  # the two parallel edges, either way
    assert rows(graph, "MATCH (a {name:'Ann'})-[r]->(b) RETURN count(DISTINCT b) AS n, count(b) AS m") == [(2, 3)]


def test_variable_length_and_shortest(graph):
    assert rows(graph, "MATCH (a:Person {name:'Ann'})-[:KNOWS*0..0]->(b) RETURN b.name AS n") == [("Ann",)]
    assert rows(graph, "MATCH (a:Person {name:'Ann'})-[:KNOWS*]->(b) RETURN count(*) AS n") == [(8,)]
    assert rows(graph, "MATCH (a:Person {name:'Bob'}), (b:Person {name:'Ann'}), p = shortestPath((a)-[:KNOWS*..5]->(b)) RETURN length(p) AS d") == [(2,)]
    assert rows(graph, "MATCH (a:Person {name:'Ann'}), (b:Person {name:'Cy'}), p = allShortestPaths((a)-[:KNOWS*..5]->(b)) RETURN length(p) AS d") == [(2,), (2,)]
    assert rows(graph, "MATCH (a:Person {name:'Di'}), (b:Person {name:'Ann'}), p = shortestPath((a)-[:KNOWS*]->(b)) RETURN length(p) AS d") == []


def plain_paths(edges, starts, ends, direction, high):
    """(start, end) -> (length, number) of the shortest paths, breadth first from each start."""
    out = {}
    for s in starts:
        seen, level, d = {s: (0, 1)}, {s: 1}, 0
        while level and (high is None or d < high):
            d, step = d + 1, {}
            for x, y in edges:
                ways = {(x, y)} if direction == "->" else {(y, x)} if direction == "<-" else {(x, y), (y, x)}
                for near, far in ways:
                    if near in level and far not in seen:
                        step[far] = step.get(far, 0) + level[near]
            seen |= {x: (d, n) for x, n in step.items()}
            level = step
        out |= {(s, t): seen[t] for t in ends if t in seen}
    return out


def test_shortest_paths_against_plain(spark, monkeypatch):
    monkeypatch.setattr(Binder, "most_pairs", 2)  # so that work at a node is dealt out
    dice = random.Random(7)
    edges = [(dice.randrange(14), dice.randrange(14)) for _ in range(20)] + [(1, 2), (1, 2), (3, 3)]
    c = F.col
    knows = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "eid int, a int, b int")
    g = GraphCatalog(spark, [NodeSource("P", spark.createDataFrame([(i, i) for i in range(14)], "id int, k int"), "id", {"k": c("k")})], [EdgeSource("R", "P", "P", knows, c("a"), c("b"), c("eid"))])
    for match, few, many, direction, arrow, low, high in (
        ("MATCH (a:P), (b:P),", "a", "b", "->", "-[:R*..3]->", 1, 3), ("MATCH (a:P) WITH a MATCH", "b", "a", "<-", "<-[:R*]-", 1, None),
        ("MATCH (b:P) WITH b MATCH", "a", "b", "-", "-[:R*0..2]-", 0, 2), ("MATCH (a:P), (b:P) WITH a, b MATCH", "b", "a", "->", "-[:R*..4]->", 1, 4),
    ):
        starts, stops = ([0, 1, 2, 3], range(1, 14)) if few == "a" else (range(1, 14), [0, 1, 2, 3])
        plain = {k: v for k, v in plain_paths(edges, starts, stops, direction, high).items() if low == 0 or v[0]}
        got = rows(g, f"{match} p = allShortestPaths((a){arrow}(b)) WHERE {few}.k < 4 AND 1 <= {many}.k RETURN a.k AS a, b.k AS b, length(p) AS d, count(*) AS n")
        assert {(a, b): (d, n) for a, b, d, n in got} == plain and len(got) == len(plain) > 4
    got = rows(g, "MATCH (x:P {k: 5}), p = shortestPath((a:P {k: 1})-[:R]->(b:P)) WHERE a.k < b.k RETURN x.k AS x, b.k AS b, length(p) AS d")
    assert sorted(got) == sorted({(5, y, 1) for x, y in edges if x == 1 < y})


def test_shortest_paths_of_few_through_a_hub(spark):
    """Levels hold what the wanted ends reach, not all that meet at a hub."""
    c, sizes = F.col, []

    class Counted(Binder):
        def cut(self, df):
            df = super().cut(df)
            sizes.append(df.count())
            return df

    spokes = spark.range(500).select("id", (F.col("id") % 100).alias("k"))
    g = GraphCatalog(spark, [NodeSource("S", spokes, "id", {"k": c("k")}), NodeSource("H", spark.range(1), "id", {})], [EdgeSource("R", "S", "H", spokes, c("id"), F.lit(0), c("id"))])
    got = Counted(g).run("MATCH (a:S), (b:S), p = allShortestPaths((a)-[:R*..2]-(b)) WHERE a.k = 3 AND b.k = 4 RETURN length(p) AS d").collect()
    assert [r.d for r in got] == [2] * 25 and max(sizes) <= 25


def test_optional_and_nulls(graph):
    got = rows(graph, "MATCH (p:Person) OPTIONAL MATCH (p)-[l:LIVES]->(c:City) WHERE l.since > 2000 RETURN p.name AS p, c.name AS c ORDER BY p")
    assert got == [("Ann", "Rome"), ("Bob", None), ("Cy", "Oslo"), ("Di", None)]
    assert rows(graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a") == [(20,), (30,), (40,), (None,)]
    assert rows(graph, "MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC LIMIT 1") == [(None,)]
    assert rows(graph, "MATCH (p:Person) RETURN sum(p.age) AS s, count(p.age) AS c, count(*) AS n, size(collect(p.age)) AS k") == [(90, 3, 4, 3)]
    assert rows(graph, "MATCH (p:Person) WHERE p.age > 100 RETURN sum(p.age) AS s, max(p.age) AS m") == [(0, None)]
    assert rows(graph, "MATCH (p:Person) UNWIND p.tags AS t RETURN t, count(*) AS n ORDER BY t") == [("x", 1), ("y", 2)]


def test_subqueries(graph):
    assert rows(graph, "MATCH (p:Person) WHERE NOT (p)-[:LIVES]->() RETURN p.name AS n") == [("Di",)]
    assert rows(graph, "MATCH (c:City) RETURN c.name AS c, COUNT { (c)<-[:LIVES]-(:Person) } AS n ORDER BY c") == [("Oslo", 1), ("Rome", 2)]
    assert rows(graph, "MATCH (p:Person) WHERE EXISTS { (p)-[:LIVES]->(c) WHERE EXISTS { (c)<-[:LIVES]-(q) WHERE q.name = 'Bob' } } RETURN p.name AS n ORDER BY n") == [("Ann",), ("Bob",)]
    assert rows(graph, "MATCH (c:City) CALL { WITH c MATCH (c)<-[:LIVES]-(p) RETURN max(p.name) AS m } RETURN c.name AS c, m ORDER BY c") == [("Oslo", "Cy"), ("Rome", "Bob")]


def test_expressions(graph):
    got = rows(graph, "RETURN 7 / 2 AS a, 7.0 / 2 AS b, 1 / 0 AS c, 7 % 4 AS d, 2 ^ 3 AS e, 'a' + 1 AS f, [1] + [2] AS g, [1, 2, 3][-1] AS h, [1, 2, 3][0..2] AS i, 1 < 2 < 3 AS j, NOT true OR true AS k, null = null AS l")
    assert got == [(3, 3.5, None, 3, 8.0, "a1", [1, 2], 3, [1, 2], True, True, None)]
    assert rows(graph, "RETURN toInteger('3.9') AS a, toInteger('x') AS b, 'abc' =~ 'b' AS c, 'abc' =~ '.b.' AS d, size([]) AS e, duration('PT1H1M').seconds AS f, [x IN [1, 2, 3] WHERE x > 1 | x * x] AS g") == [(3, None, False, True, 0, 3660, [4, 9])]
    assert rows(graph, "RETURN 'it\\'s' AS a, \"q\\\"\" AS b") == [("it's", 'q"')]
    assert rows(graph, "MATCH (p:Person) WHERE p.name IN $names RETURN p.name AS n ORDER BY n SKIP 1 LIMIT $k", names=["Ann", "Cy", "Di"], k=1) == [("Cy",)]
    one = run(graph, "MATCH (c:City {name:'Rome'}) RETURN c").first()
    assert one.c.asDict() == {"_label": "City", "_id": 1, "name": "Rome"}


def test_plans_push_filters_and_prune(spark, tmp_path, graph):
    path = str(tmp_path / "people")
    graph.nodes["Person"].frame.write.parquet(path)
    stored = GraphCatalog(spark, [NodeSource("Person", spark.read.parquet(path), "id", {"name": F.col("name"), "age": F.col("age")})], [])
    plan = run(stored, "MATCH (p:Person) WHERE p.age > 25 RETURN p.age AS a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,25)" in plan and "name" not in plan.split("ReadSchema")[1]


def test_rewrites(graph):
    ids = {r.id for r in provenance(graph, "MATCH (p:Person)-[:LIVES]->(c:City {name:'Rome'}) WITH p WHERE p.age > 1 RETURN count(p) AS n").collect()}
    assert ids == {"Person:1", "LIVES:1", "City:1"}
    with pytest.raises(NotRewritable):
        provenance(graph, "UNWIND [1] AS x RETURN x")
    assert {r.id for r in node_projection(graph, "MATCH (p:Person)-[:LIVES]->(c) RETURN c.name").collect()} == {"City:1", "City:2"}
    gold = "MATCH (p:Person)-[:LIVES]->(c:City) RETURN c"
    assert node_set_verdict(graph, "MATCH (c:City) RETURN c.name", gold).first().verdict
    assert not node_set_verdict(graph, "MATCH (c:City {name:'Oslo'}) RETURN c.name", gold).first().verdict
    with pytest.raises(NotRewritable):
        node_set_verdict(graph, "MATCH (c:City) RETURN c.name", "MATCH (c:City) RETURN c.name")


def test_literals():
    text = "MATCH (p:Person {name:'Ann'})-[:LIVES]->(c:City) WHERE toLower(c.name) = 'rome' AND p.age > 3 AND p.name =~ 'A.*' RETURN p"
    assert literals(text) == [("Person", "name", "Ann"), ("City", "name", "rome")]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "id int, name string")
    g = GraphCatalog(spark, [NodeSource("A", none, "id", {"name": F.col("name")})], [EdgeSource("R", "A", "A", spark.createDataFrame([], "a int, b int"), F.col("a"), F.col("b"), F.xxhash64("a", "b"))])
    assert rows(g, "MATCH (a:A)-[:R]->(b) RETURN count(*) AS n") == [(0,)] and rows(g, "MATCH (a) RETURN a.name AS n") == []
    assert Binder(g).catalog.triples() == [("A", "R", "A")]
