"""Registered queries: values, retrieval, fusion, grounding and catalog profiles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grounding as G
from ..operators import profile as P
from ..operators import retrieval as R
from .catalog import tables, trade_graph
from .registry import query

# The same mentions in both engines: part names with their second and third letters swapped.
MENTIONS_SQL = """mentions AS (SELECT DISTINCT p_name AS qid, substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) AS phrase FROM part),
vals AS (SELECT DISTINCT p_name AS value FROM part)"""


def part_values(spark: SparkSession, sf: str) -> DataFrame:
    part = tables(spark, sf)("part")
    return R.property_values(part, "Part", {"name": F.col("p_name")})


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    phrase = F.concat(F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), F.substring(n, F.lit(4), F.length(n)))
    return tables(spark, sf)("part").select(n.alias("qid"), phrase.alias("phrase"), F.lit("Part").alias("label"), F.lit("name").alias("prop")).distinct()


BM25_SQL = f"""WITH {MENTIONS_SQL},
tok AS (SELECT value, unnest(regexp_extract_all(lower(value), '\\w+')) AS token, len(regexp_extract_all(lower(value), '\\w+')) AS dl FROM vals),
post AS (SELECT value, token, dl, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(len(regexp_extract_all(lower(value), '\\w+'))) AS avgdl FROM vals),
q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(phrase), '\\w+')) AS q FROM mentions),
hit AS (SELECT DISTINCT qid, token FROM q JOIN df ON levenshtein(q, token) <= 1),
bm AS (SELECT qid, value, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM hit JOIN post USING (token) JOIN df USING (token), st GROUP BY 1, 2),
bmr AS (SELECT qid, value, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM bm WHERE score >= 0.1)"""
LEV_SQL = """lev AS (SELECT qid, value, round(1 - levenshtein(lower(trim(phrase)), lower(trim(value))) / greatest(length(phrase), length(value)), 9) AS score FROM mentions, vals),
levr AS (SELECT qid, value, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM lev)"""
TWO = BM25_SQL + ",\n" + LEV_SQL


def fuzzy(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return R.fuzzy_topk(part_values(spark, sf), mentions(spark, sf), k)


def lev(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return R.lev_topk(part_values(spark, sf), mentions(spark, sf), k)


@query("distinct_values", "SELECT DISTINCT 'Part' AS label, 'brand' AS prop, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'Part', 'words', unnest(string_split(p_name, ' ')) FROM part")
def distinct_values(spark, sf):
    return R.property_values(tables(spark, sf)("part"), "Part", {"brand": F.col("p_brand"), "words": F.split("p_name", " ")})


@query("value_contexts", "SELECT 'Nation' AS label, 'name' AS prop, n_name AS value FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'Region', 'name', r_name FROM region WHERE r_name = 'ASIA'")
def value_contexts(spark, sf):
    t = tables(spark, sf)
    values = R.property_values(t("nation"), "Nation", {"name": F.col("n_name")}).union(R.property_values(t("region"), "Region", {"name": F.col("r_name")}))
    return R.contexts_of(values, spark.createDataFrame([("nation_3",), (" Asia",), ("nowhere",)], "value string"))


@query("unembedded_values", "SELECT 'Part' AS label, 'name' AS prop, p_name AS value FROM part WHERE p_size > 5 GROUP BY p_name HAVING p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 2)")
def unembedded_values(spark, sf):
    part = tables(spark, sf)("part")
    done = R.property_values(part.where("p_size <= 2"), "Part", {"name": F.col("p_name")})
    return R.missing_embeddings(R.property_values(part.where("p_size > 5"), "Part", {"name": F.col("p_name")}), done)


query("bm25_topk", BM25_SQL + " SELECT * FROM bmr WHERE rank <= 10")(fuzzy)
query("lev_topk", f"WITH {MENTIONS_SQL}, {LEV_SQL} SELECT * FROM levr WHERE rank <= 10")(lev)

RERANK_SQL = BM25_SQL + """, pool AS (SELECT * FROM bmr WHERE rank <= 20),
w AS (SELECT p.*, m.phrase, regexp_extract_all(lower(m.phrase), '\\w+') AS pt, regexp_extract_all(lower(p.value), '\\w+') AS vt FROM pool p JOIN mentions m USING (qid)),
f AS (SELECT qid, value, rank AS old, round(score * CASE WHEN lower(phrase) = lower(value) THEN 2.0 WHEN contains(lower(value), lower(phrase)) OR contains(lower(phrase), lower(value)) THEN 1.5 ELSE 1.0 END
 * (1 + 0.4 * len(list_intersect(list_distinct(pt), list_distinct(vt))) / len(list_distinct(pt)))
 / (1 + 0.05 * len(list_filter(list_distinct(vt), lambda x: NOT list_contains(pt, x)))), 9) AS score FROM w),
g AS (SELECT qid, value, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS INTEGER) AS rank FROM f)
SELECT * FROM g WHERE rank <= 10"""


@query("fuzzy_search", RERANK_SQL)
def fuzzy_search(spark, sf):
    return R.search(part_values(spark, sf), mentions(spark, sf), 10)


@query("rel_search", """WITH v AS (SELECT DISTINCT l_returnflag AS value FROM lineitem), q AS (SELECT 'R' AS phrase)
SELECT phrase AS qid, value, round(ln(1 + (n - 1 + 0.5) / 1.5) * 2.2 / 2.2, 9) AS score, CAST(1 AS INTEGER) AS rank FROM v, q, (SELECT count(*) AS n FROM v) WHERE lower(value) = lower(phrase)""")
def rel_search(spark, sf):
    """Relationship properties: no re-ranking."""
    values = R.property_values(tables(spark, sf)("lineitem"), "CONTAINS", {"returnflag": F.col("l_returnflag")})
    asked = spark.createDataFrame([("R", "R", "CONTAINS", "returnflag")], "qid string, phrase string, label string, prop string")
    return R.fuzzy_topk(values, asked, 10, fuzziness=0)


@query("cosine_topk", """WITH s AS (SELECT q.vec_id AS qid, CAST(r.vec_id AS VARCHAR) AS value, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score
FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM s) SELECT * FROM t WHERE rank <= 10""")
def cosine_topk(spark, sf):
    e = tables(spark, sf)("embeddings")
    return R.vector_topk(e.select(F.col("vec_id").cast("string").alias("value"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)


@query("cascade_fusion", TWO + """, u AS (SELECT qid, value, min((0, rank)) AS pl FROM (SELECT * FROM bmr WHERE rank <= 10) GROUP BY 1, 2 UNION ALL SELECT qid, value, min((1, rank)) FROM (SELECT * FROM levr WHERE rank <= 10) GROUP BY 1, 2),
b AS (SELECT qid, value, min(pl) AS pl FROM u GROUP BY 1, 2), r AS (SELECT qid, value, CAST(row_number() OVER (PARTITION BY qid ORDER BY pl, value) AS INTEGER) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM b)
SELECT qid, value, CAST(n - rank + 1 AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def cascade_fusion(spark, sf):
    return R.cascade(fuzzy(spark, sf), lev(spark, sf), 10)


@query("rrf_fusion", TWO + """, u AS (SELECT qid, value, rank FROM bmr WHERE rank <= 20 UNION ALL SELECT qid, value, rank FROM levr WHERE rank <= 20),
s AS (SELECT qid, value, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""")
def rrf_fusion(spark, sf):
    return R.fused(fuzzy(spark, sf, 20), lev(spark, sf, 20), "rrf", 10)


@query("weighted_fusion", TWO + """, a AS (SELECT qid, value, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS a FROM (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM bmr WHERE rank <= 20 WINDOW w AS (PARTITION BY qid))),
b AS (SELECT qid, value, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS b FROM (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM levr WHERE rank <= 20 WINDOW w AS (PARTITION BY qid))),
s AS (SELECT qid, value, round(0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0), 9) AS score FROM a FULL JOIN b USING (qid, value)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def weighted_fusion(spark, sf):
    return R.fused(fuzzy(spark, sf, 20), lev(spark, sf, 20), "weighted", 10)


@query("three_arm_union", TWO + """, u AS (SELECT qid, value, (0, rank) AS pl FROM bmr WHERE rank <= 5 UNION ALL SELECT qid, value, (1, rank) FROM levr WHERE rank <= 5 UNION ALL SELECT qid, qid, (2, 1) FROM mentions),
b AS (SELECT qid, value, min(pl) AS pl FROM u GROUP BY 1, 2) SELECT qid, value, CAST(row_number() OVER (PARTITION BY qid ORDER BY pl, value) AS INTEGER) AS rank FROM b""")
def three_arm_union(spark, sf):
    third = mentions(spark, sf).select("qid", F.col("qid").alias("value"), F.lit(1).alias("rank"))
    return R.union_in_order(fuzzy(spark, sf, 5), lev(spark, sf, 5), third)


@query("escalation", RERANK_SQL.replace("SELECT * FROM g WHERE rank <= 10", "SELECT * FROM g WHERE rank BETWEEN 6 AND 10"))
def escalation(spark, sf):
    values, asked = part_values(spark, sf), mentions(spark, sf)
    return R.deepened(values, asked, R.search(values, asked, 5), 5, 0)


@query("closest_value", f"""WITH {MENTIONS_SQL}, l AS (SELECT qid, value, lower(phrase) AS a, lower(value) AS b FROM mentions, vals), j AS (SELECT *, jaro_similarity(a, b) AS j, CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1] = b[1] THEN 1 ELSE 0 END AS p FROM l),
s AS (SELECT qid, value, round(j + p * 0.1 * (1 - j), 6) AS score FROM j) SELECT *, 1 AS rank FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) = 1""")
def closest_value(spark, sf):
    return R.closest_value(part_values(spark, sf), mentions(spark, sf))


@query("value_exists", f"WITH {MENTIONS_SQL} SELECT qid, phrase, qid IN (SELECT value FROM vals) AS gold_exists, phrase IN (SELECT value FROM vals) AS exists FROM mentions")
def value_exists(spark, sf):
    m, v = mentions(spark, sf), part_values(spark, sf)
    mark = lambda c, n: G.existing(m.select("label", "prop", F.col(c).alias("value")), v).select(F.col("value").alias(c), F.lit(True).alias(n)).distinct()
    rows = m.join(mark("qid", "gold_exists"), "qid", "left").join(mark("phrase", "exists"), "phrase", "left")
    return rows.select("qid", "phrase", F.coalesce("gold_exists", F.lit(False)).alias("gold_exists"), F.coalesce("exists", F.lit(False)).alias("exists"))


@query("cheap_grounded", f"WITH {MENTIONS_SQL} SELECT qid, contains(regexp_replace(lower(qid), '\\W+', '', 'g'), regexp_replace(lower(substr(qid, 1, 4)), '\\W+', '', 'g')) AS grounded FROM mentions")
def cheap_grounded(spark, sf):
    return mentions(spark, sf).select("qid", G.grounded(F.substring("qid", 1, 4), F.array("qid")).alias("grounded"))


@query("validate_components", """SELECT * FROM (VALUES (1, 'label', NULL), (2, 'label', 'unknown label'), (3, 'edge', NULL), (4, 'edge', 'no such edge'), (5, 'edge', NULL), (6, 'value', NULL), (7, 'value', 'no such value'), (8, 'value', NULL)) t(i, kind, problem)""")
def validate_components(spark, sf):
    rows = [
        (1, "label", "Part", None, None, None, None), (2, "label", "Ship", None, None, None, None), (3, "edge", "Nation", "IN_REGION", "Region", None, None), (4, "edge", "Nation", "CONTAINS", "Part", None, None),
        (5, "edge", "Region", "IN_REGION", "Nation", None, None), (6, "value", "Region", None, None, "name", "ASIA"), (7, "value", "Region", None, None, "name", "Asia"), (8, "value", "Ship", None, None, "name", "Asia"),
    ]
    claims = spark.createDataFrame(rows, "i int, kind string, label string, type string, other string, prop string, value string")
    values = R.property_values(tables(spark, sf)("region"), "Region", {"name": F.col("r_name")})
    return G.validated(claims, trade_graph(spark, sf), values).select("i", "kind", "problem")


@query("snap_literals", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def snap_literals(spark, sf):
    """A query whose literal is misspelt, snapped to the value that exists, then run."""
    from ..cypher.binder import run

    graph = trade_graph(spark, sf)
    values = R.property_values(tables(spark, sf)("region"), "Region", {"name": F.col("r_name")})
    text = "MATCH (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) WHERE r.name = 'EUROPA' RETURN count(c) AS n"
    return run(graph, G.snapped(graph, values, text))


@query("tool_routing")
def tool_routing(spark, sf):
    asked = spark.createDataFrame([(1, "customer name", "node"), (2, "contains quantity", "rel"), (3, "nation region", "structure")], "qid int, descriptor string, kind string")
    return G.routed(trade_graph(spark, sf), asked)


@query("fcav_topk", """WITH s AS (SELECT q.vec_id AS qid, CAST(r.label AS VARCHAR) AS value, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score
FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), m AS (SELECT qid, value, max(score) AS score FROM s GROUP BY 1, 2), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, value) AS INTEGER) AS rank FROM m)
SELECT * FROM t WHERE rank <= 15""")
def fcav_topk(spark, sf):
    """Several vectors may have one value: the best counts."""
    e = tables(spark, sf)("embeddings")
    return R.vector_topk(e.select(F.col("label").cast("string").alias("value"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 15)


@query("flatten_results", "SELECT qid, CAST(len(list_distinct(string_split(qid, ' '))) AS INTEGER) AS n FROM (SELECT DISTINCT p_name AS qid FROM part)")
def flatten_results(spark, sf):
    return mentions(spark, sf).select("qid", F.size(G.collapsed_results(F.array(F.split("qid", " "), F.array(F.lit(None).cast("string")), F.split("qid", " ")))).alias("n"))


# catalog profiles
NODE_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{label}' AS label, '{prop}' AS prop, '{kind}' AS type, count(*) AS nodes, count({column}) AS non_null, round(100.0 * count({column}) / nullif(count(*), 0), 1) AS fill_pct FROM {table}"
    for label, table, props in (
        ("Region", "region", "name string r_name"), ("Nation", "nation", "name string n_name"), ("Supplier", "supplier", "name string s_name, acctbal double s_acctbal"),
        ("Customer", "customer", "name string c_name, acctbal double c_acctbal, mktsegment string c_mktsegment"),
        ("Part", "part", "name string p_name, brand string p_brand, type string p_type, size int p_size, retailprice double p_retailprice, words array<string> p_name"),
        ("Order", "orders", "status string o_orderstatus, totalprice double o_totalprice, orderdate timestamp_ntz o_orderdate, priority string o_orderpriority"),
    )
    for prop, kind, column in (p.split() for p in props.split(", "))
)


@query("node_profile", NODE_PROFILE_SQL)
def node_profile(spark, sf):
    return P.node_profile(trade_graph(spark, sf)).drop("samples")


REL_PROFILE_SQL = """SELECT 'IN_REGION' AS type, 'Nation' AS source, 'Region' AS target, CAST(NULL AS VARCHAR) AS prop, count(*) AS edges, CAST(0 AS BIGINT) AS non_null FROM nation
UNION ALL SELECT 'LIVES_IN', 'Customer', 'Nation', NULL, count(*), 0 FROM customer UNION ALL SELECT 'BASED_IN', 'Supplier', 'Nation', NULL, count(*), 0 FROM supplier
UNION ALL SELECT 'LOCATED_IN', 'Customer', 'Nation', NULL, count(*), 0 FROM customer UNION ALL SELECT 'LOCATED_IN', 'Supplier', 'Nation', NULL, count(*), 0 FROM supplier
UNION ALL SELECT 'PLACED', 'Customer', 'Order', 'at', count(*), count(o_orderdate) FROM orders UNION ALL SELECT 'SUPPLIED', 'Supplier', 'Order', 'quantity', count(*), count(l_quantity) FROM lineitem
UNION ALL SELECT 'SUPPLIES', 'Supplier', 'Part', NULL, count(*), 0 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""" + "".join(
    f" UNION ALL SELECT 'CONTAINS', 'Order', 'Part', '{p}', count(*), count(l_{p}) FROM lineitem" for p in ("quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate", "linenumber")
)


@query("rel_profile", REL_PROFILE_SQL)
def rel_profile(spark, sf):
    return P.rel_profile(trade_graph(spark, sf))


@query("topology", """SELECT * FROM (VALUES ('Nation', 'IN_REGION', 'Region'), ('Customer', 'LIVES_IN', 'Nation'), ('Supplier', 'BASED_IN', 'Nation'), ('Customer', 'LOCATED_IN', 'Nation'), ('Supplier', 'LOCATED_IN', 'Nation'),
('Customer', 'PLACED', 'Order'), ('Order', 'CONTAINS', 'Part'), ('Supplier', 'SUPPLIED', 'Order'), ('Supplier', 'SUPPLIES', 'Part')) t(source, type, target)""")
def topology(spark, sf):
    return P.topology(trade_graph(spark, sf))


@query("avg_len", "SELECT round(avg(length(p_name)), 6) AS avg_len FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 200)")
def avg_len(spark, sf):
    return P.average_length(trade_graph(spark, sf), "Part", "name")


@query("embeddable", "SELECT * FROM (VALUES ('name', true), ('nation_id', false), ('acctbal', false), ('comment', true), ('flag', false), ('mktsegment', true)) t(prop, embeddable)")
def embeddable(spark, sf):
    rows = [("name", "string", 2.0, 1), ("nation_id", "string", 30.0, 99), ("acctbal", "double", 8.0, 99), ("comment", "string", 40.0, 5), ("flag", "string", 1.0, 3), ("mktsegment", "string", 9.0, 31)]
    df = spark.createDataFrame(rows, "prop string, t string, l double, d int")
    return df.select("prop", P.embeddable(F.col("prop"), F.col("t"), F.col("l"), F.col("d")).alias("embeddable"))


@query("centrality", "SELECT * FROM (VALUES ('Nation', 1::BIGINT), ('Customer', 3), ('Supplier', 4), ('Order', 1)) t(label, k)")
def centrality(spark, sf):
    return P.centrality(trade_graph(spark, sf))


@query("ghost_labels", "SELECT 'Region' AS label, count(*) AS nodes FROM region HAVING count(*) = 0")
def ghost_labels(spark, sf):
    return P.ghost_labels(trade_graph(spark, sf))


@query("closed_sets", "SELECT 'Customer' AS label, 'mktsegment' AS prop, count(DISTINCT c_mktsegment) AS k FROM customer")
def closed_sets(spark, sf):
    return P.closed_sets(R.property_values(tables(spark, sf)("customer"), "Customer", {"mktsegment": F.col("c_mktsegment"), "name": F.col("c_name")}))


@query("distinct_estimate", "SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments FROM customer")
def distinct_estimate(spark, sf):
    return trade_graph(spark, sf).node_frame("Customer").agg(F.count_distinct("name").alias("names"), F.count_distinct("mktsegment").alias("segments"))


@query("schema_block_central", "SELECT * FROM (VALUES ('Supplier', 4::BIGINT), ('Customer', 3), ('Nation', 1)) t(label, k)")
def schema_block_central(spark, sf):
    return P.schema_block(trade_graph(spark, sf)).select("label", "k").orderBy(F.desc("k"), "label").limit(3)


@query("property_class", "SELECT * FROM (VALUES ('custkey', 'id'), ('nationname', 'name'), ('comment', 'description'), ('size', 'other'), ('x', 'name')) t(prop, class)")
def property_class(spark, sf):
    df = spark.createDataFrame([("custkey", None), ("nationname", None), ("comment", None), ("size", None), ("x", "name")], "prop string, declared string")
    return df.select("prop", P.property_class(F.col("prop"), F.col("declared")).alias("class"))


@query("id_property", "SELECT * FROM (VALUES ('Movie', 'title'), ('Customer', 'name'), ('Crime', 'key')) t(label, id)")
def id_property(spark, sf):
    df = spark.createDataFrame([("Movie", None), ("Customer", None), ("Crime", "key")], "label string, declared string")
    return df.select("label", P.id_property(F.col("label"), F.col("declared")).alias("id"))


@query("relation_phrases", """SELECT * FROM (VALUES ('Region', 'Nation in region Region'), ('Nation', 'Nation in region Region; Customer lives in Nation; Supplier based in Nation; Customer located in Nation; Supplier located in Nation'),
('Customer', 'Customer lives in Nation; Customer located in Nation; Customer placed Order'), ('Supplier', 'Supplier based in Nation; Supplier located in Nation; Supplier supplied Order; Supplier supplies Part'),
('Order', 'Customer placed Order; Order contains Part; Supplier supplied Order'), ('Part', 'Order contains Part; Supplier supplies Part')) t(label, phrases)""")
def relation_phrases(spark, sf):
    return P.relation_phrases(trade_graph(spark, sf))


@query("connectivity_map", """SELECT * FROM (VALUES ('IN_REGION', 'Nation,Region'), ('LIVES_IN', 'Customer,Nation'), ('BASED_IN', 'Nation,Supplier'), ('LOCATED_IN', 'Customer,Nation,Supplier'), ('PLACED', 'Customer,Order'),
('CONTAINS', 'Order,Part'), ('SUPPLIED', 'Order,Supplier'), ('SUPPLIES', 'Part,Supplier')) t(type, labels)""")
def connectivity_map(spark, sf):
    return P.connectivity(trade_graph(spark, sf))


@query("edge_properties", "SELECT 'CONTAINS' AS type, unnest(['quantity', 'extendedprice', 'discount', 'tax', 'returnflag', 'linestatus', 'shipdate', 'linenumber']) AS prop UNION ALL SELECT 'PLACED', 'at' UNION ALL SELECT 'SUPPLIED', 'quantity'")
def edge_properties(spark, sf):
    return P.edge_properties(trade_graph(spark, sf))


# text functions
def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("conversations").select("conv_id", "turn", "text")


PAIRS_SQL = "names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', -1) AS noun FROM part), pairs AS (SELECT a.p_name AS a, b.p_name AS b FROM names a JOIN names b ON a.noun = b.noun AND a.p_name < b.p_name)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names with the same last word."""
    names = tables(spark, sf)("part").select("p_name", F.substring_index("p_name", " ", -1).alias("noun")).distinct()
    a, b = names.toDF("a", "noun"), names.toDF("b", "noun")
    return a.join(b, "noun").where("a < b").select("a", "b")


@query("lev_similarity", f"WITH {PAIRS_SQL} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS s FROM pairs")
def lev_similarity(spark, sf):
    return pairs(spark, sf).select("a", "b", F.round(X.lev_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@query("jaro_winkler", f"""WITH {PAIRS_SQL}, j AS (SELECT a, b, jaro_similarity(a, b) AS j, CASE WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 WHEN a[1] = b[1] THEN 1 ELSE 0 END AS p FROM pairs)
SELECT a, b, round(j + p * 0.1 * (1 - j), 4) AS s FROM j""")
def jaro_winkler(spark, sf):
    from ..functions.udf import jaro_winkler as jw

    return pairs(spark, sf).select("a", "b", F.round(jw("a", "b"), 4).alias("s"))


# unlimited swaps count as one edit in SQL; they differ from neighbours' only where a swapped pair is edited again, which these names don't show
@query("osa_distance", f"WITH {PAIRS_SQL} SELECT a, b, CAST(damerau_levenshtein(a, b) AS INTEGER) AS d FROM pairs")
def osa_distance(spark, sf):
    return pairs(spark, sf).select("a", "b", X.osa_distance(F.col("a"), F.col("b")).alias("d"))


@query("tokenise", r"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda w: NOT list_contains(" + str(list(X.STOPWORDS)) + ", w)), ' ') AS words FROM conversations")
def tokenise(spark, sf):
    return _texts(spark, sf).select("conv_id", "turn", F.array_join(X.words(F.col("text")), " ").alias("words"))


@query("collapse_space", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\s\p{Z}\x0b\x85]+', ' ', 'g')) AS t FROM conversations")
def collapse_space(spark, sf):
    return _texts(spark, sf).select("conv_id", "turn", X.collapsed(F.col("text")).alias("t"))


VALUES_SQL = """vals AS (SELECT DISTINCT p_name AS value FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT CAST(p_partkey AS VARCHAR) FROM part UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation
 UNION SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION SELECT strftime(o_orderdate, '%d/%m/%Y') FROM orders UNION SELECT strftime(o_orderdate, '%H:%M') || ' ' FROM orders UNION SELECT substr(o_orderpriority, 1, 1) || o_custkey FROM orders
 UNION SELECT o_orderstatus || o_orderkey % 100 || ' ' || o_orderkey % 10 || o_orderstatus FROM orders UNION SELECT lower(n_name) || '@mail' || n_regionkey || '.org' FROM nation UNION SELECT n_nationkey || ' ' || n_nationkey || '-' || n_regionkey FROM nation
 UNION SELECT lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '-12-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') FROM part UNION SELECT strftime(o_orderdate, '%-d') || 'th of ' || lower(o_orderpriority) || ' ' || strftime(o_orderdate, '%Y') FROM orders
 UNION SELECT 'account ' || c_nationkey FROM customer UNION SELECT lower(n_name) || '.com' FROM nation UNION SELECT 'Home' UNION SELECT 'after' UNION SELECT '3 May' UNION SELECT ' ')"""


def values_of_all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Names, codes, numbers, dates and addresses made of the tables' columns, each once."""
    t, s = tables(spark, sf), lambda c: F.col(c).cast("string")
    day = lambda form: F.date_format("o_orderdate", form)
    of = {
        "part": ["p_name", "p_brand", "p_type", s("p_partkey"), F.concat(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("-12-"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))],
        "customer": ["c_name", F.concat(F.lit("account "), s("c_nationkey"))],
        "nation": ["n_name", F.concat(F.lower("n_name"), F.lit("@mail"), s("n_regionkey"), F.lit(".org")), F.concat(s("n_nationkey"), F.lit(" "), s("n_nationkey"), F.lit("-"), s("n_regionkey")), F.concat(F.lower("n_name"), F.lit(".com"))],
        "orders": [
            day("yyyy-MM-dd"), day("dd/MM/yyyy"), F.concat(day("HH:mm"), F.lit(" ")), F.concat(F.substring("o_orderpriority", 1, 1), s("o_custkey")),
            F.concat("o_orderstatus", (F.col("o_orderkey") % 100).cast("string"), F.lit(" "), (F.col("o_orderkey") % 10).cast("string"), "o_orderstatus"),
            F.concat(day("d"), F.lit("th of "), F.lower("o_orderpriority"), F.lit(" "), day("yyyy")),
        ],
    }
    rows = [t(name).select(F.explode(F.array(*[F.col(c) if isinstance(c, str) else c for c in columns])).alias("value")) for name, columns in of.items()]
    rows.append(spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Home", "after", "3 May", " ")])).alias("value")))
    return functools.reduce(DataFrame.union, rows).distinct()


@query("entity_typing", rf"""WITH {VALUES_SQL}, t AS (SELECT value, trim(value) AS t FROM vals)
SELECT value, CASE WHEN t = '' THEN 'id' WHEN regexp_matches(t, '{X.EMAIL}') THEN 'email' WHEN regexp_matches(t, '{X.TIME}') THEN 'time' WHEN regexp_matches(t, '{X.SSN}') THEN 'id' WHEN regexp_matches(t, '{X.DATE}') THEN 'date'
 WHEN regexp_matches(regexp_replace(t, '{X.SEPARATORS}', '', 'g'), '^\d+$') THEN 'id' WHEN regexp_matches(t, '{X.POSTCODE}') AND regexp_matches(t, '\d') AND length(t) <= 8 THEN 'id' ELSE 'name' END AS type FROM t""")
def entity_typing(spark, sf):
    return values_of_all_kinds(spark, sf).select("value", X.entity_type(F.col("value")).alias("type"))


@query("literal_extract", """WITH l AS (SELECT p_partkey AS k, [p_name, CASE WHEN p_size % 2 = 0 THEN p_brand || chr(39) || 's' ELSE p_name END, substr(p_type, 1, 1 + p_size % 3), 'say "' || p_type || '"'] AS v FROM part)
SELECT k, array_to_string(list_filter(list_filter(v, lambda x, i: list_position(v, x) = i), lambda x: length(x) >= 2), '|') AS found FROM l""")
def literal_extract(spark, sf):
    q = F.lit("'")
    second = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("\\'s"))).otherwise(F.col("p_name"))
    short = F.substring(F.col("p_type"), F.lit(1), 1 + F.col("p_size") % 3)
    text = F.concat(F.lit("MATCH (n) WHERE n.a = '"), "p_name", q, F.lit(" OR n.b = '"), second, q, F.lit(' OR n.c = "'), short, F.lit('" OR n.d = "say \\"'), "p_type", F.lit('\\"" RETURN n'))
    return tables(spark, sf)("part").select(F.col("p_partkey").alias("k"), F.array_join(X.quoted_literals(text), "|").alias("found"))


@query("occurrences", """SELECT p_partkey AS k, array_to_string(list_filter(range(0, greatest(length(p_name) - length(p) + 1, 0)), lambda i: substr(lower(p_name), CAST(i AS INTEGER) + 1, length(p)) = lower(p)), ',') AS places
FROM (SELECT *, upper(substr(p_name, 1 + p_size % 4, 1 + p_size % 2)) AS p FROM part)""")
def occurrences(spark, sf):
    part = F.upper(F.substring(F.col("p_name"), 1 + F.col("p_size") % 4, 1 + F.col("p_size") % 2))
    return tables(spark, sf)("part").select(F.col("p_partkey").alias("k"), F.array_join(F.transform(X.occurrences(F.col("p_name"), part), lambda c: c.cast("string")), ",").alias("places"))


@query("acronym", """WITH f AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS name, CASE p_size % 5 WHEN 0 THEN upper(substr(p_name, 1, 3)) WHEN 1 THEN p_name[1] || '.' || lower(split_part(p_name, ' ', 2)[1]) || '.' || p_type[1] WHEN 2 THEN p_name WHEN 3 THEN p_type ELSE '' END AS form FROM part),
 i AS (SELECT *, upper(array_to_string(list_transform(regexp_extract_all(name, '[A-Za-z]+'), lambda w: w[1]), '')) AS initials, form = upper(form) AND form <> lower(form) AS caps FROM f)
SELECT k, CASE WHEN form = '' OR (contains(form, ' ') AND NOT caps) THEN false WHEN caps AND length(form) BETWEEN 2 AND 6 THEN true ELSE replace(upper(form), '.', '') = initials AND length(initials) >= 2 END AS short FROM i""")
def acronym(spark, sf):
    n, t = F.col("p_name"), F.col("p_type")
    first = lambda c: F.substring(c, 1, 1)
    size = F.col("p_size") % 5
    form = F.when(size == 0, F.upper(F.substring(n, 1, 3))).when(size == 1, F.concat(first(n), F.lit("."), F.lower(first(F.split_part(n, F.lit(" "), F.lit(2)))), F.lit("."), first(t))).when(size == 2, n).when(size == 3, t).otherwise("")
    return tables(spark, sf)("part").select(F.col("p_partkey").alias("k"), X.is_acronym(F.concat(n, F.lit(" "), t), form).alias("short"))


@query("identifiers", r"""WITH n AS (SELECT DISTINCT o_orderpriority AS s FROM orders UNION SELECT p_name || 'Of' || p_brand FROM part UNION SELECT ':`' || upper(p_name) || '`' FROM part UNION SELECT 'HTTPServer' || p_size || 'isUp' FROM part),
 i AS (SELECT s, lower(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS ident FROM n)
SELECT s, ident AS type_name, lower(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS prop_name, lower(regexp_replace(regexp_replace(ident, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS label_name FROM i""")
def identifiers(spark, sf):
    t = tables(spark, sf)
    part = t("part")
    names = t("orders").select(F.col("o_orderpriority").alias("s")).union(part.select(F.concat("p_name", F.lit("Of"), "p_brand")))
    names = names.union(part.select(F.concat(F.lit(":`"), F.upper("p_name"), F.lit("`")))).union(part.select(F.concat(F.lit("HTTPServer"), F.col("p_size").cast("string"), F.lit("isUp")))).distinct()
    s = F.col("s")
    return names.select("s", X.type_identifier(s).alias("type_name"), X.snake_case(s).alias("prop_name"), X.label_identifier(s).alias("label_name"))


@query("row_seeds", "SELECT r_name AS name, CAST(('0x' || substr(sha256('42|x|' || r_name), 1, 16))::UBIGINT AS VARCHAR) AS seed FROM region")
def row_seeds(spark, sf):
    return tables(spark, sf)("region").select(F.col("r_name").alias("name"), X.row_seed(F.lit("42"), F.lit("x"), F.col("r_name")).cast("string").alias("seed"))


@query("json_object", """SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN NULL WHEN 3 THEN '{"a": {"b": "' || p_name || '"}} and {}' ELSE '{"name": "' || p_name || '"}' END AS j FROM part""")
def json_object(spark, sf):
    n, size = F.col("p_name"), F.col("p_size") % 4
    one = F.concat(F.lit('{"name": "'), n, F.lit('"}'))
    text = F.when(size == 0, F.concat(F.lit("No answer for "), n)).when(size == 1, F.concat(F.lit("Sure:\n```json\n"), one, F.lit("\n```"))).when(size == 2, F.concat(one, F.lit(" is what I found"))).otherwise(F.concat(F.lit('I found {"a": {"b": "'), n, F.lit('"}} and {}.')))
    return tables(spark, sf)("part").select(F.col("p_partkey").alias("k"), X.json_object(text).alias("j"))


@query("float_snap", "SELECT vec_id, round(round_even(CAST(embedding[1] AS DOUBLE) / 0.01, 0) * 0.01, 6) AS x FROM embeddings")
def float_snap(spark, sf):
    return tables(spark, sf)("embeddings").select("vec_id", F.round(X.snap(F.get("embedding", F.lit(0)).cast("double"), 0.01), 6).alias("x"))


@query("word_splice")
def word_splice(spark, sf):
    from ..functions.udf import splice

    part = tables(spark, sf)("part").select("p_name").distinct()
    word = F.get(F.split("p_name", " "), F.lit(0))
    return part.select("p_name", splice(F.concat(F.lit("a "), F.col("p_name"), F.lit(" part")), word, F.lit("azure")).alias("text"))
