"""Registered queries: result comparison, metrics, statistics, sampling, augmentation.

The tables have no evaluation records, so both engines derive the same ones from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cypher.binder import run
from ..functions import text as X
from ..operators import augment as A
from ..operators import evaluate as E
from ..operators import sampling as S
from ..operators import stats as T
from .catalog import tables, trade_graph
from .linking import MENTIONS_SQL, VALUES_SQL, mentions, part_values, values_of_all_kinds
from .registry import query

RECORDS_SQL = """records AS (SELECT o_orderkey AS qid, o_orderpriority AS graph, o_orderstatus AS strategy,
 CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey * 7 + o_orderkey) % 3 <> 0 END AS ea,
 CASE WHEN o_orderkey % 11 <> 0 THEN ((o_custkey * 13 + o_orderkey) % 101) / 100.0::DOUBLE END AS psjs,
 CASE o_orderkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS bucket,
 CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'gold: timed out' ELSE 'Syntax error near 12' END END AS error,
 CAST(o_custkey % 3 AS INTEGER) AS rows, o_orderdate AS stamp, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS method FROM orders)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = k % 11 != 0
    return tables(spark, sf)("orders").select(
        k.alias("qid"), F.col("o_orderpriority").alias("graph"), F.col("o_orderstatus").alias("strategy"), F.when(some, (c * 7 + k) % 3 != 0).alias("ea"), F.when(some, ((c * 13 + k) % 101) / F.lit(100.0)).alias("psjs"),
        F.when(k % 4 == 0, "easy").when(k % 4 == 1, "medium").when(k % 4 == 2, "hard").alias("bucket"), F.when(~some, F.when(k % 2 == 0, "gold: timed out").otherwise("Syntax error near 12")).alias("error"),
        (c % 3).cast("int").alias("rows"), F.col("o_orderdate").cast("timestamp").alias("stamp"), F.when(k % 2 == 0, "a").otherwise("b").alias("method"),
    )


# Ratings: three raters over documents, from the labels table.
RATINGS_SQL = """ratings AS (SELECT doc_id AS item, 'q' AS annotator, CAST(quality AS VARCHAR) AS label FROM labels UNION ALL SELECT doc_id, 't', CAST(1 - toxic AS VARCHAR) FROM labels
 UNION ALL SELECT doc_id, 'x', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE quality END AS VARCHAR) END FROM labels)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    d = tables(spark, sf)("labels")
    third = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("quality")).cast("string"))
    one = lambda name, label: d.select(F.col("doc_id").alias("item"), F.lit(name).alias("annotator"), label.alias("label"))
    return one("q", F.col("quality").cast("string")).union(one("t", (1 - F.col("toxic")).cast("string"))).union(one("x", third))


@query("ea_multiset", """SELECT * FROM (VALUES ('same', true), ('permuted', true), ('subset', false), ('twice', false), ('empty', true)) t(pair, ea)""")
def ea_multiset(spark, sf):
    """Customers of each nation against variants of the same result."""
    g = trade_graph(spark, sf)
    gold = run(g, "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.name AS c, n.name AS n, c.acctbal AS b")
    variants = {
        "same": gold, "permuted": gold.select(F.upper("n").alias("x"), F.col("b").alias("y"), F.concat(F.lit(" "), "c").alias("z")), "subset": gold.where("b > 0"), "twice": gold.union(gold),
    }
    out = [E.same_results(p, gold).select(F.lit(k).alias("pair"), "ea") for k, p in variants.items()]
    return E.union_all([*out, E.same_results(gold.where("false"), gold.select("c").where("false")).select(F.lit("empty").alias("pair"), "ea")])


@query("ea_per_query", """WITH c AS (SELECT n_name AS qid, count(*) FILTER (c_acctbal <= 0) AS lost FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT qid, lost = 0 AS ea FROM c""")
def ea_per_query(spark, sf):
    rows = run(trade_graph(spark, sf), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.name AS qid, c.name AS c, c.acctbal AS b")
    return E.per_query_ea(rows.where("b > 0"), rows)


@query("ea_strict", "SELECT * FROM (VALUES ('loose', true), ('strict', false)) t(mode, ea)")
def ea_strict(spark, sf):
    rows = tables(spark, sf)("region").select("r_name")
    other = rows.select(F.lower("r_name").alias("r_name"))
    return E.same_results(other, rows).select(F.lit("loose").alias("mode"), "ea").union(E.same_results(other, rows, E.STRICT).select(F.lit("strict").alias("mode"), "ea"))


@query("ordered_match", "SELECT * FROM (VALUES ('same', true), ('reversed', false)) t(pair, ea)")
def ordered_match(spark, sf):
    rows = tables(spark, sf)("nation").select(F.col("n_nationkey").alias("i"), "n_name")
    back = tables(spark, sf)("nation").select((24 - F.col("n_nationkey")).alias("i"), "n_name")
    return E.same_sequence(rows, rows, "i").select(F.lit("same").alias("pair"), "ea").union(E.same_sequence(back, rows, "i").select(F.lit("reversed").alias("pair"), "ea"))


@query("em_exact", """SELECT p_partkey AS k, CASE WHEN p_size % 7 = 6 THEN NULL ELSE p_size % 7 IN (0, 1, 2) END AS em FROM part""")
def em_exact(spark, sf):
    n, kind = F.col("p_name"), F.col("p_size") % 7
    gold = F.concat(F.lit("MATCH (n {name: '"), n, F.lit("'}) RETURN n"))
    pred = (
        F.when(kind == 0, gold).when(kind == 1, F.concat(F.lit("  "), F.regexp_replace(gold, " RETURN", "\n\t RETURN"), F.lit(" ;\n"))).when(kind == 2, F.concat(gold, F.lit(";")))
        .when(kind == 3, F.lower(gold)).when(kind == 4, F.concat(gold, F.lit(".x"))).when(kind == 6, gold)
    )
    return tables(spark, sf)("part").select(F.col("p_partkey").alias("k"), E.exact_match(pred, F.when(kind != 6, gold)).alias("em"))


@query("psjs_jaccard", """WITH p AS (SELECT n_name AS qid, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0), g AS (SELECT n_name AS qid, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 5000)
SELECT qid, count(p.id) FILTER (g.id IS NOT NULL) AS inter, count(*) AS "both", round(count(p.id) FILTER (g.id IS NOT NULL) / count(*), 6) AS psjs FROM p FULL JOIN g USING (qid, id) GROUP BY 1""")
def psjs_jaccard(spark, sf):
    ids = run(trade_graph(spark, sf), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.name AS qid, id(c) AS id, c.acctbal AS b")
    return E.jaccard(ids.where("b > 0"), ids.where("b < 5000"))


@query("provenance_ids", """SELECT 'Nation:' || n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION SELECT 'Region:' || r_regionkey FROM region WHERE r_name = 'ASIA'
UNION SELECT 'IN_REGION:' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def provenance_ids(spark, sf):
    from ..cypher.rewrite import provenance

    return provenance(trade_graph(spark, sf), "MATCH (n:Nation)-[:IN_REGION]->(r:Region {name:'ASIA'}) RETURN count(n) AS k")


@query("node_set", "SELECT * FROM (VALUES ('same_nodes', true), ('other_nodes', false)) t(pair, verdict)")
def node_set(spark, sf):
    from ..cypher.rewrite import node_set_verdict

    g = trade_graph(spark, sf)
    gold = "MATCH (n:Nation)-[:IN_REGION]->(:Region {name:'ASIA'}) RETURN n"
    same = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name = 'ASIA' RETURN n.name"
    other = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name = 'AFRICA' RETURN n.name"
    rows = [node_set_verdict(g, p, gold).select(F.lit(k).alias("pair"), "verdict") for k, p in (("same_nodes", same), ("other_nodes", other))]
    return E.union_all(rows)


#: Queries made of a part's numbers: hops of the path, predicates, the kind of projection.
PROJECTIONS = (
    (" RETURN a", 0), (" RETURN count(a)", 1), (" RETURN a.x, count(*)", 2), (" RETURN a ORDER BY a.x LIMIT 1", 2), (" RETURN a ORDER BY a.x LIMIT 10", 1), (" RETURN CASE WHEN a.x = 1 THEN 1 END", 2),
    (" RETURN a.x UNION MATCH (c) RETURN c.x", 2), (" WITH a, max(a.y) AS m RETURN m", 2), (" RETURN a.x SKIP 2", 1),
)
DIFFICULTY_SQL = f"""made AS (SELECT p_partkey AS k, p_partkey % 6 AS hops, p_size % 4 AS n, p_size % 3 = 0 AND p_size % 4 = 3 AS mixed, p_partkey // 6 % {len(PROJECTIONS)} AS p, [{", ".join(str(x) for _, x in PROJECTIONS)}] AS points FROM part),
scored AS (SELECT k, p, hops, CASE WHEN hops >= 4 THEN 2 WHEN hops >= 2 THEN 1 ELSE 0 END AS reach, points[p + 1] AS op, CASE WHEN mixed OR n >= 3 THEN 2 WHEN n = 2 THEN 1 ELSE 0 END AS filter FROM made),
levels AS (SELECT *, CASE WHEN p = 6 AND hops >= 2 OR reach + op + filter >= 3 THEN 'hard' WHEN reach + op + filter >= 1 THEN 'medium' ELSE 'easy' END AS level FROM scored)"""


def made_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(k, query): a path, with a second pattern that is shorter; a comment and texts hold what
    would count elsewhere."""
    size, key = F.col("p_size"), F.col("p_partkey")
    n = size % 4
    join = F.when(size % 3 == 0, " OR a.s = 'x AND y, -[]-'").otherwise(" AND a.s = 'x OR y'")
    where = F.when(n == 0, "").otherwise(F.concat(F.lit(" WHERE a.x = 1"), F.when(n > 1, " AND a.y = 2").otherwise(""), F.when(n > 2, join).otherwise("")))
    path = F.concat(F.lit("MATCH (z), (a:L)"), F.repeat(F.lit("-[:R]->(:L)"), (key % 6).cast("int")), F.lit(" // WHERE (b)-[*]->(c)\n"))
    tail = F.get(F.array(*[F.lit(x) for x, _ in PROJECTIONS]), (F.floor(key / 6) % len(PROJECTIONS)).cast("int"))
    return tables(spark, sf)("part").select(key.alias("k"), F.concat(path, where, tail).alias("query"))


@query("difficulty_bucket", f"WITH {DIFFICULTY_SQL} SELECT k, CAST(reach AS INTEGER) AS reach, CAST(op AS INTEGER) AS op, CAST(filter AS INTEGER) AS filter, level FROM levels")
def difficulty_bucket(spark, sf):
    return made_queries(spark, sf).withColumn("d", E.difficulty(F.col("query"))).select("k", "d.reach", "d.op", "d.filter", "d.level")


@query("difficulty_backfill", f"WITH {DIFFICULTY_SQL} SELECT k, CASE WHEN k % 3 > 0 THEN level END AS level, k % 3 > 0 AND (k % 3 = 1 OR level <> 'easy') AS changed FROM levels")
def difficulty_backfill(spark, sf):
    k = F.col("k")
    meta = F.when(k % 3 == 1, F.struct(F.lit("v").alias("v"), F.lit(None).cast("string").alias("difficulty"))).when(k % 3 == 2, F.struct(F.lit("v").alias("v"), F.lit("easy").alias("difficulty")))
    rows = made_queries(spark, sf).select("k", F.col("query").alias("gold_cypher"), meta.alias("_aug_meta")).withColumn("before", F.col("_aug_meta.difficulty"))
    return A.nested_difficulty(rows).select("k", F.col("_aug_meta.difficulty").alias("level"), (F.col("_aug_meta").isNotNull() & ~F.col("before").eqNullSafe(F.col("_aug_meta.difficulty"))).alias("changed"))


@query("strategy_extraction", f"WITH {RECORDS_SQL} SELECT CASE WHEN qid % 5 < 3 THEN strategy END AS strategy, count(*) AS n FROM records GROUP BY 1")
def strategy_extraction(spark, sf):
    edits = F.array(F.struct("strategy", "qid"), F.struct(F.lit("later").alias("strategy"), "qid"))
    q = F.col("qid") % 5
    meta = F.when(q < 4, F.struct(F.when(q < 3, edits).otherwise(F.slice(edits, 1, 0)).alias("edits")))
    return records(spark, sf).select(E.strategy_of(meta).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query("stale_guard", f"""WITH {RECORDS_SQL}, r AS (SELECT graph, method, ea, CASE qid % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'old' END AS rule, CASE WHEN method = 'a' THEN true WHEN qid % 5 = 0 THEN NULL ELSE false END AS chain FROM records)
SELECT graph, method, count(*) FILTER (coalesce(chain, false) AND ea IS NOT NULL AND rule IS DISTINCT FROM 'full') AS stale FROM r GROUP BY 1, 2""")
def stale_guard(spark, sf):
    q = F.col("qid")
    rule, chain = F.when(q % 3 == 0, "full").when(q % 3 == 1, "old"), F.when(F.col("method") == "a", True).when(q % 5 == 0, None).otherwise(False)
    return records(spark, sf).groupBy("graph", "method").agg(F.count(F.when(E.stale(F.col("ea"), rule, chain, "full"), 1)).alias("stale"))


@query("result_sample", f"""WITH {RECORDS_SQL}, r AS (SELECT graph, list(qid ORDER BY qid) AS ids FROM records GROUP BY 1), j AS (SELECT graph, '[' || array_to_string(list_transform(ids[1:50], lambda x: '{{"qid":' || x || '}}'), ',') || ']' AS t FROM r)
SELECT graph, CASE WHEN length(t) > 600 THEN t[1:600] || ' …(truncated)' ELSE t END AS sample FROM j""")
def result_sample(spark, sf):
    first = records(spark, sf).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("qid"))).alias("rows"))
    return first.select("graph", X.row_sample(F.col("rows"), 50, 600).alias("sample"))


@query("rater_files", """WITH f AS (SELECT 'x/file_' || doc_id % 5 || CASE WHEN doc_id % 5 = 3 THEN '_D' ELSE '' END || '.csv' AS file, doc_id AS id, doc_id % 5 AS g FROM labels), c AS (SELECT file, g, count(*) AS n FROM f GROUP BY 1, 2)
SELECT file, CASE g WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 3 THEN 'D' END AS rater, CASE WHEN g <> 1 AND (g = 0 OR n < 100) THEN 'calibration' ELSE 'main' END AS kind, CASE g WHEN 0 THEN 'column' WHEN 1 THEN 'queue' WHEN 3 THEN 'name' ELSE 'unknown' END AS how FROM c""")
def rater_files(spark, sf):
    d = F.col("doc_id")
    g = d % 5
    rows = tables(spark, sf)("labels").select(
        F.concat(F.lit("x/file_"), g.cast("string"), F.when(g == 3, "_D").otherwise(""), F.lit(".csv")).alias("file"), d.alias("id"), F.when((g == 0) & (d % 2 == 0), " a ").when(g == 2, F.when(d % 2 == 0, "A").otherwise("C")).alias("annotator")
    )
    queues = rows.where("file like '%_1.csv'").select(F.lit("B").alias("rater"), "id").union(rows.where("file like '%_4.csv' and id > 20").select(F.lit("E").alias("rater"), "id"))
    return E.rater_files(rows, queues, rows.where("file like '%_0.csv'").select("id"))


@query("bucket_means", f"WITH {RECORDS_SQL}, u AS (SELECT 'all' AS bucket, ea, psjs FROM records UNION ALL SELECT bucket, ea, psjs FROM records WHERE bucket IS NOT NULL) SELECT bucket, count(*) AS n, round(avg(coalesce(CAST(ea AS INTEGER), 0)), 6) AS ea, round(avg(coalesce(psjs, 0)), 6) AS psjs FROM u GROUP BY 1")
def bucket_means(spark, sf):
    return E.bucket_means(records(spark, sf))


@query("headline", f"WITH {RECORDS_SQL} SELECT graph, count(*) AS n, round(sum(CASE WHEN ea THEN 1 ELSE 0 END) / count(*), 6) AS ea, count(error) AS errors FROM records GROUP BY 1")
def headline(spark, sf):
    return records(spark, sf).groupBy("graph").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("ea"), 1).otherwise(0)) / F.count("*"), 6).alias("ea"), F.count("error").alias("errors"))


@query("paired_flips", f"""WITH {RECORDS_SQL}, p AS (SELECT coalesce(ea, false) AS x, coalesce(qid % 3 = 0, false) AS y FROM records)
SELECT count(*) AS n, count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (NOT x AND y) AS won, count(*) FILTER (NOT x AND NOT y) AS neither, round(avg(y::INT) - avg(x::INT), 6) AS delta FROM p""")
def paired_flips(spark, sf):
    a = records(spark, sf)
    return E.paired_flips(a, a.select("qid", (F.col("qid") % 3 == 0).alias("ea")))


@query("sign_test", """WITH RECURSIVE f AS (SELECT p_brand AS brand, count(*) FILTER (p_size % 7 = 0) AS k, count(*) FILTER (p_size % 7 IN (0, 1)) AS n FROM part GROUP BY 1 UNION ALL SELECT 'none', 0, 0),
t AS (SELECT brand, k, n, least(k, n - k) AS low, 0 AS i, pow(0.5::DOUBLE, n) AS c, pow(0.5::DOUBLE, n) AS s FROM f UNION ALL SELECT brand, k, n, low, i + 1, c * (n - i) / (i + 1), s + c * (n - i) / (i + 1) FROM t WHERE i < low)
SELECT brand, k, n, round(least(1.0, 2 * s), 5) AS p FROM t WHERE i = low""")
def sign_test(spark, sf):
    size = F.col("p_size") % 7
    flips = tables(spark, sf)("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.when(size == 0, 1)).alias("k"), F.count(F.when(size < 2, 1)).alias("n"))
    flips = flips.union(spark.range(1).select(F.lit("none"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return flips.select("brand", "k", "n", F.round(E.sign_test(F.col("k"), F.col("n")), 5).alias("p"))


CELLS = f"{RECORDS_SQL}, cells AS (SELECT graph, bucket, avg(psjs) AS value, count(psjs) AS n FROM records GROUP BY 1, 2)"


def cells(spark, sf):
    return records(spark, sf).groupBy("graph", "bucket").agg(F.avg("psjs").alias("value"), F.count("psjs").alias("n"))


@query("pooled_delta", f"WITH {CELLS} SELECT round(sum(value * n) / sum(n), 6) AS micro, round(avg(value), 6) AS macro FROM cells WHERE value IS NOT NULL AND n > 0")
def pooled_delta(spark, sf):
    return E.pooled(cells(spark, sf))


@query("micro_average", f"WITH {CELLS} SELECT bucket, round(sum(value * n) / nullif(sum(n), 0), 6) AS value FROM cells WHERE value IS NOT NULL GROUP BY 1")
def micro_average(spark, sf):
    return cells(spark, sf).where("value is not null").groupBy("bucket").agg(F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), 6).alias("value"))


@query("failure_buckets", f"""WITH {RECORDS_SQL} SELECT qid, CASE WHEN psjs >= 0.99 THEN 'ok' WHEN qid % 3 = 0 THEN 'value' WHEN qid % 5 = 0 THEN 'relationship' WHEN psjs >= 0.8 THEN 'partial' ELSE 'structure' END AS bucket FROM records""")
def failure_buckets(spark, sf):
    q, values, types = F.col("qid"), F.array("graph", "strategy"), F.array(F.lit("R"), F.lit("S"))
    pred_values, pred_types = F.when(q % 3 == 0, F.array("graph")).otherwise(F.reverse(values)), F.when(q % 5 == 0, F.array(F.lit("R"), F.lit("T"), F.lit("S"))).otherwise(types)
    return records(spark, sf).select("qid", E.failure_bucket(pred_values, values, pred_types, types, F.col("psjs")).alias("bucket"))


ERROR_TEXTS = (
    "gold: timed out after ", "agent: CypherSyntaxError at ", "gold: Neo.ClientError.Statement, timed out ", "gold: no rows ", "agent: APITimeoutError ", "agent gave up ", "HTTP 503 at ", "unknown function ", "agent: neo.clienterror.x ", "status code: 429 ",
)


@query("error_class", rf"""WITH {RECORDS_SQL}, e AS (SELECT [{", ".join(f"'{x}'" for x in ERROR_TEXTS)}][qid % {len(ERROR_TEXTS)} + 1] || qid AS error FROM records UNION ALL SELECT error FROM records)
SELECT CASE WHEN regexp_matches(e, '(?i){X.STATEMENT_ERROR}') THEN CASE WHEN starts_with(e, 'gold') THEN 'gold' ELSE 'agent' END WHEN regexp_matches(e, '(?i){X.INFRA_ERROR}') THEN 'infra' WHEN starts_with(e, 'gold') THEN 'gold' WHEN starts_with(e, 'agent') THEN 'agent' ELSE 'other' END AS class,
 regexp_replace(error, '\d+', 'N', 'g') AS text, count(*) AS n FROM (SELECT error, coalesce(error, '') AS e FROM e) GROUP BY 1, 2""")
def error_class(spark, sf):
    r = records(spark, sf)
    made = F.concat(F.get(F.array(*[F.lit(x) for x in ERROR_TEXTS]), (F.col("qid") % len(ERROR_TEXTS)).cast("int")), F.col("qid").cast("string"))
    rows = r.select(made.alias("error")).union(r.select("error"))
    return rows.groupBy(X.error_class(F.col("error")).alias("class"), X.masked_digits(F.col("error")).alias("text")).agg(F.count("*").alias("n"))


@query("gold_dedup", f"WITH {RECORDS_SQL} SELECT graph, qid % 100 AS qid, arg_min(error, (stamp, error)) AS error, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM records WHERE error IS NOT NULL GROUP BY 1, 2")
def gold_dedup(spark, sf):
    errors = records(spark, sf).where("error is not null").withColumn("qid", F.col("qid") % 100).withColumn("stamp", F.struct("stamp", "error"))
    return E.gold_dedup(errors)


@query("failure_modes", f"WITH {RECORDS_SQL} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN ea THEN 'correct' WHEN rows = 0 THEN 'wrong_empty' ELSE 'wrong_nonempty' END AS mode, count(*) AS n FROM records GROUP BY 1")
def failure_modes(spark, sf):
    return records(spark, sf).groupBy(E.failure_mode(F.col("ea"), F.col("rows"), F.col("error")).alias("mode")).agg(F.count("*").alias("n"))


@query("retired_antijoin", f"WITH {RECORDS_SQL} SELECT count(*) AS n FROM records WHERE NOT (qid % 10 = 0 AND error IS NULL)")
def retired_antijoin(spark, sf):
    r = records(spark, sf).withColumn("text", F.col("error"))
    retired = r.where("qid % 10 = 0").select("qid", F.lit(None).cast("string").alias("text"))
    return E.without_retired(r, retired).agg(F.count("*").alias("n"))


@query("latest_run", f"WITH {RECORDS_SQL} SELECT graph, strategy, max(stamp) AS stamp FROM records GROUP BY 1, 2")
def latest_run(spark, sf):
    return E.latest(records(spark, sf).select("graph", "strategy", "stamp", "qid"), ["graph", "strategy"]).select("graph", "strategy", "stamp")


@query("spearman", """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, sf):
    return E.spearman(tables(spark, sf)("part").select("p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("distribution_ok", f"WITH {RECORDS_SQL} SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () BETWEEN 0.05 AND 0.75 AS ok FROM records WHERE bucket IS NOT NULL GROUP BY 1")
def distribution_ok(spark, sf):
    return E.acceptable(records(spark, sf))


@query("rescore_verified", f"""WITH {RECORDS_SQL}, k AS (SELECT *, CASE WHEN qid % 5 = 0 THEN NULL ELSE qid % 5 <> 1 END AS keep FROM records)
SELECT 'before' AS part, count(*) AS n, round(avg(coalesce(ea::INT, 0)), 6) AS ea, round(avg(coalesce(psjs, 0)), 6) AS psjs, count(*) FILTER (keep IS NULL) AS unmatched FROM k
UNION ALL SELECT 'after', count(*), round(avg(coalesce(ea::INT, 0)), 6), round(avg(coalesce(psjs, 0)), 6), count(*) FILTER (keep IS NULL) FROM k WHERE keep IS NULL OR keep""")
def rescore_verified(spark, sf):
    r = records(spark, sf)
    keep = r.where("qid % 5 <> 0").select("graph", "qid", (F.col("qid") % 5 != 1).alias("keep"))
    return E.rescored(r, keep)


@query("method_bucket_pivot", f"WITH {RECORDS_SQL} SELECT method, round(avg(psjs) FILTER (bucket = 'easy'), 6) AS easy, round(avg(psjs) FILTER (bucket = 'medium'), 6) AS medium, round(avg(psjs) FILTER (bucket = 'hard'), 6) AS hard FROM records GROUP BY 1")
def method_bucket_pivot(spark, sf):
    return E.method_matrix(records(spark, sf).select("method", "bucket", F.col("psjs").alias("value")), ["easy", "medium", "hard"])


@query("error_split", f"WITH {RECORDS_SQL} SELECT graph, count(*) FILTER (error LIKE 'gold:%') AS gold_failed, count(*) FILTER (error NOT LIKE 'gold:%') AS method_failed FROM records WHERE ea IS NULL GROUP BY 1")
def error_split(spark, sf):
    return E.error_split(records(spark, sf))


@query("run_audit", f"""WITH {RECORDS_SQL}, runs AS (SELECT graph, strategy, stamp, CAST(count(*) % 3 AS BIGINT) AS n FROM records GROUP BY 1, 2, 3), rel AS (SELECT DISTINCT graph, CAST(1 AS BIGINT) AS released FROM records WHERE graph <> '1-URGENT'),
m AS (SELECT runs.*, released, max(CASE WHEN n = released THEN stamp END) OVER (PARTITION BY graph, strategy) AS newest FROM runs LEFT JOIN rel USING (graph))
SELECT graph, strategy, stamp, n, CASE WHEN released IS NULL THEN 'outside' WHEN n = 0 THEN 'delete' WHEN n > released THEN 'check' WHEN n = released AND stamp < newest THEN 'older' WHEN n <> released THEN 'partial' ELSE 'keep' END AS verdict FROM m""")
def run_audit(spark, sf):
    runs = records(spark, sf).groupBy("graph", "strategy", "stamp").agg((F.count("*") % 3).alias("n"))
    released = records(spark, sf).where("graph <> '1-URGENT'").select("graph", F.lit(1).cast("long").alias("n")).distinct()
    return E.run_verdicts(runs, released)


@query("gold_executability", f"WITH {RECORDS_SQL} SELECT graph, count(*) AS n, count(error) AS errors, count(*) FILTER (error LIKE '%timed out%') AS timeouts, count(*) FILTER (rows = 0) AS empty FROM records WHERE graph <> '5-LOW' GROUP BY 1")
def gold_executability(spark, sf):
    r = records(spark, sf)
    released = r.groupBy("graph").agg((F.count("*") + F.when(F.col("graph") == "5-LOW", 1).otherwise(0)).alias("n"))
    return E.executability(r, released)


@query("datasheet_crosstab", f"WITH {RECORDS_SQL} SELECT strategy, round(100.0 * count(*) FILTER (method = 'a') / count(*), 4) AS pct_a, round(100.0 * count(*) FILTER (method = 'b') / count(*), 4) AS pct_b, string_agg(DISTINCT graph, ',' ORDER BY graph) AS graphs FROM records GROUP BY 1")
def datasheet_crosstab(spark, sf):
    share = lambda m: F.round(100.0 * F.count(F.when(F.col("method") == m, 1)) / F.count("*"), 4)
    return records(spark, sf).groupBy("strategy").agg(share("a").alias("pct_a"), share("b").alias("pct_b"), F.array_join(F.array_sort(F.collect_set("graph")), ",").alias("graphs"))


@query("rejudge", f"WITH {RECORDS_SQL} SELECT qid, CASE WHEN rows = 0 AND qid % 2 = 0 THEN true ELSE ea END AS ea FROM records")
def rejudge(spark, sf):
    r = records(spark, sf)
    return E.rejudged(r, r.where("qid % 2 = 0").select("qid", F.lit(True).alias("ea")), F.col("rows") == 0).select("qid", "ea")


@query("pooled_report", f"WITH {RECORDS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY graph, strategy ORDER BY stamp DESC, qid) AS n FROM records) SELECT strategy, count(*) AS graphs, round(avg(psjs), 6) AS psjs FROM t WHERE n = 1 AND qid % 10 <> 0 GROUP BY 1")
def pooled_report(spark, sf):
    newest = E.latest(records(spark, sf).select("graph", "strategy", "stamp", "qid", "psjs"), ["graph", "strategy"])
    return newest.where("qid % 10 <> 0").groupBy("strategy").agg(F.count("*").alias("graphs"), F.round(F.avg("psjs"), 6).alias("psjs"))


@query("grounding_probe", f"WITH {MENTIONS_SQL} SELECT qid, phrase, CASE WHEN lower(phrase) = lower(qid) THEN 'exact_ci' WHEN damerau_levenshtein(phrase, qid) <= 2 THEN 'edit_distance' WHEN contains(lower(qid), lower(phrase)) THEN 'substring' ELSE 'semantic' END AS class FROM mentions")
def grounding_probe(spark, sf):
    return mentions(spark, sf).select("qid", "phrase", E.grounding_class(F.col("phrase"), F.col("qid")).alias("class"))


@query("grouping_sets", f"WITH {RECORDS_SQL} SELECT strategy, bucket, count(*) AS n FROM records GROUP BY ROLLUP (strategy, bucket)")
def grouping_sets(spark, sf):
    return records(spark, sf).rollup("strategy", "bucket").agg(F.count("*").alias("n"))


@query("set_operations", "SELECT n FROM (SELECT p_size AS n FROM part INTERSECT SELECT n_nationkey FROM nation) UNION ALL (SELECT p_size FROM part EXCEPT ALL SELECT n_nationkey FROM nation)")
def set_operations(spark, sf):
    t = tables(spark, sf)
    a, b = t("part").select(F.col("p_size").alias("n")), t("nation").select(F.col("n_nationkey").alias("n"))
    return a.intersect(b).union(a.exceptAll(b))


# statistics
@query("wilson_ci", "WITH c AS (SELECT brand, k, n, k / n AS p FROM (SELECT p_brand AS brand, count(*) FILTER (p_size > 25) AS k, count(*) AS n FROM part GROUP BY 1)) SELECT brand, k, n, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM c")
def wilson_ci(spark, sf):
    c = tables(spark, sf)("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.when(F.col("p_size") > 25, 1)).alias("k"), F.count("*").alias("n"))
    ci = T.wilson(F.col("k"), F.col("n"))
    return c.select("brand", "k", "n", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query("cohen_kappa", f"""WITH {RATINGS_SQL}, p AS (SELECT x.annotator AS a, y.annotator AS b, x.label AS la, y.label AS lb FROM ratings x JOIN ratings y ON x.item = y.item AND x.annotator < y.annotator WHERE x.label IS NOT NULL AND y.label IS NOT NULL),
s AS (SELECT a, b, count(*) AS n, avg((la = lb)::INT) AS po, avg((la = '1')::INT) * avg((lb = '1')::INT) + avg((la = '0')::INT) * avg((lb = '0')::INT) AS pe FROM p GROUP BY 1, 2) SELECT a, b, n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM s""")
def cohen_kappa(spark, sf):
    return T.cohen_kappa(ratings(spark, sf))


AGREEMENT_SQL = f"WITH {RATINGS_SQL}, c AS (SELECT item, label, count(*) AS c FROM ratings WHERE label IS NOT NULL GROUP BY 1, 2), m AS (SELECT item, sum(c) AS m FROM c GROUP BY 1 HAVING sum(c) >= 2), k AS (SELECT * FROM c JOIN m USING (item))"


@query("gwet_ac1", AGREEMENT_SQL + """, i AS (SELECT item, sum(c * (c - 1)) / max(m * (m - 1)) AS a FROM k GROUP BY 1), o AS (SELECT count(*) AS items, avg(a) AS pa FROM i),
q AS (SELECT label, sum(c / m) / (SELECT items FROM o) AS q FROM k GROUP BY 1), e AS (SELECT sum(q * (1 - q)) / (count(*) - 1) AS pe FROM q) SELECT items, round((pa - pe) / (1 - pe), 6) AS ac1 FROM o, e""")
def gwet_ac1(spark, sf):
    return T.gwet_ac1(ratings(spark, sf))


@query("krippendorff_alpha", AGREEMENT_SQL + """, l AS (SELECT label, sum(c) AS n, sum(c * (c - 1) / (m - 1)) AS o FROM k GROUP BY 1), s AS (SELECT sum(n) AS n, sum(o) AS o, sum(n * (n - 1)) AS e FROM l)
SELECT CAST(n AS BIGINT) AS n, round(1 - (1 - o / n) / (1 - e / (n * (n - 1))), 6) AS alpha FROM s""")
def krippendorff_alpha(spark, sf):
    return T.krippendorff_alpha(ratings(spark, sf))


@query("verdict_collapse", f"""WITH {RATINGS_SQL}, r AS (SELECT item, CASE WHEN item % 13 = 0 AND annotator = 'x' THEN 'source_error' WHEN label = '1' THEN 'valid' WHEN label = '0' THEN 'invalid' END AS label FROM ratings)
SELECT item, CASE WHEN bool_or(coalesce(label = 'source_error', false)) THEN 'source_error' WHEN min(label) = max(label) AND count(label) >= 2 THEN min(label) ELSE 'pending' END AS verdict FROM r GROUP BY 1""")
def verdict_collapse(spark, sf):
    label = F.when((F.col("item") % 13 == 0) & (F.col("annotator") == "x"), "source_error").when(F.col("label") == "1", "valid").when(F.col("label") == "0", "invalid")
    return T.collapsed_verdicts(ratings(spark, sf).withColumn("label", label).withColumn("calibration", F.lit(False)))


@query("stratified_report", f"""WITH {RECORDS_SQL}, u AS (SELECT 'ALL' AS stratum, 'ALL' AS value, coalesce(ea, false) AS g FROM records UNION ALL SELECT 'strategy', strategy, coalesce(ea, false) FROM records UNION ALL SELECT 'method', method, coalesce(ea, false) FROM records UNION ALL SELECT 'strategy*method', strategy || '/' || method, coalesce(ea, false) FROM records)
SELECT stratum, value, count(*) AS n, CAST(sum(g::INT) AS BIGINT) AS k FROM u GROUP BY 1, 2""")
def stratified_report(spark, sf):
    return T.stratified(records(spark, sf), ["strategy", "method"], F.coalesce("ea", F.lit(False))).select("stratum", "value", "n", "k")


@query("decision_table", """WITH v AS (SELECT ['valid', 'source_error', 'invalid', 'pending', NULL][o_custkey % 5 + 1] AS verdict FROM orders)
SELECT verdict, CASE verdict WHEN 'valid' THEN 'keep' WHEN 'source_error' THEN 'remove' WHEN 'invalid' THEN 'revert' ELSE 'remove_pending' END AS strict, CASE verdict WHEN 'source_error' THEN 'remove' WHEN 'invalid' THEN 'revert' ELSE 'keep' END AS lenient, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def decision_table(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("valid", "source_error", "invalid", "pending", None)])
    rows = tables(spark, sf)("orders").select(F.get(kinds, (F.col("o_custkey") % 5).cast("int")).alias("verdict"))
    return rows.groupBy("verdict", T.decision(F.col("verdict")).alias("strict"), T.decision(F.col("verdict"), "lenient").alias("lenient")).agg(F.count("*").alias("n"))


@query("adjudication_wide", f"WITH {RATINGS_SQL} SELECT item, string_agg(annotator || '=' || coalesce(label, '-'), '; ' ORDER BY annotator) AS votes FROM ratings GROUP BY 1 HAVING count(DISTINCT label) > 1 OR count(label) < count(*)")
def adjudication_wide(spark, sf):
    return T.adjudication_worklist(ratings(spark, sf))


@query("removed_rows", f"WITH {RECORDS_SQL} SELECT qid FROM records WHERE error LIKE 'gold%'")
def removed_rows(spark, sf):
    r = records(spark, sf)
    actions = r.select("qid", F.when(F.col("error").startswith("gold"), "remove:gold").otherwise("keep").alias("action"))
    return r.join(actions.where(F.col("action").startswith("remove")), "qid", "left_semi").select("qid")


# sampling
@query("stratified_sample", f"WITH {RECORDS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY strategy, bucket ORDER BY md5('42|' || qid), qid) AS n FROM records) SELECT strategy, bucket, qid FROM s WHERE n <= 5")
def stratified_sample(spark, sf):
    return S.stratified_sample(records(spark, sf).select("strategy", "bucket", "qid"), ["strategy", "bucket"], "qid", 5)


@query("proportional_sample", f"WITH {RECORDS_SQL}, c AS (SELECT strategy, count(*) AS k FROM records GROUP BY 1), s AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY md5('42|' || qid), qid) AS n FROM records) SELECT strategy, qid FROM s JOIN c USING (strategy) WHERE n <= greatest(1, CAST(round(50.0::DOUBLE * k / (SELECT count(*) FROM records)) AS INTEGER))")
def proportional_sample(spark, sf):
    return S.proportional_sample(records(spark, sf).select("strategy", "qid"), "strategy", "qid", 50)


@query("round_robin", f"WITH {RECORDS_SQL} SELECT strategy, qid, CAST((row_number() OVER (PARTITION BY strategy ORDER BY qid) - 1) % 4 AS INTEGER) AS reviewer FROM records")
def round_robin(spark, sf):
    return S.round_robin(records(spark, sf), "strategy", "qid", 4)


@query("rotating_pairs", f"WITH {RECORDS_SQL}, p AS (SELECT strategy, qid, (row_number() OVER (PARTITION BY strategy ORDER BY qid) - 1) % 3 AS i FROM records) SELECT strategy, qid, ['a', 'a', 'b'][i + 1] AS first, ['b', 'c', 'c'][i + 1] AS second FROM p")
def rotating_pairs(spark, sf):
    return S.rotating_pairs(records(spark, sf), "strategy", "qid", ["a", "b", "c"])


@query("mixture_rebalance", f"WITH {RECORDS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY qid) AS n FROM records WHERE bucket IN ('hard', 'easy', 'medium')), c AS (SELECT *, row_number() OVER (ORDER BY CASE bucket WHEN 'hard' THEN 0 WHEN 'easy' THEN 1 ELSE 2 END, n) AS m FROM d WHERE n <= CASE bucket WHEN 'hard' THEN 40 WHEN 'easy' THEN 30 ELSE 50 END) SELECT bucket, qid FROM c WHERE m <= 90")
def mixture_rebalance(spark, sf):
    return S.rebalanced(records(spark, sf).select("bucket", "qid"), "bucket", "qid", {"hard": 40, "easy": 30, "medium": 50}, 90)


@query("strategy_mix", f"WITH {RECORDS_SQL} SELECT strategy, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, abs(count(*) / sum(count(*)) OVER () - CASE strategy WHEN 'O' THEN 0.5 WHEN 'F' THEN 0.4 ELSE 0.1 END) > 0.05 AS flagged FROM records GROUP BY 1")
def strategy_mix(spark, sf):
    return S.distribution(records(spark, sf), "strategy", {"O": 0.5, "F": 0.4, "P": 0.1})


@query("quota_sampler")
def quota_sampler(spark, sf):
    r = records(spark, sf).select("graph", "qid", F.when(F.col("qid") % 2 == 0, F.array(F.lit("typo"), F.lit("casing"))).otherwise(F.array(F.lit("partial"), F.lit("casing"))).alias("eligible"))
    return S.quota_choices(r, "graph", "qid", "eligible", {"typo": 0.4, "partial": 0.4, "casing": 0.2}, {"casing": 0.1})


# augmentation
@query("perturbations")
def perturbations(spark, sf):
    return A.perturbed(part_values(spark, sf))


EDITS_SQL = f"""WITH {MENTIONS_SQL}, edits AS (SELECT qid AS value, 'partial' AS strategy, string_split(qid, ' ')[1] AS mention FROM mentions UNION ALL SELECT value, 'casing', upper(value) FROM vals UNION ALL
 SELECT a.value, 'alias', (SELECT min(value) FROM vals) FROM vals a)"""


def edits(spark, sf):
    v = part_values(spark, sf)
    least = v.agg(F.min("value").alias("mention"))
    return (
        v.select("label", "prop", "value", F.lit("partial").alias("strategy"), F.get(F.split("value", " "), F.lit(0)).alias("mention"))
        .union(v.select("label", "prop", "value", F.lit("casing"), F.upper("value"))).union(v.crossJoin(F.broadcast(least)).select("label", "prop", "value", F.lit("alias"), "mention"))
    )


@query("validity_reasons", EDITS_SQL + """ SELECT value, strategy, mention, CASE WHEN EXISTS (SELECT 1 FROM vals v WHERE lower(v.value) = lower(e.mention) AND lower(v.value) <> lower(e.value)) THEN 'collision'
 WHEN strategy = 'partial' AND EXISTS (SELECT 1 FROM vals v WHERE contains(lower(v.value), lower(e.mention)) AND lower(v.value) <> lower(e.value)) THEN 'not_unique' END AS reason FROM edits e""")
def validity_reasons(spark, sf):
    return A.validity(edits(spark, sf), part_values(spark, sf)).select("value", "strategy", "mention", "reason")


@query("validity_backfill", EDITS_SQL + """ SELECT value, mention, strategy, CASE WHEN strategy = 'casing' THEN 'ok' WHEN EXISTS (SELECT 1 FROM vals v WHERE lower(v.value) = lower(e.mention) AND lower(v.value) <> lower(e.value)) OR
 (strategy = 'partial' AND EXISTS (SELECT 1 FROM vals v WHERE contains(lower(v.value), lower(e.mention)) AND lower(v.value) <> lower(e.value))) THEN 'fail' ELSE 'ok' END AS state FROM edits e""")
def validity_backfill(spark, sf):
    return A.backfilled_validity(edits(spark, sf), part_values(spark, sf))


@query("reason_counts", EDITS_SQL + """, r AS (SELECT strategy, CASE WHEN EXISTS (SELECT 1 FROM vals v WHERE lower(v.value) = lower(e.mention) AND lower(v.value) <> lower(e.value)) THEN 'collision'
 WHEN strategy = 'partial' AND EXISTS (SELECT 1 FROM vals v WHERE contains(lower(v.value), lower(e.mention)) AND lower(v.value) <> lower(e.value)) THEN 'not_unique' END AS reason FROM edits e)
SELECT strategy || ':' || reason AS reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def reason_counts(spark, sf):
    return A.reasons(A.validity(edits(spark, sf), part_values(spark, sf)))


@query("distinctive_token", f"""WITH {MENTIONS_SQL}, t AS (SELECT DISTINCT value, unnest(string_split(lower(value), ' ')) AS token FROM vals), d AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT value, token, row_number() OVER (PARTITION BY value ORDER BY df, -length(token), token) AS n FROM t JOIN d USING (token)) SELECT value, token FROM r WHERE n = 1""")
def distinctive_token(spark, sf):
    return A.distinctive_token(part_values(spark, sf)).select("value", "token")


@query("applicability_ceiling", f"""WITH {RECORDS_SQL}, c AS (SELECT graph, CASE WHEN strategy = 'F' THEN 'alias' ELSE strategy END AS strategy, avg(CAST(coalesce(ea, false) AS INTEGER)) AS attested, avg(psjs) AS probe, count(psjs) / count(*) AS scored, count(bucket) / count(*) AS share FROM records GROUP BY 1, 2)
SELECT graph, strategy, round(CASE WHEN starts_with(graph, '1') AND strategy = 'alias' THEN 0 ELSE least(1, attested + scored * probe * share) END, 6) AS ceiling FROM c""")
def applicability_ceiling(spark, sf):
    share = lambda c: F.count(c) / F.count("*")
    named = records(spark, sf).withColumn("strategy", F.when(F.col("strategy") == "F", "alias").otherwise(F.col("strategy")))
    cells = named.groupBy("graph", "strategy").agg(F.avg(F.coalesce("ea", F.lit(False)).cast("int")).alias("attested"), F.avg("psjs").alias("probe_rate"), share("psjs").alias("precision"), share("bucket").alias("pool_share"))
    return A.applicability_ceiling(cells.withColumn("synthetic", F.col("graph").startswith("1")))


@query("leak_class", rf"""WITH {VALUES_SQL}, v AS (SELECT value, lower(value) AS low, CASE length(value) % 4 WHEN 0 THEN 'ok_backfilled' WHEN 1 THEN 'failed' ELSE 'unresolved' END AS result FROM vals),
c AS (SELECT value, result, CASE WHEN regexp_matches(low, '{A.MONTHS}') OR regexp_matches(low, '{A.ORDINAL_DATE}') OR regexp_matches(value, '{A.ISO_DATE}') THEN 'A_date_datetime_leak'
 WHEN regexp_matches(value, '{A.NUMBERS}') OR regexp_matches(low, '{A.DESCRIPTOR}') OR regexp_matches(value, '{A.LONG_NUMBER}') THEN 'B_id_descriptor_leak' WHEN list_contains({list(A.SCHEMA_WORDS)}, low) THEN 'C_schema_or_common_noun'
 WHEN regexp_matches(low, '{A.DOMAIN}') OR low = 'com' THEN 'D_fragment_literal' ELSE 'E_unmatched_maybe_format' END AS class FROM v)
SELECT value, class, CASE WHEN result = 'unresolved' THEN CASE WHEN class[1] = 'E' THEN 'hold_E' ELSE 'drop' END WHEN result = 'ok_backfilled' THEN 'flip_ok' ELSE 'none' END AS action FROM c""")
def leak_class(spark, sf):
    n = F.length("value") % 4
    rows = values_of_all_kinds(spark, sf).withColumn("result", F.when(n == 0, "ok_backfilled").when(n == 1, "failed").otherwise("unresolved"))
    c = A.leak_class(F.col("value"))
    return rows.select("value", c.alias("class"), A.leak_action(F.col("result"), c).alias("action"))


@query("entity_spans")
def entity_spans(spark, sf):
    m = mentions(spark, sf).select("qid", F.concat(F.lit("Which orders contain the "), F.col("qid"), F.lit(" part?")).alias("question"), F.array(F.col("qid"), F.get(F.split("qid", " "), F.lit(0))).alias("literals"))
    return A.entity_spans(m)


@query("replay_repair")
def replay_repair(spark, sf):
    m = mentions(spark, sf)
    text = F.concat(F.lit("find "), F.col("qid"))
    return A.repaired(m.select(text.alias("original"), F.col("qid").alias("value"), F.col("phrase").alias("mention"), F.when(F.length("qid") % 2 == 0, F.concat(F.lit("find "), F.col("phrase"))).otherwise(text).alias("text")))


@query("typo_to_partial")
def typo_to_partial(spark, sf):
    v = part_values(spark, sf)
    return A.typo_to_partial(A.perturbed(v).where("strategy = 'typo'"), v)
