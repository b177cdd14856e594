"""Registered queries in the graph language: patterns, projections, aggregates, sets."""

from __future__ import annotations

from .registry import graph_query

ASIA = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"

graph_query("flagship_asia_customers", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region {name:'ASIA'}) WITH DISTINCT c RETURN count(c) AS n",
            f"SELECT count(DISTINCT c_custkey) AS n FROM {ASIA} WHERE r_name = 'ASIA'")
graph_query("node_scan", "MATCH (s:Supplier) RETURN s.name AS name, s.acctbal AS acctbal", "SELECT s_name AS name, s_acctbal AS acctbal FROM supplier")
graph_query("all_node_scan", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS k",
            """SELECT 'Region' AS label, count(*) AS k FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
            UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders""")
graph_query("rel_scan", "MATCH ()-[r:CONTAINS]->() RETURN r.returnflag AS flag, count(*) AS k", "SELECT l_returnflag AS flag, count(*) AS k FROM lineitem GROUP BY 1")
graph_query("match_1hop", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.name AS customer, n.name AS nation",
            "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
graph_query("match_reverse", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, n.name AS nation",
            "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey")
graph_query("match_undirected", "MATCH (n:Nation)-[:LOCATED_IN]-(x) RETURN n.name AS nation, labels(x)[0] AS label, count(*) AS k",
            """SELECT n_name AS nation, label, count(*) AS k FROM nation JOIN (SELECT c_nationkey AS nk, 'Customer' AS label FROM customer
            UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) ON nk = n_nationkey GROUP BY 1, 2""")
graph_query("match_2hop", "MATCH (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS k",
            f"SELECT r_name AS region, count(*) AS k FROM {ASIA} GROUP BY 1")
graph_query("match_3hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS orders, round(sum(o.totalprice), 2) AS total",
            f"SELECT r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {ASIA} JOIN orders ON o_custkey = c_custkey GROUP BY 1")
graph_query("match_cartesian", "MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS a, b.name AS b",
            "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name")
graph_query("match_shared_variable", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS nation, count(*) AS pairs",
            "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
graph_query("match_second", "MATCH (r:Region {name:'EUROPE'})<-[:IN_REGION]-(n:Nation) WITH n MATCH (n)<-[:BASED_IN]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier",
            "SELECT n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'EUROPE'")
graph_query("propmap_filter", "MATCH (o:Order {status:'F', priority:'1-URGENT'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
graph_query("rel_propmap", "MATCH (:Order)-[l:CONTAINS {returnflag:'R', linestatus:'F'}]->(p:Part) RETURN p.brand AS brand, count(*) AS k",
            "SELECT p_brand AS brand, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1")
graph_query("inline_where", "MATCH (c:Customer WHERE c.acctbal > 5000)-[:LIVES_IN]->(n:Nation WHERE n.name ENDS WITH '1') RETURN n.name AS nation, count(*) AS k",
            "SELECT n_name AS nation, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_name LIKE '%1' GROUP BY 1")
graph_query("varlen_1_3", "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..3]->(x) RETURN labels(x)[0] AS label, count(*) AS k",
            f"SELECT 'Nation' AS label, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Region', count(*) FROM {ASIA}")
graph_query("varlen_unbounded", "MATCH (r:Region {name:'ASIA'})<-[:IN_REGION|LIVES_IN*]-(x) RETURN labels(x)[0] AS label, count(*) AS k",
            """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS s, 'R' || n_regionkey AS t, 'Nation' AS l FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'Customer' FROM customer),
            w AS (SELECT s, l FROM e JOIN region ON t = 'R' || r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT e.s, e.l FROM w JOIN e ON e.t = w.s)
            SELECT l AS label, count(*) AS k FROM w GROUP BY 1""")
graph_query("shortest_path", "MATCH (a:Nation {name:'NATION_1'}), (b:Nation), p = shortestPath((a)-[:IN_REGION*..4]-(b)) WHERE b.name <> 'NATION_1' RETURN b.name AS nation, length(p) AS d",
            "SELECT b.n_name AS nation, CAST(2 AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_name = 'NATION_1'")
graph_query("all_shortest_paths", "MATCH (a:Customer), (b:Customer), p = allShortestPaths((a)-[:LIVES_IN*..2]-(b)) WHERE a.acctbal > 9500 AND b.acctbal > 9500 AND a.name < b.name RETURN a.name AS a, b.name AS b, length(p) AS d",
            "SELECT a.c_name AS a, b.c_name AS b, CAST(2 AS BIGINT) AS d FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_acctbal > 9500 AND b.c_acctbal > 9500 AND a.c_name < b.c_name")
graph_query("path_length", "MATCH p = (c:Customer)-[:LIVES_IN]->()-[:IN_REGION]->(r:Region {name:'AFRICA'}) RETURN length(p) AS d, count(*) AS k",
            f"SELECT CAST(2 AS BIGINT) AS d, count(*) AS k FROM {ASIA} WHERE r_name = 'AFRICA'")
graph_query("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.name AS name, count(o) AS orders",
            "SELECT c_name AS name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey, c_name")
graph_query("exists_semi", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' } RETURN c.name AS name",
            "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
graph_query("not_exists_anti", "MATCH (p:Part) WHERE NOT EXISTS { (p)<-[:CONTAINS {returnflag:'R', linenumber: 7}]-(:Order) } RETURN p.name AS name, p.size AS size",
            "SELECT p_name AS name, p_size AS size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber = 7)")
graph_query("pattern_predicate", "MATCH (n:Nation) WHERE (n)<-[:BASED_IN]-(:Supplier) AND NOT (n)-[:IN_REGION]->(:Region {name:'ASIA'}) RETURN n.name AS name",
            "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
graph_query("exists_or", "MATCH (n:Nation) WHERE n.name = 'NATION_0' OR EXISTS { (n)<-[:BASED_IN]-(:Supplier WHERE 1 = 1) } RETURN n.name AS name",
            "SELECT n_name AS name FROM nation WHERE n_name = 'NATION_0' OR n_nationkey IN (SELECT s_nationkey FROM supplier)")
graph_query("count_subquery", "MATCH (n:Nation) RETURN n.name AS name, COUNT { (n)<-[:LIVES_IN]-(:Customer) } AS customers",
            "SELECT n_name AS name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
graph_query("collect_subquery", "MATCH (r:Region) WITH r.name AS region, COLLECT { MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN n.name } AS names UNWIND names AS nation RETURN region, nation",
            "SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
graph_query("call_union_count", "CALL { MATCH (:Customer)-[:LIVES_IN]->(n:Nation) RETURN n UNION MATCH (:Supplier)-[:BASED_IN]->(n:Nation) RETURN n } RETURN count(n) AS n",
            "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
graph_query("call_correlated", "MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN count(n) AS nations } RETURN r.name AS region, nations",
            "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
graph_query("rel_unique_2hop", "MATCH (a:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Order) WHERE p.size = 1 RETURN p.name AS part, count(*) AS pairs",
            "SELECT p_name AS part, sum(k * (k - 1)) AS pairs FROM (SELECT p_partkey, p_name, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY 1, 2) GROUP BY 1 HAVING sum(k * (k - 1)) > 0".replace("sum(k * (k - 1)) AS", "CAST(sum(k * (k - 1)) AS BIGINT) AS"))
graph_query("with_distinct_count", "MATCH (o:Order)-[:CONTAINS]->(p:Part {size:5}) WITH DISTINCT o RETURN count(o) AS n", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 5")
graph_query("return_distinct", "MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.type AS type", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
graph_query("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS k WHERE k >= 15 RETURN c.name AS name, k",
            "SELECT c_name AS name, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) >= 15")
graph_query("with_chain", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, avg(c.acctbal) AS mean WITH n.name AS nation, mean WHERE mean > 4500 RETURN nation, round(mean, 4) AS mean",
            "SELECT n_name AS nation, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING avg(c_acctbal) > 4500")
graph_query("comparisons", "MATCH (o:Order) WHERE o.totalprice >= 100000 AND o.totalprice < 200000 AND o.status <> 'O' OR o.totalprice > 450000 RETURN o.status AS status, count(*) AS k",
            "SELECT o_orderstatus AS status, count(*) AS k FROM orders WHERE (o_totalprice >= 100000 AND o_totalprice < 200000 AND o_orderstatus <> 'O') OR o_totalprice > 450000 GROUP BY 1")
graph_query("in_list", "MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.mktsegment AS segment, count(*) AS k",
            "SELECT c_mktsegment AS segment, count(*) AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
graph_query("list_membership", "MATCH (p:Part) WHERE 'green' IN p.words OR 'red' IN p.words RETURN p.name AS name, count(*) AS k",
            "SELECT p_name AS name, count(*) AS k FROM part WHERE list_contains(string_split(p_name, ' '), 'green') OR list_contains(string_split(p_name, ' '), 'red') GROUP BY 1")
graph_query("string_predicates", "MATCH (p:Part) WHERE p.name CONTAINS 'e' AND p.brand STARTS WITH 'Brand' AND NOT p.type ENDS WITH 'X' AND p.name =~ '[a-z]+ [a-z]+' RETURN p.brand AS brand, count(*) AS k",
            "SELECT p_brand AS brand, count(*) AS k FROM part WHERE p_name LIKE '%e%' AND p_brand LIKE 'Brand%' AND p_type NOT LIKE '%X' AND regexp_full_match(p_name, '[a-z]+ [a-z]+') GROUP BY 1")
graph_query("null_tests", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c, o WHERE o IS NULL OR o.nothing IS NOT NULL RETURN count(*) AS n",
            "SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
graph_query("case_when", "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' ELSE 'large' END AS bin, count(*) AS k",
            "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bin, count(*) AS k FROM part GROUP BY 1")
graph_query("coalesce_prop", "MATCH (n) WHERE NOT n:Order RETURN coalesce(n.title, n.name, 'none') AS name, count(*) AS k",
            "SELECT name, count(*) AS k FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part) GROUP BY 1")
graph_query("unwind_list", "MATCH (p:Part) UNWIND p.words AS word RETURN word, count(*) AS k", "SELECT word, count(*) AS k FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
graph_query("list_comprehension", "MATCH (p:Part) WITH DISTINCT p.name AS name, p.words AS words RETURN name, size([w IN words WHERE size(w) > 4 | toUpper(w)]) AS long_words",
            "SELECT DISTINCT p_name AS name, CAST(len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)) AS BIGINT) AS long_words FROM part")
graph_query("unpivot_props", "MATCH (s:Supplier) UNWIND keys(s) AS k RETURN k AS prop, s[k] AS value, count(*) AS n",
            "SELECT 'name' AS prop, s_name AS value, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'acctbal', CAST(s_acctbal AS VARCHAR), count(*) FROM supplier GROUP BY s_acctbal")
graph_query("labels_types", "MATCH (a)-[r:LOCATED_IN|IN_REGION]->(b) RETURN head(labels(a)) AS f, type(r) AS t, head(labels(b)) AS g, count(*) AS k",
            "SELECT 'Customer' AS f, 'LOCATED_IN' AS t, 'Nation' AS g, count(*) AS k FROM customer UNION ALL SELECT 'Supplier', 'LOCATED_IN', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Nation', 'IN_REGION', 'Region', count(*) FROM nation")
graph_query("element_id", "MATCH (r:Region) RETURN elementId(r) AS eid, id(r) AS id", "SELECT 'Region:' || r_regionkey AS eid, CAST(r_regionkey AS BIGINT) AS id FROM region")
graph_query("parameters", "MATCH (n:Nation) WHERE n.name IN $names RETURN n.name AS name LIMIT $most", "SELECT n_name AS name FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')", params={"names": ["NATION_1", "NATION_2"], "most": 5})
graph_query("whole_node", "MATCH (r:Region) WITH r AS region MATCH (region)<-[:IN_REGION]-(n:Nation) WITH region, count(n) AS k RETURN region.name AS name, k", "SELECT r_name AS name, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
graph_query("group_by_count", "MATCH (c:Customer) RETURN c.mktsegment AS segment, count(*) AS k", "SELECT c_mktsegment AS segment, count(*) AS k FROM customer GROUP BY 1")
graph_query("count_distinct", "MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN count(*) AS rows, count(p) AS parts, count(DISTINCT p) AS distinct_parts, count(DISTINCT p.brand) AS brands",
            "SELECT count(*) AS rows, count(*) AS parts, count(DISTINCT l_partkey) AS distinct_parts, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey")
graph_query("sum_avg_min_max", "MATCH (o:Order) RETURN o.status AS status, round(sum(o.totalprice), 2) AS s, round(avg(o.totalprice), 4) AS a, min(o.totalprice) AS lo, max(o.totalprice) AS hi",
            "SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
graph_query("sum_of_nothing", "MATCH (o:Order) WHERE o.totalprice < 0 RETURN sum(o.totalprice) AS s, count(o) AS k, max(o.totalprice) AS m", "SELECT CAST(0 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS m")
graph_query("collect_distinct", "MATCH (p:Part) WITH p.brand AS brand, collect(DISTINCT p.size) AS sizes, collect(p.size) AS sizes_all RETURN brand, size(sizes) AS k, size(sizes_all) AS n",
            "SELECT p_brand AS brand, count(DISTINCT p_size) AS k, count(*) AS n FROM part GROUP BY 1")
graph_query("mixed_aggregate", "MATCH (o:Order) RETURN o.status AS status, 100 * count(*) / 7 + 1 AS x, round(max(o.totalprice) - min(o.totalprice), 2) AS width",
            "SELECT o_orderstatus AS status, 100 * count(*) // 7 + 1 AS x, round(max(o_totalprice) - min(o_totalprice), 2) AS width FROM orders GROUP BY 1")
graph_query("order_skip_limit", "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS acctbal ORDER BY c.acctbal DESC, c.name SKIP 5 LIMIT 10", "SELECT c_name AS name, c_acctbal AS acctbal FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10 OFFSET 5")
graph_query("order_nulls", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.acctbal > 9000 WITH n.name AS name, min(s.acctbal) AS low RETURN name, low ORDER BY low DESC, name LIMIT 20",
            "SELECT n_name AS name, min(s_acctbal) AS low FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1 ORDER BY low DESC NULLS FIRST, name LIMIT 20")
graph_query("argmax", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.name AS nation, count(c) AS k ORDER BY k DESC, nation LIMIT 1",
            "SELECT n_name AS nation, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY k DESC, nation LIMIT 1")
graph_query("topn", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, round(sum(o.totalprice), 2) AS total ORDER BY sum(o.totalprice) DESC, name LIMIT 10",
            "SELECT c_name AS name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, name LIMIT 10")
graph_query("revenue_by_nation", "MATCH (n:Nation)<-[:LIVES_IN]-(:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(:Part) WHERE o.status = 'F' RETURN n.name AS nation, round(sum(l.extendedprice * (1 - l.discount)), 2) AS revenue ORDER BY revenue DESC, nation LIMIT 10",
            """SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
            JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY revenue DESC, nation LIMIT 10""")
graph_query("union_distinct", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.acctbal > 9000 RETURN n.name AS name UNION MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) RETURN n.name AS name",
            "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
graph_query("union_all", "MATCH (c:Customer) RETURN c.acctbal AS bal UNION ALL MATCH (s:Supplier) RETURN s.acctbal AS bal", "SELECT c_acctbal AS bal FROM customer UNION ALL SELECT s_acctbal FROM supplier")
graph_query("conversions", "MATCH (p:Part) WITH DISTINCT p.brand AS brand RETURN brand, toInteger(right(brand, 1)) AS i, toInteger(brand) AS bad, toFloat('2.5') AS f, toString(7) AS t, left(brand, 3) AS l, substring(brand, 1, 2) AS s",
            "SELECT DISTINCT p_brand AS brand, TRY_CAST(right(p_brand, 1) AS BIGINT) AS i, CAST(NULL AS BIGINT) AS bad, CAST(2.5 AS DOUBLE) AS f, '7' AS t, left(p_brand, 3) AS l, substr(p_brand, 2, 2) AS s FROM part")
graph_query("temporal", "MATCH (o:Order) RETURN o.orderdate.year AS y, count(*) AS k, max(duration.inSeconds(o.orderdate, datetime('2000-01-01')).seconds) AS s",
            "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS k, max(CAST(epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate) AS BIGINT)) AS s FROM orders GROUP BY 1")
graph_query("point_distance", "UNWIND [[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]] AS c RETURN c[0] AS x, point.distance(point({x: c[0], y: c[1]}), point({x: 0.0, y: 0.0})) AS d", "SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (3.0, 5.0), (6.0, 10.0)) t(x, d)")
graph_query("list_functions", "UNWIND range(1, 4) AS i WITH i, range(0, i) AS xs RETURN i, head(xs) AS h, last(xs) AS l, size(tail(xs)) AS t, xs[-1] AS e, size(xs[1..3]) AS s",
            "SELECT * FROM (VALUES (1, 0, 1, 1::BIGINT, 1, 1::BIGINT), (2, 0, 2, 2, 2, 2), (3, 0, 3, 3, 3, 2), (4, 0, 4, 4, 4, 2)) t(i, h, l, t, e, s)")
graph_query("event_users", "MATCH (u:User)-[:DID]->(e:Event {kind:'purchase'}) WITH u, count(e) AS k, sum(e.value) AS v WHERE k > 2 RETURN u.key AS user, k, round(v, 4) AS v",
            "SELECT user_id AS user, count(*) AS k, round(sum(value), 4) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 2", graph="event")
