"""Registered queries: record files, manifests, windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io as IO
from ..streaming import monitor
from .catalog import tables
from .registry import query


@query("example_aliases", "SELECT CAST(conv_id AS VARCHAR) AS qid, text AS question, role AS gold_cypher, CAST(NULL AS VARCHAR) AS graph FROM conversations")
def example_aliases(spark, sf):
    return IO.aliased(tables(spark, sf)("conversations").select(F.col("conv_id").alias("id"), "text", F.col("role").alias("query")))


@query("malformed_lines", "SELECT count(*) AS n, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS bad FROM orders")
def malformed_lines(spark, sf):
    """Lines as a file would hold them, every tenth cut short."""
    line = F.to_json(F.struct(F.col("o_orderkey").alias("qid")))
    text = tables(spark, sf)("orders").select(F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("line"))
    parsed = text.select(F.from_json("line", "qid bigint, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.agg(F.count("*").alias("n"), F.count("r._corrupt_record").alias("bad"))


@query("content_hash", """SELECT n_nationkey AS "key", sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation""")
def content_hash(spark, sf):
    return IO.manifest(tables(spark, sf)("nation").withColumn("key", F.col("n_nationkey")), "key", ["n_regionkey", "n_name"])


@query("manifest_states", "SELECT CASE WHEN n_nationkey < 3 THEN 'extra' WHEN n_nationkey > 20 THEN 'missing' WHEN n_nationkey = 10 THEN 'changed' ELSE 'ok' END AS state, count(*) AS n FROM nation GROUP BY 1")
def manifest_states(spark, sf):
    nation = tables(spark, sf)("nation")
    saved = IO.manifest(nation.where("n_nationkey >= 3").withColumn("n_name", F.when(F.col("n_nationkey") == 10, "x").otherwise(F.col("n_name"))), "n_nationkey", ["n_name", "n_regionkey"])
    return IO.verified(nation.where("n_nationkey <= 20"), saved, "n_nationkey", ["n_name", "n_regionkey"]).groupBy("state").agg(F.count("*").alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = monitor.event_windows(tables(spark, sf)("events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def event_sessions(spark, sf):
    return monitor.sessions(tables(spark, sf)("events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
