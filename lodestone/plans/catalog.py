"""A property graph as DataFrames: label -> nodes, relationship type -> edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class NodeSource:
    """Nodes of a label: a frame, its key column, and property -> expression."""

    label: str
    frame: DataFrame
    key: str
    props: dict[str, Column]


@dataclass
class EdgeSource:
    """Edges of one (type, from, to): a frame with key expressions of both ends and of the
    edge itself. A type may have several."""

    type: str
    source: str
    target: str
    frame: DataFrame
    src: Column
    dst: Column
    eid: Column
    props: dict[str, Column] = field(default_factory=dict)


class GraphCatalog:
    def __init__(self, spark: SparkSession, nodes: list[NodeSource], edges: list[EdgeSource]):
        self.spark = spark
        self.nodes = {n.label: n for n in nodes}
        self.edges = edges
        for e in edges:
            if e.source not in self.nodes or e.target not in self.nodes:
                raise ValueError(f"{e.type} joins a label that is not declared")

    # schema
    def labels(self) -> list[str]:
        return list(self.nodes)

    def types(self) -> list[str]:
        return list(dict.fromkeys(e.type for e in self.edges))

    def triples(self) -> list[tuple[str, str, str]]:
        return [(e.source, e.type, e.target) for e in self.edges]

    def props_of(self, labels: list[str]) -> list[str]:
        return list(dict.fromkeys(p for label in labels for p in self.nodes[label].props))

    def edge_props(self, types: list[str]) -> list[str]:
        return list(dict.fromkeys(p for e in self.edges if e.type in types for p in e.props))

    def node_frame(self, label: str) -> DataFrame:
        """The properties of a label as plain columns."""
        n = self.nodes[label]
        return n.frame.select(F.col(n.key).cast("long").alias("_id"), *[c.alias(p) for p, c in n.props.items()])

    def edge_frame(self, edge: EdgeSource) -> DataFrame:
        return edge.frame.select(edge.eid.cast("long").alias("_eid"), edge.src.cast("long").alias("_src"), edge.dst.cast("long").alias("_dst"), *[c.alias(p) for p, c in edge.props.items()])

    def node_types(self) -> dict[str, T.StructType]:
        return {label: self.node_frame(label).schema for label in self.nodes}

    # scans, with columns named after a variable
    def scan(self, labels: list[str], var: str) -> DataFrame:
        frames = []
        for label in labels:
            n = self.nodes[label]
            frames.append(n.frame.select(F.col(n.key).cast("long").alias(f"{var}__id"), F.lit(label).alias(f"{var}__label"), *[c.alias(f"{var}__{p}") for p, c in n.props.items()]))
        if not frames:
            return self.spark.range(0).select(F.col("id").alias(f"{var}__id"), F.lit("").alias(f"{var}__label"))
        return self._merged(frames)

    def edge_scan(self, edges: list[EdgeSource], var: str, reverse: bool = False) -> DataFrame:
        frames = []
        for e in edges:
            near, far = (e.dst, e.src) if reverse else (e.src, e.dst)
            near_label, far_label = (e.target, e.source) if reverse else (e.source, e.target)
            rows = e.frame.select(
                e.eid.cast("long").alias(f"{var}__id"), F.lit(e.type).alias(f"{var}__label"),
                near.cast("long").alias(f"{var}__near"), F.lit(near_label).alias(f"{var}__nearlabel"),
                far.cast("long").alias(f"{var}__far"), F.lit(far_label).alias(f"{var}__farlabel"),
                *[c.alias(f"{var}__{p}") for p, c in e.props.items()],
            )
            frames.append(rows)
        return self._merged(frames)

    def _merged(self, frames: list[DataFrame]) -> DataFrame:
        """Union by name; a property of two types becomes a string."""
        kinds: dict[str, set] = {}
        for f in frames:
            for c, k in f.dtypes:
                kinds.setdefault(c, set()).add(k)
        mixed = {c for c, k in kinds.items() if len(k) > 1}
        frames = [f.select(*[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in f.columns]) for f in frames]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """The star schema as a graph; lineitem has no key, so its edges' ids are hashes of
    whole rows."""
    t, c = tables(spark, sf_dir), F.col
    region, nation, customer, supplier, part, orders, line = map(t, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    nodes = [
        NodeSource("Region", region, "r_regionkey", {"name": c("r_name")}),
        NodeSource("Nation", nation, "n_nationkey", {"name": c("n_name")}),
        NodeSource("Customer", customer, "c_custkey", {"name": c("c_name"), "acctbal": c("c_acctbal"), "mktsegment": c("c_mktsegment")}),
        NodeSource("Supplier", supplier, "s_suppkey", {"name": c("s_name"), "acctbal": c("s_acctbal")}),
        NodeSource("Part", part, "p_partkey", {"name": c("p_name"), "brand": c("p_brand"), "type": c("p_type"), "size": c("p_size"), "retailprice": c("p_retailprice"), "words": F.split("p_name", " ")}),
        NodeSource("Order", orders, "o_orderkey", {"status": c("o_orderstatus"), "totalprice": c("o_totalprice"), "orderdate": c("o_orderdate"), "priority": c("o_orderpriority")}),
    ]
    row_id = F.xxhash64(*line.columns)
    facts = {"quantity": c("l_quantity"), "extendedprice": c("l_extendedprice"), "discount": c("l_discount"), "tax": c("l_tax"), "returnflag": c("l_returnflag"), "linestatus": c("l_linestatus"), "shipdate": c("l_shipdate"), "linenumber": c("l_linenumber")}
    pairs = line.select("l_suppkey", "l_partkey").distinct()
    edges = [
        EdgeSource("IN_REGION", "Nation", "Region", nation, c("n_nationkey"), c("n_regionkey"), c("n_nationkey")),
        EdgeSource("LIVES_IN", "Customer", "Nation", customer, c("c_custkey"), c("c_nationkey"), c("c_custkey")),
        EdgeSource("BASED_IN", "Supplier", "Nation", supplier, c("s_suppkey"), c("s_nationkey"), c("s_suppkey")),
        EdgeSource("LOCATED_IN", "Customer", "Nation", customer, c("c_custkey"), c("c_nationkey"), c("c_custkey") * 2),
        EdgeSource("LOCATED_IN", "Supplier", "Nation", supplier, c("s_suppkey"), c("s_nationkey"), c("s_suppkey") * 2 + 1),
        EdgeSource("PLACED", "Customer", "Order", orders, c("o_custkey"), c("o_orderkey"), c("o_orderkey"), {"at": c("o_orderdate")}),
        EdgeSource("CONTAINS", "Order", "Part", line, c("l_orderkey"), c("l_partkey"), row_id, facts),
        EdgeSource("SUPPLIED", "Supplier", "Order", line, c("l_suppkey"), c("l_orderkey"), row_id, {"quantity": c("l_quantity")}),
        EdgeSource("SUPPLIES", "Supplier", "Part", pairs, c("l_suppkey"), c("l_partkey"), F.xxhash64("l_suppkey", "l_partkey")),
    ]
    return GraphCatalog(spark, nodes, edges)


def event_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Users and their events."""
    events, c = tables(spark, sf_dir)("events"), F.col
    nodes = [
        NodeSource("User", events.select("user_id").distinct(), "user_id", {"key": c("user_id")}),
        NodeSource("Event", events, "event_id", {"kind": c("event_type"), "value": c("value"), "at": c("ts"), "props": c("props")}),
    ]
    return GraphCatalog(spark, nodes, [EdgeSource("DID", "User", "Event", events, c("user_id"), c("event_id"), c("event_id"))])
