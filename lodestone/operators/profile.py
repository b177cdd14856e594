"""Schema and catalog profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import GraphCatalog


def node_profile(catalog: GraphCatalog, samples: int = 3, width: int = 42) -> DataFrame:
    """(label, prop, type, nodes, non_null, fill_pct, samples): one pass for each label."""
    out = []
    for label, node in catalog.nodes.items():
        frame = catalog.node_frame(label)
        props = list(node.props)
        text = lambda p: F.col(p).cast("string") if not isinstance(frame.schema[p].dataType, T.ArrayType) else F.array_join(p, ",")  # noqa: B023, E731
        aggs = [F.count("*").alias("nodes"), *[F.count(p).alias(f"n_{p}") for p in props]]
        aggs += [F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("_id"), F.lit(64)) == 0, text(p)))), 1, samples).alias(f"s_{p}") for p in props]
        one = frame.agg(*aggs)
        cut = lambda c: F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)
        rows = F.array(*[
            F.struct(F.lit(p).alias("prop"), F.lit(frame.schema[p].dataType.simpleString()).alias("type"), F.col(f"n_{p}").alias("non_null"), F.array_join(F.transform(f"s_{p}", cut), "|").alias("samples"))
            for p in props
        ])
        out.append(one.select(F.lit(label).alias("label"), "nodes", F.explode(rows).alias("p")).select("label", "p.prop", "p.type", "nodes", "p.non_null", F.round(100 * F.try_divide(F.col("p.non_null"), F.col("nodes")), 1).alias("fill_pct"), "p.samples"))
    return reduce(lambda a, b: a.unionByName(b), out)


def rel_profile(catalog: GraphCatalog) -> DataFrame:
    """(type, source, target, prop, edges, non_null) for each declared triple; a triple
    without properties has one row with a null prop."""
    out = []
    for e in catalog.edges:
        frame = catalog.edge_frame(e)
        one = frame.agg(F.count("*").alias("edges"), *[F.count(p).alias(f"n_{p}") for p in e.props])
        rows = [F.struct(F.lit(p).alias("prop"), F.col(f"n_{p}").alias("non_null")) for p in e.props] or [F.struct(F.lit(None).cast("string").alias("prop"), F.lit(0).cast("long").alias("non_null"))]
        out.append(one.select(F.lit(e.type).alias("type"), F.lit(e.source).alias("source"), F.lit(e.target).alias("target"), "edges", F.explode(F.array(*rows)).alias("p")).select("type", "source", "target", "p.prop", "edges", "p.non_null"))
    return reduce(lambda a, b: a.unionByName(b), out)


def topology(catalog: GraphCatalog) -> DataFrame:
    """Declared triples that have an edge."""
    found = [catalog.edge_frame(e).limit(1).select(F.lit(e.source).alias("source"), F.lit(e.type).alias("type"), F.lit(e.target).alias("target")) for e in catalog.edges]
    return reduce(lambda a, b: a.union(b), found).distinct()


def average_length(catalog: GraphCatalog, label: str, prop: str, most: int = 200) -> DataFrame:
    """Of the first nodes by id."""
    return catalog.node_frame(label).orderBy("_id").limit(most).agg(F.round(F.avg(F.length(F.col(prop).cast("string"))), 6).alias("avg_len"))


#: Properties by name that are embedded or never are.
ALWAYS, NEVER = ("name", "title", "description", "summary", "text"), ("id", "uuid", "url", "date", "time", "code")


def embeddable(prop: Column, type_: Column, avg_len: Column, distinct: Column) -> Column:
    """By name first, then by type, then by shape."""
    p = F.lower(prop)
    return (
        F.when(type_ != "string", False).when(p.isin(*ALWAYS), True).when(p.isin(*NEVER) | p.rlike("_id$|_url$|date$"), False)
        .when(avg_len >= 20, True).otherwise((avg_len >= 4) & (distinct > 30))
    )


def centrality(catalog: GraphCatalog) -> DataFrame:
    """(label, k): how many declared triples start at a label."""
    return catalog.spark.createDataFrame(catalog.triples(), "label string, type string, target string").groupBy("label").agg(F.count("*").alias("k"))


def ghost_labels(catalog: GraphCatalog) -> DataFrame:
    counts = [catalog.node_frame(x).agg(F.count("*").alias("nodes")).select(F.lit(x).alias("label"), "nodes") for x in catalog.labels()]
    return reduce(lambda a, b: a.union(b), counts).where("nodes = 0")


def closed_sets(values: DataFrame, most: int = 30) -> DataFrame:
    """Fields with few distinct values."""
    return values.groupBy("label", "prop").agg(F.count_distinct("value").alias("k")).where(F.col("k") <= most)


def schema_block(catalog: GraphCatalog) -> DataFrame:
    """(label, lines): the triples that start at each label, most central labels first."""
    triples = catalog.spark.createDataFrame(catalog.triples(), "label string, type string, target string")
    line = F.format_string("(%s)-[:%s]->(%s)", "label", "type", "target")
    rows = triples.groupBy("label").agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"))
    return rows.orderBy(F.desc("k"), "label")


def property_class(prop: Column, declared: Column) -> Column:
    """id, name, description or other; what is declared first, then the name."""
    p = F.lower(prop)
    return (
        F.when(declared.isin("id", "name", "description"), declared).when(p.isin("id", "key", "uuid", "code") | p.rlike("_id$|key$"), "id")
        .when(p.isin("name", "title", "label") | p.rlike("name$|title$"), "name").when(p.isin("description", "summary", "text", "comment", "abstract"), "description").otherwise("other")
    )


def id_property(label: Column, declared: Column) -> Column:
    return F.coalesce(declared, F.when(F.lower(label).rlike("movie|film|book|song|album|article|paper"), "title").otherwise("name"))


def relation_phrases(catalog: GraphCatalog, most: int = 6) -> DataFrame:
    """(label, phrases): relations at either end, distinct, the first in catalog order."""
    from pyspark.sql import Window

    rows = [(i, a, r, b) for i, (a, r, b) in enumerate(catalog.triples())]
    triples = catalog.spark.createDataFrame(rows, "i int, a string, r string, b string")
    phrase = F.concat_ws(" ", "a", F.lower(F.regexp_replace("r", "_", " ")), "b")
    ends = triples.select("i", phrase.alias("phrase"), F.explode(F.array_distinct(F.array("a", "b"))).alias("label"))
    first = ends.groupBy("label", "phrase").agg(F.min("i").alias("i"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("i"))
    kept = first.withColumn("n", place).where(F.col("n") <= most)
    return kept.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]), "; ").alias("phrases"))


def connectivity(catalog: GraphCatalog) -> DataFrame:
    triples = catalog.spark.createDataFrame(catalog.triples(), "a string, type string, b string")
    return triples.select("type", F.explode(F.array("a", "b")).alias("label")).groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def edge_properties(catalog: GraphCatalog) -> DataFrame:
    rows = sorted({(e.type, p) for e in catalog.edges for p in e.props})
    return catalog.spark.createDataFrame(rows, "type string, prop string")


def embedding_columns(frame: DataFrame) -> list[str]:
    """Columns that hold vectors."""
    vector = lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))
    return [f.name for f in frame.schema if vector(f.dataType) or f.name.endswith("_embedding")]


def few_shots(catalog: GraphCatalog, most: int = 5) -> list[tuple[str, str]]:
    """(question, query) by template from the declared triples."""
    out = []
    for a, r, b in catalog.triples()[:most]:
        prop = next((p for p in catalog.nodes[b].props if p in ("name", "title")), None)
        if prop:
            out.append((f"How many {a} are linked to each {b} by {r}?", f"MATCH (a:{a})-[:{r}]->(b:{b}) RETURN b.{prop} AS {prop}, count(a) AS n ORDER BY n DESC"))
    return out
