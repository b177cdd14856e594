"""Readers and writers of examples, records, alias tables, spreadsheets and manifests."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that an example's fields go by, the first that is there counts.
ALIASES = {
    "qid": ("qid", "id", "question_id", "idx"),
    "question": ("nl", "question", "nl_question", "text", "input"),
    "gold_cypher": ("gold_cypher", "cypher", "query", "target", "output"),
    "graph": ("graph", "database", "db", "db_id"),
}


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns by canonical names: of several aliases the first that isn't null."""
    have = set(df.columns)
    columns = []
    for name, options in aliases.items():
        found = [F.col(o).cast("string") for o in options if o in have]
        columns.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*columns)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON (a list, or an object whose ``data`` is one) or JSON lines."""
    multi = not path.endswith((".jsonl", ".ndjson"))
    df = spark.read.option("multiLine", multi).json(path)
    if "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        df = df.select(F.inline("data"))
    return aliased(df)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """With header; quoted fields may hold line ends; blank cells are missing."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of JSON-lines files; a folder is all its shards."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record"), parsed.where("_corrupt_record is not null").select("_corrupt_record")


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_alias_json(spark: SparkSession, path: str) -> DataFrame:
    """(value, alias) of JSON lines {name, aliases: [..]}."""
    df = spark.read.schema("name string, aliases array<string>").json(path)
    return df.select(F.col("name").alias("value"), F.explode("aliases").alias("alias")).where("alias <> value").distinct()


def read_alias_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(value, alias) of two tab-separated columns, in both directions."""
    df = spark.read.schema("value string, alias string").csv(path, sep="\t").where("value is not null and alias is not null")
    return df.union(df.select("alias", "value")).where("alias <> value").distinct()


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _first_sheet(z: zipfile.ZipFile, names: list[str]) -> str:
    """The part of the workbook's first sheet; without a workbook, the one of the least number."""
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"), None)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets.get(sheet.get(RELATION)) if sheet is not None else None
        if target:
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))


def xlsx_rows(content: bytes) -> list[list[str | None]]:
    """The first sheet in the workbook's order: shared and inline strings; cells that are left
    out are null, booleans TRUE or FALSE, and whole numbers have no decimals."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        tree = ElementTree.fromstring(z.read(_first_sheet(z, names)))
    out: list[list[str | None]] = []
    for row in tree.iter(f"{SHEET}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{SHEET}c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            place = at - 1 if at else len(cells)
            cells += [None] * (place - len(cells))
            kind, v = c.get("t"), c.find(f"{SHEET}v")
            if kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{SHEET}t")))
            elif v is None or v.text is None:
                cells.append(None)
            else:
                cells.append(shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else re.sub(r"^(-?\d+)\.0+$", r"\1", v.text) if kind in (None, "n") else v.text)
        out.append(cells)
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheets of all files under a path, each (path, row, cells); read by
    Spark's binary reader, so any store will do."""

    def run(batches):
        import pandas as pd

        for p in batches:
            rows = [(f, i, r) for f, c in zip(p["path"], p["content"]) for i, r in enumerate(xlsx_rows(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def sheet_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns of a sheet's rows below its header."""
    return rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def content_hash(row: dict) -> str:
    """SHA-256 of a row's canonical JSON: sorted keys, no escapes beyond JSON's own."""
    return hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def hashed(df: DataFrame, columns: list[str], name: str = "sha256") -> DataFrame:
    """Adds the SHA-256 of the columns' JSON, keys sorted, nulls kept."""
    packed = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.sha2(packed, 256))


def manifest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return hashed(df, columns).select(key, "sha256")


def verified(df: DataFrame, saved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state): ok, changed, missing or extra against a saved manifest."""
    now = manifest(df, key, columns).select(key, F.col("sha256").alias("now"))
    both = now.join(saved, key, "full")
    state = F.when(F.col("sha256").isNull(), "extra").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "ok").otherwise("changed")
    return both.select(key, state.alias("state"))


def replayed(df: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """The rows of a manifest in its own terms: exactly the keys that it lists."""
    return df.join(saved.select(key).distinct(), key, "left_semi")


def embedded(values: DataFrame, done: DataFrame, embed, path: str, batch: int = 500) -> DataFrame:
    """Vectors of the values that ``done`` lacks, appended to the Parquet folder ``path``;
    ``embed`` maps a list of texts to a list of vectors. Running it twice adds nothing."""
    import pandas as pd

    todo = values.join(done, ["label", "prop", "value"], "left_anti")

    def run(batches):
        for p in batches:
            for at in range(0, len(p), batch):
                some = p.iloc[at : at + batch]
                yield pd.DataFrame({"label": some["label"], "prop": some["prop"], "value": some["value"], "embedding": embed(some["value"].tolist())})

    todo.mapInPandas(run, "label string, prop string, value string, embedding array<float>").write.mode("append").parquet(path)
    return values.sparkSession.read.parquet(path)
