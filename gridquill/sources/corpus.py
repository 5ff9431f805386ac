"""Corpus JSON in and out, label files, file listings.

Cells are strings, integers or floats in JSON; a UDF reads them with their kind, so that 2 and
2.0 stay apart, everything else is parsed in the JVM.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions.text import CELL, float_text
from gridquill.session import read as read_table

TABLE = "table_id string, table_label string, page int, caption string, columns array<string>, rows array<array<string>>, context struct<section_title:string,mentions:array<struct<page:int,text:string>>>"
DOCUMENT = f"document_id string, source_pdf string, title string, num_tables int, tables array<struct<{', '.join(f.replace(' ', ':', 1) for f in TABLE.split(', '))}>>"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", first: int | None = None) -> DataFrame:
    """path, name, length of a folder's files in name order, or of one file; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return in_order(named, first)


def in_order(named: DataFrame, first: int | None = None) -> DataFrame:
    """Files in the order of their names, all or the first so many."""
    ordered = named.orderBy("name")
    return ordered.limit(first) if first else ordered


def named_like(files_: DataFrame, part: str) -> DataFrame:
    """Files whose name contains ``part``, whatever its case."""
    return files_.where(F.lower("name").contains(part.lower()))



def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """documents of corpus or single-document JSON files, one row each: ``DOCUMENT`` with typed cells.

    A damaged or missing file gives no rows. Files are read whole; each is one task.
    """
    schema = f"documents array<struct<{_struct(DOCUMENT)}>>, {DOCUMENT}"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    typed = F.pandas_udf(_typed_rows, f"array<array<array<array<{CELL}>>>>")
    parsed = raw.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("j"), typed("value").alias("cells"))
    alone = F.array(F.struct(*[F.col(f"j.{c}").alias(c) for c in ("document_id", "source_pdf", "title", "num_tables", "tables")]))
    each = parsed.select(F.posexplode(F.coalesce("j.documents", alone)).alias("doc_pos", "d"), "cells").select("doc_pos", "d.*", F.get("cells", F.col("doc_pos")).alias("cells"))
    tables = F.transform("tables", lambda t, i: t.withField("rows", F.get("cells", i)))
    return each.where("document_id is not null").select("doc_pos", "document_id", "source_pdf", "title", "num_tables", tables.alias("tables"))


def _struct(ddl: str) -> str:
    depth, out, at = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[at:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            at = i + 1
    return ",".join(out)


def _typed_rows(values: pd.Series) -> pd.Series:
    """The cells of each file: documents, tables, rows, cells."""

    def cell(v: object) -> dict[str, object]:
        kind = "m" if v is None or v == "-" else "i" if isinstance(v, int) and not isinstance(v, bool) else "f" if isinstance(v, float) else "s"
        text = "-" if kind == "m" else repr(v) if kind == "f" else str(v)
        return {"kind": kind, "s": text, "i": v if kind == "i" else None, "d": v if kind == "f" else None}

    out = []
    for text in values:
        root = json.loads(text)
        docs = root["documents"] if isinstance(root, dict) and "documents" in root else [root]
        out.append([[[[cell(c) for c in row] for row in t.get("rows") or []] for t in d.get("tables") or []] for d in docs if isinstance(d, dict)])
    return pd.Series(out)


def relational(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, mentions) of nested documents, children with their positions."""
    each = documents.select("document_id", "source_pdf", F.posexplode("tables").alias("table_pos", "t"))
    tables = each.select("document_id", "source_pdf", "table_pos", "t.table_id", "t.table_label", "t.page", "t.caption", "t.columns", F.coalesce("t.context.section_title", F.lit("")).alias("section_title"), F.transform("t.context.mentions", lambda m: m["text"]).alias("mentions"), F.col("t.rows").alias("rows"))
    rows = each.select("document_id", "t.table_id", F.posexplode("t.rows").alias("row_no", "row"))
    cells = rows.select("document_id", "table_id", "row_no", F.posexplode("row").alias("col_no", "cell"))
    said = each.select("document_id", "t.table_id", F.posexplode("t.context.mentions").alias("pos", "m"))
    return tables.select(*[c for c in tables.columns]), cells, said.select("document_id", "table_id", "pos", "m.page", "m.text")


def nested(tables: DataFrame, cells: DataFrame, mentions: DataFrame) -> DataFrame:
    """document_id, num_tables, tables: the inverse of ``relational``; order comes from the positions."""
    row = cells.groupBy("table_id", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "cell"))), lambda c: c["cell"]).alias("row"))
    grid = row.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]).alias("rows"))
    said = mentions.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "page", "text"))), lambda m: F.struct(m["page"].alias("page"), m["text"].alias("text"))).alias("mentions"))
    full = tables.drop("rows", "mentions").join(grid, "table_id", "left").join(said, "table_id", "left")
    context = F.struct("section_title", F.coalesce("mentions", F.array().cast("array<struct<page:int,text:string>>")).alias("mentions"))
    table = F.struct("table_pos", "table_id", "table_label", "page", "caption", "columns", "rows", context.alias("context"))
    out = full.groupBy("document_id", "source_pdf").agg(F.sort_array(F.collect_list(table)).alias("t"))
    fields = ["table_id", "table_label", "page", "caption", "columns", "rows", "context"]
    return out.select("document_id", "source_pdf", F.size("t").alias("num_tables"), F.transform("t", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("tables"))


def cell_json(cell: Column) -> Column:
    """A cell as a JSON token."""
    quoted = F.regexp_extract(F.to_json(F.struct(cell["s"].alias("s"))), r'^\{"s":(.*)\}$', 1)
    return F.when(cell["kind"].isin("s", "m"), quoted).when(cell["kind"] == "i", cell["i"].cast("string")).otherwise(float_text(cell["d"]))


def document_json(documents: DataFrame) -> DataFrame:
    """document_id, value: each document as one JSON line in the corpus's shape."""

    def token(c: Column, name: str) -> Column:
        body = F.to_json(F.struct(F.coalesce(c, F.lit("") if name not in ("page", "num_tables") else F.lit(0)).alias("x")))
        return F.concat(F.lit(f'"{name}":'), F.regexp_extract(body, r'^\{"x":(?s:(.*))\}$', 1))

    def table(t: Column) -> Column:
        rows = F.concat(F.lit('"rows":['), F.array_join(F.transform(t["rows"], lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell_json), ","), F.lit("]"))), ","), F.lit("]"))
        columns = F.concat(F.lit('"columns":'), F.to_json(t["columns"]))
        return F.concat(F.lit("{"), F.concat_ws(",", token(t["table_id"], "table_id"), token(t["table_label"], "table_label"), token(t["page"], "page"), token(t["caption"], "caption"), columns, rows, F.concat(F.lit('"context":'), F.to_json(t["context"]))), F.lit("}"))

    title = F.col("title") if "title" in documents.columns else F.lit("")
    tables = F.concat(F.lit('"tables":['), F.array_join(F.transform("tables", table), ","), F.lit("]"))
    value = F.concat(F.lit("{"), F.concat_ws(",", token(F.col("document_id"), "document_id"), token(F.col("source_pdf"), "source_pdf"), token(title, "title"), token(F.col("num_tables"), "num_tables"), tables), F.lit("}"))
    return documents.select("document_id", value.alias("value"))


def write_corpus(documents: DataFrame, path: str) -> None:
    """JSON lines, one document each; a run that fails leaves no half-written folder."""
    document_json(documents).select("value").write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Label rows of CSV files: trimmed, keyed rows only; for each field the last non-blank value wins."""
    names = ["document_id", "sentence_id", "text", "gold_is_claim", "gold_role", "gold_type", "gold_table"]
    parts = []
    for order, path in enumerate(paths):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        parts.append(raw.select(*[F.trim(F.col(n)).alias(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names], F.lit(order).alias("file")).withColumn("at", F.monotonically_increasing_id()))
    every = reduce(DataFrame.unionByName, parts)
    keyed = every.where("length(document_id) > 0 and length(sentence_id) > 0").withColumn("order", F.struct("file", "at"))
    last = [F.max_by(F.when(F.length(n) > 0, F.col(n)), F.when(F.length(n) > 0, F.col("order"))).alias(n) for n in names[2:]]
    return keyed.groupBy("document_id", "sentence_id").agg(*last).fillna("", names[2:])


def ground_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of the driver's reference relations in the shape that evaluation takes; each row once."""
    t = read_table(spark, folder, "gt_tables").dropDuplicates(["table_no"])
    said = read_table(spark, folder, "gt_mentions").dropDuplicates(["mention_id"]).where("text is not null").groupBy("table_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("mention_pos", "text"))), lambda m: m["text"]).alias("mentions"))
    tables = t.join(said, "table_no", "left").select(
        F.col("document_id"),
        F.concat("document_id", F.lit(".pdf")).alias("source_pdf"),
        F.col("table_no").cast("int").alias("table_pos"),
        "table_id",
        "table_label",
        "page",
        "caption",
        F.col("col_headers").alias("columns"),
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"),
    )
    cells = read_table(spark, folder, "gt_cells").dropDuplicates(["cell_id"]).join(t.select("table_no", "table_id"), "table_no")
    return tables, cells.select("document_id", "table_id", "row_no", "col_no", "cell")
