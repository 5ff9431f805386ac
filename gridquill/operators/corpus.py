"""Corpora as a whole: nested and relational form, checks, summary, incremental upkeep, triples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquill.functions import text as T

PREFIXES = {
    "inst": "https://example.org/corpus/instance/",
    "sc": "https://example.org/corpus/schema#",
    "schema": "https://schema.org/",
    "prov": "http://www.w3.org/ns/prov#",
    "csvw": "http://www.w3.org/ns/csvw#",
}


def violations(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, rule, detail of each broken constraint.

    ``documents`` has document_id, num_tables; ``tables`` document_id, table_id, page, columns, rows.
    """
    size = tables.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    counts = documents.join(size, "document_id", "left").fillna(0, ["n"]).where("num_tables <> n or num_tables < 0 or num_tables is null")
    wrong = counts.select("document_id", F.lit("num_tables").alias("rule"), F.concat_ws(" vs ", "num_tables", "n").alias("detail"))
    twice = tables.groupBy("document_id", "table_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select("document_id", F.lit("table_id_unique").alias("rule"), F.col("table_id").alias("detail"))
    ragged = tables.where(F.exists("rows", lambda r: F.size(r) != F.size("columns"))).select("document_id", F.lit("rectangular").alias("rule"), F.col("table_id").alias("detail"))
    page = tables.where("page < 1 or page is null").select("document_id", F.lit("page_positive").alias("rule"), F.col("table_id").alias("detail"))
    return wrong.unionByName(twice).unionByName(ragged).unionByName(page)


def corpus_summary(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: counts, coverage of optional fields, mean rows and columns (two places)."""
    filled = lambda c: F.count_if(F.length(F.trim(c)) > 0)
    d = documents.agg(F.count(F.lit(1)).alias("documents"), filled("title").alias("with_title"), F.count_if(F.col("num_tables") == 0).alias("without_tables"))
    t = tables.agg(
        F.count(F.lit(1)).alias("tables"),
        filled("caption").alias("with_caption"),
        filled("section_title").alias("with_section"),
        F.count_if(F.size("mentions") > 0).alias("with_mentions"),
        F.coalesce(F.sum(F.greatest(F.size("mentions"), F.lit(0))), F.lit(0)).alias("mentions"),
        F.round(F.avg("n_rows"), 2).alias("mean_rows"),
        F.round(F.avg("n_columns"), 2).alias("mean_columns"),
    )
    return d.crossJoin(t)  # one row each


def working_set(reference: DataFrame, files: DataFrame) -> DataFrame:
    """name, position, found: the reference's documents in its order, each once, and whether a file is there.

    ``reference`` has source_pdf and position, ``files`` name.
    """
    wanted = reference.select(F.element_at(F.split("source_pdf", "/"), -1).alias("name"), "position").groupBy("name").agg(F.min("position").alias("position"))
    there = files.select("name").distinct().withColumn("found", F.lit(True))
    return wanted.join(there, "name", "left").fillna(False, ["found"])


def pending(inputs: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """The inputs (source_pdf) still to be processed."""
    return inputs if overwrite else inputs.join(existing.select("source_pdf"), "source_pdf", "left_anti")


def merged(inputs: DataFrame, existing: DataFrame, updates: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The corpus after a run: updates replace, the inputs' order comes first, leftovers follow.

    ``inputs`` has source_pdf, pos; ``existing`` and ``updates`` source_pdf, num_tables, pos and more.
    """
    old = existing.join(updates.select("source_pdf"), "source_pdf", "left_anti")
    every = old.unionByName(updates).drop("pos").join(inputs.select("source_pdf", "pos"), "source_pdf", "left")
    kept = every if keep_empty else every.where("num_tables > 0")
    return kept.withColumn("is_leftover", F.col("pos").isNull())


def failures(results: DataFrame) -> DataFrame:
    """pdf, error of the inputs that failed; an error of the environment is the caller's to raise."""
    return results.where("error is not null").select(F.col("source_pdf").alias("pdf"), "error")


def is_environment_error(error: Column) -> Column:
    return error.rlike("^(ImportError|ModuleNotFoundError|NotImplementedError)")


def triples(documents: DataFrame, tables: DataFrame, mentions: DataFrame) -> DataFrame:
    """s, p, o: the statements of a corpus, objects as Turtle terms.

    ``documents`` has document_id, title, source_pdf; ``tables`` document_id, table_id,
    table_label, page, caption, columns, section_title; ``mentions`` document_id, table_id,
    mention_no, page, text. Blank values give no statement.
    """
    article, table = T.turtle_name("article", F.col("document_id")), T.turtle_name("table", F.col("table_id"))
    text = lambda c: F.when(F.length(F.trim(c)) > 0, T.turtle_literal(F.trim(c)))
    number = lambda c: F.col(c).cast("int").cast("string")

    def rows(df: DataFrame, subject: Column, facts: list[tuple[str, Column]]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts])
        return df.select(subject.alias("s"), F.inline(F.filter(pairs, lambda x: x["o"].isNotNull())))

    title, label = T.caption_title(F.col("caption")), F.trim("table_label")
    name = F.when(title == "", F.when(label == "", F.col("table_id")).otherwise(label)).when(label == "", title).otherwise(F.concat_ws(" — ", label, title))
    d = rows(documents, article, [("a", F.lit("sc:Article")), ("schema:name", text("title")), ("schema:identifier", text("source_pdf")), ("prov:hadPrimarySource", text("source_pdf"))])
    t = rows(tables, table, [("a", F.lit("sc:TableRepresentation")), ("schema:name", T.turtle_literal(name)), ("sc:belongsToArticle", article), ("schema:pageStart", number("page")), ("schema:description", text("caption")), ("schema:articleSection", text("section_title"))])
    heads = tables.select(table.alias("s"), F.explode("columns").alias("c")).where("length(trim(c)) > 0")
    c = heads.select("s", F.lit("csvw:column").alias("p"), F.concat(F.lit("[ csvw:name "), T.turtle_literal(F.trim("c")), F.lit(" ]")).alias("o"))
    said = mentions.where("length(trim(text)) > 0")
    m = rows(said, F.concat_ws("_mention_", table, F.col("mention_no").cast("string")), [("a", F.lit("sc:TextMention")), ("schema:text", text("text")), ("schema:about", table), ("prov:wasDerivedFrom", article), ("schema:pageStart", number("page"))])
    return d.unionByName(t).unionByName(c).unionByName(m)


#: Vocabularies of the statements. Those of a project (terms ``sc``, individuals ``inst``) have no public address here: give your own.
PREFIXES = {"schema": "https://schema.org/", "prov": "http://www.w3.org/ns/prov#", "csvw": "http://www.w3.org/ns/csvw#", "xsd": "http://www.w3.org/2001/XMLSchema#", "sc": "urn:gridquill:terms#", "inst": "urn:gridquill:instance#"}


def turtle_lines(statements: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """value: Turtle text, one statement a line, to be written with ``write.text``.

    Each partition, so each file, opens with the prefixes and can be read alone; an empty one has
    nothing else. ``prefixes`` replace or extend ``PREFIXES``.
    """
    head = [f"@prefix {name}: <{address}> ." for name, address in (PREFIXES | (prefixes or {})).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    lines = statements.select(F.concat(F.concat_ws(" ", "s", "p", "o"), F.lit(" .")).alias("value"))
    return lines.mapInArrow(run, "value string")
