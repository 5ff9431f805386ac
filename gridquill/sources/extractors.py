"""What outside tools deliver: TEI, vision-model JSON, cached transcriptions; and the registry of back-ends.

The tools themselves (OCR, layout models, services) are reached through ``Extractor``; none runs
within a query. Their outputs are parsed here into grids
(page, rows, caption, table_label, section_title, mentions).
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridquill.functions import text as T
from gridquill.operators import tables as tab

GRID = "struct<page:int,rows:array<array<string>>,caption:string,table_label:string,section_title:string,xml_id:string>"
TEI = "{http://www.tei-c.org/ns/1.0}"


class Extractor(Protocol):
    """A back-end that turns a document into grids; ``emits_context`` says whether captions and mentions come along."""

    emits_context: bool

    def extract(self, path: str, max_pages: int) -> list[dict[str, Any]]: ...


#: Back-ends by id. They register themselves where their tool is installed.
EXTRACTORS: dict[str, type[Extractor]] = {}
#: Ids of the tools that a run may name, and whether they deliver context.
KNOWN_TOOLS = {"pdfplumber": False, "camelot_lattice": False, "camelot_stream": False, "pymupdf": False, "docling": False, "tatr": False, "unstructured": False, "grobid": True, "qwen_vl": True, "llama_vision": True, "minicpm_v": True}


def register(name: str, extractor: type[Extractor]) -> None:
    EXTRACTORS[name] = extractor


def extractor(name: str) -> Extractor:
    if name not in EXTRACTORS:
        state = "is not installed here" if name in KNOWN_TOOLS else "is unknown"
        raise NotImplementedError(f"extractor {name!r} {state}; available: {', '.join(sorted(EXTRACTORS)) or 'none'}")
    return EXTRACTORS[name]()


def extracted(files: DataFrame, name: str, max_pages: int = 0) -> DataFrame:
    """source_pdf, grids, error: a back-end over files (path), one failure a row instead of a failed job."""
    kind = EXTRACTORS.get(name) or type(extractor(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = kind()
        for batch in batches:
            grids, errors = [], []
            for path in batch["path"]:
                try:
                    grids.append(json.dumps(tool.extract(path, max_pages)))
                    errors.append(None)
                except (ImportError, NotImplementedError):
                    raise  # an error of the environment ends the run
                except Exception as e:  # noqa: BLE001 - a damaged file must not end it
                    grids.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"source_pdf": batch["path"], "grids": grids, "error": errors})

    return files.select("path").mapInPandas(run, "source_pdf string, grids string, error string")


def tei_grids(xml: str) -> list[dict[str, Any]]:
    """The table figures of a TEI document, sections inherited from the divisions around them."""
    text = lambda node: "" if node is None else " ".join("".join(node.itertext()).split())
    out = []

    def visit(node: ET.Element, section: str) -> None:
        if node.tag == f"{TEI}div":
            section = text(node.find(f"{TEI}head")) or section
        if node.tag == f"{TEI}figure" and ((node.get("type") or "").lower() == "table" or node.find(f"{TEI}table") is not None):
            rows = []
            for row in node.iterfind(f"{TEI}table/{TEI}row"):
                cells: list[str] = []
                for cell in row.iterfind(f"{TEI}cell"):
                    span = cell.get("cols") or cell.get("colspan") or "1"
                    cells += [text(cell)] * (max(int(span), 1) if span.strip().lstrip("+-").isdigit() else 1)
                if cells:
                    rows.append(cells)
            width = max(map(len, rows), default=0)
            head, label, desc = (text(node.find(TEI + t)) for t in ("head", "label", "figDesc"))
            named = head.split(".")[0].strip() if head.lower().startswith("table") else label if label.lower().startswith("table") else f"Table {label}" if label else ""
            if len(rows) >= 2:
                out.append({"page": _page(node.get("coords")), "rows": [r + [""] * (width - len(r)) for r in rows], "caption": desc or head, "table_label": named, "section_title": section, "xml_id": (node.get("{http://www.w3.org/XML/1998/namespace}id") or node.get("id") or "").strip()})
        for child in node:
            visit(child, section)

    visit(ET.fromstring(xml), "")
    return out


def tei_mentions(xml: str) -> list[dict[str, Any]]:
    """Paragraphs that refer to a table figure: target id, page, text."""
    out = []
    for p in ET.fromstring(xml).iter(f"{TEI}p"):
        body = " ".join("".join(p.itertext()).split())
        for ref in p.iter(f"{TEI}ref"):
            target = (ref.get("target") or "").lstrip("#").strip()
            if (ref.get("type") or "").lower() == "table" and target and body:
                out.append({"target": target, "page": _page(p.get("coords")), "text": body})
    return out


def _page(coords: str | None) -> int:
    m = re.match(r"\s*(\d+(?:\.\d+)?)", coords or "")
    return max(int(float(m[1])), 1) if m else 1


def _safe(parse, empty):
    def one(x: str | None):
        try:
            return empty if x is None else parse(x)
        except ET.ParseError:
            return empty

    return lambda s: pd.Series([one(x) for x in s])


def parse_tei(documents: DataFrame, max_pages: int = 0) -> DataFrame:
    """document_id, pos, page, rows, caption, table_label, section_title, mentions; damaged XML gives none.

    ``documents`` has document_id, xml. Mentions join by the figure's id.
    """
    grids = F.pandas_udf(_safe(tei_grids, []), f"array<{GRID}>")
    said = F.pandas_udf(_safe(tei_mentions, []), "array<struct<target:string,page:int,text:string>>")
    g = documents.select("document_id", F.posexplode(grids("xml")).alias("pos", "g")).select("document_id", "pos", "g.*")
    if max_pages > 0:
        g = g.where(F.col("page") <= max_pages)
    m = documents.select("document_id", F.posexplode(said("xml")).alias("at", "m"))
    m = m.groupBy("document_id", F.col("m.target").alias("xml_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m.page", "m.text"))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("mentions"))
    return g.join(m, ["document_id", "xml_id"], "left").drop("xml_id")


SAID = "array<struct<table_label:string,mentions:array<struct<page:string,text:string>>>>"
PAGE = "array<struct<table_label:string,caption:string,section_title:string,grid:array<array<string>>>>"


def salvaged_json(answer: Column) -> Column:
    """The JSON of a model's answer: as it is, within a code fence, or between its outer braces; else null."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & (F.length(F.trim(x)) > 0), x) for x in (answer, fenced, braces)])


def message_text(body: Column) -> Column:
    """The answer in a chat response: content, else thinking, reasoning or response."""
    fields = [F.get_json_object(body, f"$.{p}") for p in ("message.content", "message.thinking", "message.reasoning", "response")]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in fields], F.lit(""))


def parse_page_answers(answers: DataFrame) -> DataFrame:
    """document_id, page, pos, rows, caption, table_label, section_title of grids with two rows at least.

    ``answers`` has document_id, page, answer. Ragged grids are padded.
    """
    j = salvaged_json(F.col("answer"))
    listed = F.when(j.rlike(r"^\s*\["), F.from_json(j, PAGE)).otherwise(F.from_json(F.get_json_object(j, "$.tables"), PAGE))
    each = answers.select("document_id", "page", F.posexplode(listed).alias("pos", "t"))
    width = F.array_max(F.transform("t.grid", lambda r: F.size(r)))
    rows = F.transform("t.grid", lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return each.select("document_id", "page", "pos", rows.alias("rows"), blank("t.caption").alias("caption"), blank("t.table_label").alias("table_label"), blank("t.section_title").alias("section_title")).where(F.size("rows") >= 2)


def attached_mentions(grids: DataFrame, answers: DataFrame) -> DataFrame:
    """``grids`` with the mentions that an answer (document_id, answer) lists under their label, else their caption."""
    key = lambda c: T.collapse(F.lower(c))
    said = F.from_json(F.get_json_object(salvaged_json(F.col("answer")), "$.mentions_by_label"), SAID)
    each = answers.select("document_id", F.posexplode(said).alias("at", "m")).withColumn("key", key(F.col("m.table_label"))).where("key <> ''")
    page = lambda x: F.greatest(F.coalesce(x["page"].try_cast("int"), F.lit(1)), F.lit(1))
    texts = F.transform(F.filter("m.mentions", lambda x: F.length(F.trim(x["text"])) > 0), lambda x: F.struct(page(x).alias("page"), F.trim(x["text"]).alias("text")))
    last = each.groupBy("document_id", "key").agg(F.max_by(texts, "at").alias("mentions"))
    g = grids.withColumn("key", key(F.coalesce(F.nullif("table_label", F.lit("")), F.col("caption"))))
    return g.join(last, ["document_id", "key"], "left").drop("key")


def predicted_documents(grids: DataFrame, label: str = "Table ") -> DataFrame:
    """document_id, table_pos, page, caption, table_label, section_title, columns, rows: grids flattened like page tables."""
    flat = grids.withColumn("flat", tab.parse_grid(F.col("rows"))).where("flat.columns is not null")
    caption = F.coalesce(F.nullif(T.scientific(F.col("caption")), F.lit("")), F.col("flat.embedded_caption"))
    number = F.coalesce(T.caption_number(caption), T.label_number(F.col("table_label")))
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("page", "pos")
    shown = F.coalesce(F.concat(F.lit(label), number), F.col("table_label"))
    return flat.select("document_id", F.row_number().over(order).alias("table_pos"), "page", caption.alias("caption"), shown.alias("table_label"), "section_title", F.col("flat.columns").alias("columns"), F.col("flat.rows").alias("rows"))


class TranscriptionCache(DataSource):
    """``spark.read.format("transcriptions").load(folder)``: one row per page of cached JSON transcriptions.

    A folder holds ``<stem>.json`` files {source_pdf, engine, pages[]}; every file is a partition.
    With the option ``max_pages`` later pages are left out; a cache file itself is never cut.
    """

    @classmethod
    def name(cls) -> str:
        return "transcriptions"

    def schema(self) -> str:
        return "document_id string, source_pdf string, engine string, page int, text string, pages int"

    def reader(self, schema) -> DataSourceReader:
        return _CacheReader(self.options)


class _CacheReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("max_pages", 0))

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path

        if partition.value is None:
            return
        path = Path(partition.value)
        try:
            record = json.loads(path.read_text(encoding="utf-8"))
        except ValueError:
            return  # a damaged entry counts as missing
        pages, engine = record.get("pages") or [], record.get("engine") or {}
        name = engine.get("id") if isinstance(engine, dict) else engine
        for n, text in enumerate(pages[: self.most or None], 1):
            yield path.stem, record.get("source_pdf"), name, n, text, len(pages)


def read_transcriptions(spark: SparkSession, folder: str, max_pages: int = 0) -> DataFrame:
    spark.dataSource.register(TranscriptionCache)
    return spark.read.format("transcriptions").option("max_pages", str(max_pages)).load(folder)


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files (name) without a cached transcription."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.withColumn("stem", stem).join(cache.select(F.col("document_id").alias("stem")).distinct(), "stem", "left_anti")


def marked_text(pages: DataFrame, limit: int = 14_000) -> DataFrame:
    """document_id, text: a document's pages with page marks, cut at ``limit`` characters for a prompt."""
    each = pages.select("document_id", F.struct("page", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), "text").alias("t")).alias("p"))
    whole = each.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n\n").alias("text"))
    return whole.select("document_id", F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("\n[truncated]"))).otherwise(F.col("text")).alias("text"))
