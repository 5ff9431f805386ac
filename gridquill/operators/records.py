"""Deeply nested records turned into flat, related tables.

Each payload is walked once and gives path-value-ordinal triples: the group of the nearest
repeated ancestor (document, table, row, mention), the ordinals of all repeated ancestors, the
path below that ancestor, the value as text and its JSON kind. Every entry of a repeated
container has a triple with an empty path, so entries without values are not lost, and each
triple below a table carries its ``table_id``. A group's triples are pivoted into one table by
a single aggregation on the ordinals, which also merges repeated deliveries.

Containers may be lists, maps keyed by id or number, or an entry standing alone; the JSON may
be wrapped in a string, a byte-order mark, a code fence or a list. Null, blank, void and
incomplete payloads give no triples but a row of ``rejects`` with the reason. A table without
``table_id`` takes the key of its container, else null. Any other array of objects, at whatever
depth, is a group of its own, named by its path (``document/authors``), with the ordinals of its
entries below the parent's; ``children`` pivots these groups. Other unknown fields stay in the
column ``other``. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, grp string, doc_no int, table_no int, item_no int, cell_no int, table_id string, path string, value string, kind string, child array<int>"
#: Triples handed over at once, so that a large payload is never held as one frame.
CHUNK = 20_000
TABLE_FIELDS = {"table_id", "table_label", "caption", "columns", "rows", "context"}
MENTION_FIELDS = {"page", "text"}
FENCE = re.compile(r"^\s*```\w*\s*(.*?)\s*```\s*$", re.S)
Triple = tuple[str, int, int | None, int | None, int | None, str | None, str, str | None, str, list[int] | None]


class Void(ValueError):
    """A payload without a record; the message says why."""


def unwrapped(payload: str | None) -> Any:
    """The JSON value of a payload; raises ``Void`` where there is none or it is incomplete."""
    if payload is None:
        raise Void("null")
    value: Any = payload
    for _ in range(5):
        if not isinstance(value, str):
            break
        text = value.strip("\ufeff \t\r\n\x00")
        if not text:
            raise Void("blank")
        if (m := FENCE.match(text)) is not None:
            text = m[1]
        try:
            value = json.loads(text)
        except ValueError:
            raise Void("incomplete") from None
    if not isinstance(value, dict | list):
        raise Void("void")
    return value


def _kind(v: Any) -> str:
    return {bool: "b", int: "i", float: "f", str: "s", type(None): "m", dict: "o", list: "a"}[type(v)]


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def _entries(value: Any, alone: set[str] | None) -> list[tuple[str | None, Any]]:
    """(key, entry) of a container that may be a list, a map or one entry."""
    if value is None:
        return []
    if isinstance(value, list):
        return [(None, v) for v in value]
    if isinstance(value, dict) and value and not (alone and alone & value.keys()) and all(isinstance(v, dict | list) for v in value.values()):
        return list(value.items())
    return [(None, value)]


def _rows(value: Any) -> list[Any]:
    if isinstance(value, list) and value and not any(isinstance(v, dict | list) for v in value):
        return [value]  # one row alone
    if isinstance(value, dict) and value and not all(isinstance(v, dict | list) for v in value.values()):
        return [value]
    return [v for _, v in _entries(value, None)]


def walk(root: Any) -> Iterator[Triple]:
    """The triples of one record, in order."""
    if isinstance(root, dict) and "documents" in root:
        documents = [d for _, d in _entries(root["documents"], {"document_id", "tables"})]
    else:
        documents = root if isinstance(root, list) else [root]
    for d, doc in enumerate(documents, 1):
        if not isinstance(doc, dict):
            continue
        yield "document", d, None, None, None, None, "", None, "o", None
        for name, v in doc.items():
            if name != "tables":
                yield from _field_of(("document", d, None, None), None, name, name, v)
        for t, (key, table) in enumerate(_entries(doc.get("tables"), TABLE_FIELDS), 1):
            if isinstance(table, dict):
                yield from _table(d, t, key, table)


def _table(d: int, t: int, key: str | None, table: dict[str, Any]) -> Iterator[Triple]:
    own = table.get("table_id")
    tid = own if isinstance(own, str) else key if own is None else str(own)
    yield "table", d, t, None, None, tid, "", None, "o", None
    context = table.get("context") or {}
    if not isinstance(context, dict):
        context = {"mentions": context}
    for name, v in table.items():
        if name == "columns":
            for c, (_, label) in enumerate(_entries(v, None)):
                yield "table", d, t, None, c, tid, "columns", _text(label), _kind(label), None
        elif name not in ("rows", "context"):
            yield from _field_of(("table", d, t, None), tid, name, name, v)
    for name, v in context.items():
        if name != "mentions":
            yield from _field_of(("table", d, t, None), tid, f"context.{name}", name, v)
    for r, row in enumerate(_rows(table.get("rows")), 1):
        yield "row", d, t, r, None, tid, "", None, _kind(row), None
        cells = row.items() if isinstance(row, dict) else enumerate(row) if isinstance(row, list) else [(0, row)]
        for c, (name, v) in enumerate(cells):
            yield "row", d, t, r, c, tid, str(name) if isinstance(row, dict) else "", _text(v), _kind(v), None
    mentions = [m for _, m in _entries(context.get("mentions"), MENTION_FIELDS)]
    for n, mention in enumerate(mentions, 1):
        yield "mention", d, t, n, None, tid, "", None, _kind(mention), None
        fields = mention if isinstance(mention, dict) else {"text": mention}
        for name, v in fields.items():
            yield from _field_of(("mention", d, t, n), tid, name, name, v)


def _field_of(parent: tuple[str, int, int | None, int | None], tid: str | None, path: str, name: str, value: Any, above: tuple[int, ...] = ()) -> Iterator[Triple]:
    """A field's triple or, of an array of objects, those of a group below ``parent``, whose entries have ordinals ``above`` + their own."""
    grp, d, t, n = parent
    own = list(above) or None
    if not (isinstance(value, list) and any(isinstance(v, dict) for v in value)):
        yield grp, d, t, n, None, tid, path, _text(value), _kind(value), own
        return
    group = f"{grp}/{name}"
    for k, entry in enumerate(value, 1):
        yield group, d, t, n, None, tid, "", None, _kind(entry), [*above, k]
        for key, v in entry.items() if isinstance(entry, dict) else [("value", entry)]:
            yield from _field_of((group, d, t, n), tid, key, key, v, (*above, k))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def triples(records: DataFrame) -> DataFrame:
    """The triples of all records."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES)
        return out.astype(dict.fromkeys(("doc_no", "table_no", "item_no", "cell_no"), "Int32"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for record_id, payload in zip(batch["record_id"], batch["payload"], strict=True):
                try:
                    root = unwrapped(payload)
                except Void:
                    continue
                for t in walk(root):
                    out.append((record_id, *t))
                    if len(out) == CHUNK:
                        yield frame(out)
                        out = []
            yield frame(out)

    return records.select("record_id", "payload").where("record_id is not null and length(payload) > 0").mapInPandas(run, SCHEMA)


def rejects(records: DataFrame) -> DataFrame:
    """record_id, reason (null, blank, void, incomplete): the records whose payload holds no record, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, payload in zip(batch["record_id"], batch["payload"], strict=True):
                try:
                    unwrapped(payload)
                except Void as e:
                    out.append((record_id, str(e)))
            yield pd.DataFrame(out, columns=["record_id", "reason"])

    return records.select("record_id", "payload").where("record_id is not null").mapInPandas(run, "record_id bigint, reason string").distinct()


def _field(name: str) -> Column:
    return F.max(F.when((F.col("path") == name) & (F.col("kind") != "m"), F.col("value")))


def pivot(parsed: DataFrame, group: str, keys: list[str], fields: dict[str, str], arrays: tuple[str, ...] = ()) -> DataFrame:
    """A group's triples as one table: its keys, a column per field, the rest in ``other``."""
    own = parsed.where(F.col("grp") == group)
    known = [*fields, *arrays, ""]
    columns = [_field(path).alias(name) for path, name in fields.items()]
    for name in arrays:
        cells = F.sort_array(F.collect_set(F.when(F.col("path") == name, F.struct("cell_no", "value"))))
        columns.append(F.transform(cells, lambda c: c["value"]).alias(name))
    rest = F.sort_array(F.collect_set(F.when(~F.col("path").isin(known), F.struct("path", F.coalesce("value", F.lit("null")).alias("value")))))
    flat = own.groupBy(*keys).agg(F.max("table_id").alias("table_id"), *columns, rest.alias("other"))
    last = F.filter("other", lambda e, i: ~F.coalesce(F.get("other", i + 1)["path"] == e["path"], F.lit(False)))  # a field once
    return flat.withColumn("other", F.map_from_entries(last))


TABLE_KEYS = ["record_id", "doc_no", "table_no"]


def documents(parsed: DataFrame) -> DataFrame:
    fields = {"document_id": "document_id", "source_pdf": "source_pdf", "title": "title", "num_tables": "num_tables"}
    out = pivot(parsed, "document", ["record_id", "doc_no"], fields).drop("table_id")
    return out.withColumn("num_tables", F.expr("try_cast(num_tables as int)"))


def tables(parsed: DataFrame) -> DataFrame:
    fields = {"table_id": "own_id", "table_label": "table_label", "page": "page", "caption": "caption", "context.section_title": "section_title"}
    return pivot(parsed, "table", TABLE_KEYS, fields, ("columns",)).drop("own_id").withColumn("page", F.expr("try_cast(page as int)"))


def cells(parsed: DataFrame) -> DataFrame:
    """One row per cell; ``column`` is its key where the row is a map, else null."""
    own = parsed.where("grp = 'row' and cell_no is not null")
    out = own.groupBy(*TABLE_KEYS, "item_no", "cell_no").agg(F.max("table_id").alias("table_id"), F.max("path").alias("column"), F.max("value").alias("value"), F.max("kind").alias("kind"))
    return out.withColumn("column", F.nullif("column", F.lit(""))).withColumnRenamed("item_no", "row_no")


def mentions(parsed: DataFrame) -> DataFrame:
    out = pivot(parsed, "mention", [*TABLE_KEYS, "item_no"], {"page": "page", "text": "text"})
    return out.withColumn("page", F.expr("try_cast(page as int)")).withColumnRenamed("item_no", "mention_no")


def rows(parsed: DataFrame) -> DataFrame:
    """record_id, doc_no, table_no, row_no, table_id, cells array<struct<cell_no,column,value,kind>>: a table's rows, empty ones too."""
    own = parsed.where("grp = 'row'")
    cell = F.when(F.col("cell_no").isNotNull(), F.struct("cell_no", F.nullif("path", F.lit("")).alias("column"), "value", "kind"))
    return own.groupBy(*TABLE_KEYS, F.col("item_no").alias("row_no")).agg(F.max("table_id").alias("table_id"), F.array_sort(F.collect_set(cell)).alias("cells"))


def children(parsed: DataFrame) -> DataFrame:
    """record_id, doc_no, table_no, item_no, grp, child (ordinals below the parent), table_id, fields map<string,string>: entries of all further arrays of objects."""
    own = parsed.where("contains(grp, '/')")
    pairs = F.collect_set(F.when(F.col("path") != "", F.struct("path", "value")))
    out = own.groupBy(*TABLE_KEYS, "item_no", "grp", "child").agg(F.max("table_id").alias("table_id"), F.sort_array(pairs).alias("p"))
    last = F.filter("p", lambda e, i: ~F.coalesce(F.get("p", i + 1)["path"] == e["path"], F.lit(False)))  # a field once
    return out.withColumn("fields", F.map_from_entries(last)).drop("p")


def entries(records: DataFrame) -> DataFrame:
    """record_id, table_id, item_kind, item_no: one row for each row and mention of the pivoted tables."""
    parsed = triples(records).where("grp in ('row', 'mention')")
    # both groups in one pivot: a key per entry, so their triples are read and shuffled once
    pivoted = parsed.groupBy("record_id", "grp", "doc_no", "table_no", "item_no").agg(F.max("table_id").alias("table_id"))
    return pivoted.select("record_id", "table_id", F.col("grp").alias("item_kind"), "item_no").distinct()
