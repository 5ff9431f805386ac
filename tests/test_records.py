import json

from pyspark.sql import functions as F

from gridquill.operators import records as R

TABLE = {"table_id": "t1", "page": "3", "caption": "C", "columns": ["a", "b"], "rows": [["x", 1], [], {"a": 2.0}], "context": {"section_title": "S", "mentions": [{"page": 1, "text": "m"}, "bare"]}}
DOC = {"document_id": "d", "source_pdf": "d.pdf", "num_tables": 1, "new_field": {"k": 1}, "tables": [TABLE]}
SHAPES = {
    1: DOC, 2: {"documents": [DOC]}, 3: [DOC], 4: {**DOC, "tables": {"t1": {k: v for k, v in TABLE.items() if k != "table_id"}}}, 5: {**DOC, "tables": TABLE},
    6: {**DOC, "tables": None}, 7: {**DOC, "tables": [{**TABLE, "rows": ["x", 1], "context": {"mentions": {"page": 1, "text": "m"}}}]}, 8: {**DOC, "tables": [{"table_id": "t1"}, None, "odd"]},
}
FULL = {("row", 1), ("row", 2), ("row", 3), ("mention", 1), ("mention", 2)}


def records(spark):
    rows = [(i, json.dumps(s)) for i, s in SHAPES.items()]
    text = json.dumps(DOC)
    rows += [(11, "﻿" + text), (12, json.dumps(text)), (13, f"```json\n{text}\n```"), (14, text[:-5]), (15, None), (16, ""), (17, "null"), (18, "  "), (1, json.dumps(DOC)), (None, text)]
    return spark.createDataFrame([(i, p, "clash") for i, p in rows], "record_id bigint, payload string, path string")


def test_entries_of_every_shape(spark):
    got: dict = {}
    for r in R.entries(records(spark)).collect():
        assert r.table_id == "t1"
        got.setdefault(r.record_id, []).append((r.item_kind, r.item_no))
    full = {i: set(v) for i, v in got.items()}
    assert all(len(v) == len(full[i]) for i, v in got.items())  # the repeated delivery counts once
    assert full == {i: FULL for i in (1, 2, 3, 4, 5, 11, 12, 13)} | {7: {("row", 1), ("mention", 1)}}


def test_flat_tables_keep_their_links(spark):
    parsed = R.triples(records(spark).where("record_id in (1, 4)"))
    t = {r.record_id: r for r in R.tables(parsed).collect()}
    assert all((t[i].table_id, t[i].page, t[i].section_title, t[i].columns) == ("t1", 3, "S", ["a", "b"]) for i in (1, 4))
    c = {(r.row_no, r.cell_no): (r.column, r.value, r.kind) for r in R.cells(parsed).where("record_id = 1").collect()}
    assert c == {(1, 0): (None, "x", "s"), (1, 1): (None, "1", "i"), (3, 0): ("a", "2.0", "f")}
    m = [(r.mention_no, r.page, r.text) for r in R.mentions(parsed).where("record_id = 1").orderBy("mention_no").collect()]
    assert m == [(1, 1, "m"), (2, None, "bare")]
    d = R.documents(parsed).where("record_id = 1").first()
    assert (d.document_id, d.title, d.num_tables, d.other) == ("d", None, 1, {"new_field": '{"k": 1}'})


def test_no_records(spark):
    none = records(spark).limit(0)
    assert R.entries(none).count() == 0
    parsed = R.triples(none)
    assert [f(parsed).count() for f in (R.documents, R.tables, R.cells, R.mentions)] == [0] * 4


def test_long_payload(spark):
    big = {**DOC, "tables": [{**TABLE, "rows": [["x", i] for i in range(20_000)]}]}
    df = spark.createDataFrame([(1, json.dumps(big))], "record_id bigint, payload string")
    assert R.entries(df).agg(F.max("item_no")).first()[0] == 20_000


def test_further_arrays_of_objects_are_groups_of_their_own(spark):
    doc = {**DOC, "authors": [{"name": "A", "labs": [{"city": "X"}, {"city": "Y"}]}, {"name": "B"}, "C"], "keys": ["a", "b"], "tables": [{**TABLE, "notes": [{"mark": "a", "n": 1}]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (1, json.dumps(doc))], "record_id bigint, payload string")
    parsed = R.triples(df)
    got = {(r.grp, tuple(r.child)): (r.table_id, r.fields) for r in R.children(parsed).collect()}
    assert got == {
        ("document/authors", (1,)): (None, {"name": "A"}), ("document/authors", (2,)): (None, {"name": "B"}), ("document/authors", (3,)): (None, {"value": "C"}),
        ("document/authors/labs", (1, 1)): (None, {"city": "X"}), ("document/authors/labs", (1, 2)): (None, {"city": "Y"}), ("table/notes", (1,)): ("t1", {"mark": "a", "n": "1"}),
    }
    assert R.documents(parsed).first().other == {"new_field": '{"k": 1}', "keys": '["a", "b"]'}


def test_rows_with_their_cells(spark):
    got = {r.row_no: [(c.column, c.value) for c in r.cells] for r in R.rows(R.triples(records(spark).where("record_id = 1"))).collect()}
    assert got == {1: [(None, "x"), (None, "1")], 2: [], 3: [("a", "2.0")]}


def test_rejects_say_why(spark):
    got = {r.record_id: r.reason for r in R.rejects(records(spark)).collect()}
    assert got == {14: "incomplete", 15: "null", 16: "blank", 17: "void", 18: "blank"}
