import json

from pyspark.sql import functions as F

from gridquill.operators import corpus as C
from gridquill.sources import corpus as S
from gridquill.sources import extractors as X
from gridquill.streaming import incremental as stream

DOC = {"document_id": "d1", "source_pdf": "a.pdf", "title": 'A "title"', "num_tables": 1, "tables": [{"table_id": "d1_table_01", "table_label": "Table 1", "page": 2, "caption": "C\nD", "columns": ["a", "b", "c"], "rows": [["x", 2, 2.0], ["-", 1e-07, "3"]], "context": {"section_title": "S", "mentions": [{"page": 1, "text": "m"}]}}]}


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(DOC), encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps({"documents": [dict(DOC, document_id="d2"), dict(DOC, document_id="d3", tables=[])]}), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    docs = S.read_corpus(spark, str(tmp_path / "*.json"))
    assert {r.document_id for r in docs.collect()} == {"d1", "d2", "d3"}
    back = {json.loads(r.value)["document_id"]: json.loads(r.value) for r in S.document_json(docs).collect()}
    assert back["d1"] == DOC and [type(v) for v in back["d1"]["tables"][0]["rows"][0]] == [str, int, float]
    tables, cells, mentions = S.relational(docs.where("document_id = 'd1'"))
    again = S.nested(tables, cells, mentions).first()
    assert again.tables == docs.where("document_id = 'd1'").first().tables


def test_labels_last_non_blank_wins(spark, tmp_path):
    head = "document_id,sentence_id,text,gold_is_claim\n"
    (tmp_path / "1.csv").write_text(head + "d,1, t ,yes\n,2,x,no\n")
    (tmp_path / "2.csv").write_text(head + "d,1,,no\n")
    got = S.read_labels(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()
    assert [(r.text, r.gold_is_claim, r.gold_role) for r in got] == [("t", "no", "")]


def test_cache_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"source_pdf": "p1.pdf", "engine": {"id": "e"}, "pages": ["one", "two"]}))
    (tmp_path / "p2.json").write_text("broken")
    rows = X.read_transcriptions(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.document_id, r.page, r.text, r.pages) for r in rows] == [("p1", 1, "one", 2), ("p1", 2, "two", 2)]
    assert X.read_transcriptions(spark, str(tmp_path), max_pages=1).count() == 1
    files = spark.createDataFrame([("p1.pdf",), ("p2.pdf",)], "name string")
    assert [r.name for r in X.uncached(files, X.read_transcriptions(spark, str(tmp_path))).collect()] == ["p2.pdf"]


def test_streamed_documents_equal_batch(spark, tmp_path):
    table = "<table><tr><th>a</th></tr><tr><td>{}</td></tr></table>"
    pages = spark.createDataFrame([("d1", 1, table.format(1)), ("d2", 1, table.format(2))], "document_id string, page int, text string")
    pages.where("document_id = 'd1'").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    source = lambda: spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in/*"))
    for _ in range(2):
        stream.keep_up(source(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        pages.where("document_id = 'd2'").coalesce(1).write.mode("ignore").parquet(str(tmp_path / "in/2"))
    again = pages.where("document_id = 'd1'").withColumn("text", F.lit(table.format(9)))  # the document comes again
    again.coalesce(1).write.parquet(str(tmp_path / "in/3"))
    stream.keep_up(source(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.document_id: r.tables[0].rows[0][0].i for r in stream.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"d1": 9, "d2": 2}


def test_turtle(spark):
    d = spark.createDataFrame([("1 x", 'T"', "a.pdf")], "document_id string, title string, source_pdf string")
    t = spark.createDataFrame([("1 x", "t", "", 1, "Table 1: Cap", ["a", " "], "")], "document_id string, table_id string, table_label string, page int, caption string, columns array<string>, section_title string")
    m = spark.createDataFrame([("1 x", "t", 1, 2, " hi "), ("1 x", "t", 2, 2, None)], "document_id string, table_id string, mention_no int, page int, text string")
    lines = {r.value for r in C.turtle_lines(C.triples(d, t, m)).collect()}
    assert 'inst:article_n_1_x schema:name "T\\"" .' in lines and 'inst:table_t schema:name "Cap" .' in lines and 'inst:table_t_mention_1 schema:text "hi" .' in lines
    assert not any("mention_2" in x for x in lines)
