from pyspark.sql import functions as F

from gridquill.operators import tables as tab
from gridquill.sources import extractors as X

SPANS = "<table><thead><tr><th rowspan=2>Sample</th><th colspan=2>Rate</th></tr><tr><th>CH<sub>4</sub></th><th>CO</th></tr></thead><tbody><tr><td>A</td><td>1,5</td><td>-</td></tr><tr><td>-</td><td></td><td>-</td></tr></tbody></table>"


def test_spans_scripts_and_blank_rows():
    got = tab.from_html(SPANS)
    assert got["columns"] == ["Sample", "Rate_CH4", "Rate_CO"]
    assert [c["s"] for c in got["rows"][0]] == ["A", "1.5", "-"] and len(got["rows"]) == 1


def test_caption_spanner_and_unit_row():
    got = tab.from_html("<table><thead><tr><th colspan=2>Table 2</th></tr><tr><th colspan=2>Pore data</th></tr><tr><th>Name</th><th>Area</th></tr></thead><tr><td>-</td><td>m<sup>2</sup>/g</td></tr><tr><td>A</td><td>3</td></tr></table>")
    assert got["embedded_caption"] == "Table 2 Pore data" and got["columns"] == ["Name", "Area (m^2/g)"] and len(got["rows"]) == 1


def test_what_is_no_table():
    assert tab.from_html("<table><tr><th>only</th></tr></table>") is None
    assert tab.from_html("<table></table>") is None and tab.from_html("text") is None
    assert tab.from_markdown("|---|\n| a |") is None
    assert tab.from_grid([["a", "b"]]) is None and tab.from_grid([]) is None


def test_broken_markup_and_bad_spans():
    got = tab.from_html("<table><tr><td colspan='x'>a<td>b<tr><td>1<td>2</table> after <table><tr><td>z</td></tr></table>")
    assert got["columns"] == ["a", "b"] and [c["i"] for c in got["rows"][0]] == [1, 2]


def test_markdown_and_grid_agree():
    rows = [["a", "b"], ["x", "2.0"], [None, "3"]]
    mark = "| a | b |\n|:--|--:|\n| x | 2.0 |\n| | 3 |"
    assert tab.from_markdown(mark) == tab.from_grid(rows)


def test_pages_prefer_html(spark):
    pages = spark.createDataFrame([(1, SPANS + "\n| a |\n|---|\n| 1 |"), (2, "| a | b |\n|---|---|\n| 1 | 2 |\n"), (3, None), (4, "")], "page int, text string")
    got = {(r.page, r.syntax) for r in tab.extract_tables(pages).collect()}
    assert got == {(1, "html"), (2, "markdown")}


def test_tei_and_model_answers(spark):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><div><head>R</head><figure type="table"><head>Table 1. X</head><table><row><cell>a</cell><cell>b</cell></row><row><cell>1</cell></row></table></figure></div></TEI>'
    got = X.parse_tei(spark.createDataFrame([("d", xml), ("bad", "<TEI"), ("none", None)], "document_id string, xml string")).collect()
    assert len(got) == 1 and got[0].table_label == "Table 1" and got[0].rows == [["a", "b"], ["1", ""]] and got[0].section_title == "R"
    answers = spark.createDataFrame([("d", 1, 'x ```json\n[{"grid":[["a"],["1","2"]]}]\n```'), ("e", 1, "no json"), ("f", 1, None)], "document_id string, page int, answer string")
    got = X.parse_page_answers(answers).collect()
    assert len(got) == 1 and got[0].rows == [["a", ""], ["1", "2"]]
    assert spark.range(1).select(X.message_text(F.lit('{"message":{"content":"","thinking":"t"}}'))).first()[0] == "t"


def test_failures_are_rows(spark):
    class Tool:
        emits_context = False

        def extract(self, path, max_pages):
            if "2" in path:
                raise ValueError("damaged")
            return []

    X.register("test_tool", Tool)
    got = {r.source_pdf: r.error for r in X.extracted(spark.createDataFrame([("1",), ("2",)], "path string"), "test_tool").collect()}
    assert got == {"1": None, "2": "ValueError: damaged"}
