import json
import re

import pytest
from pyspark.sql import functions as F

from gridquill.__main__ import main
from gridquill.config import Layout, is_protected
from gridquill.plans import pipelines as P
from gridquill.sources import corpus as S

PAGE = "## 3. Results\n\nTable 1: Pore data of the samples\n\n<table><thead><tr><th>Sample</th><th>Area (m2/g)</th></tr></thead><tbody><tr><td>AlphaX</td><td>61.5</td></tr><tr><td>BetaY</td><td>48.25</td></tr></tbody></table>\n\nTable 2: Rates of the samples\n\n<table><tr><th>Sample</th><th>Rate</th></tr><tr><td>AlphaX</td><td>7.31</td></tr></table>"
TEXT = "## 3. Results\n\nThe surface area of AlphaX reached 61.5 m2/g, as Table 1 shows. The highest rate of all the samples was 7.31 in the second run."


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "t").mkdir()
    (d / "t" / "p1.json").write_text(json.dumps({"source_pdf": "p1.pdf", "engine": {"id": "e"}, "pages": [PAGE, TEXT]}))
    (d / "t" / "p2.json").write_text(json.dumps({"source_pdf": "p2.pdf", "engine": {"id": "e"}, "pages": ["no table"]}))
    return d


def test_from_pages_to_scores(spark, folder, capsys):
    t, out = str(folder / "t"), str(folder / "corpus")
    assert main(["generate", "--transcriptions", t, "--output", out], spark) == 0
    docs = S.read_corpus(spark, out + "/*.txt")
    assert [(r.document_id, r.num_tables) for r in docs.collect()] == [("p1", 2)]
    capsys.readouterr()
    assert main(["validate", out + "/*.txt"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["tables"] == 2
    assert main(["evaluate", "--reference", out + "/*.txt", "--prediction", out + "/*.txt"], spark) == 0
    assert {v["f1"] for v in json.loads(capsys.readouterr().out).values()} == {1.0}
    report = P.evaluation_report(spark, out + "/*.txt", out + "/*.txt").first()
    assert (report.document_id, report.prediction_id, report.matched_tables) == ("p1", "p1", 2) and [t.cells for t in report.tables] == [1.0, 1.0]
    assert main(["export", "--corpus", out + "/*.txt", "--output", str(folder / "ttl")], spark) == 0
    assert spark.read.text(str(folder / "ttl")).where(F.col("value").contains("sc:TextMention")).count() == 1
    for part in (folder / "ttl").glob("part-*"):
        lines = part.read_text().splitlines()
        used = {name for x in lines if not x.startswith("@prefix") for name in re.findall(r"(?:^|[\s\[])(\w+):\w", re.sub(r'"(?:[^"\\\\]|\\\\.)*"', '""', x))}
        assert used <= {x.split()[1].rstrip(":") for x in lines if x.startswith("@prefix")} and len(lines) > 5
    with pytest.raises(ValueError):
        P.exported(docs, "data/gold/x.json")
    assert main(["link", "--corpus", out + "/*.txt", "--transcriptions", t, "--output", str(folder / "links")], spark) == 0
    links = {(r.sentence_id, r.table_id): r for r in spark.read.parquet(str(folder / "links/links")).collect()}
    one = links["p1_s0001", "p1_table_01"]
    assert one.explicit_reference and one.linked and one.exact == 1 and one.status == "consistent"
    assert links["p1_s0002", "p1_table_02"].exact == 1 and not links["p1_s0002", "p1_table_01"].linked
    (folder / "labels.csv").write_text("document_id,sentence_id,text,gold_is_claim,gold_role,gold_type,gold_table\np1,p1_s0001,,yes,result,,Table 1\n")
    capsys.readouterr()
    assert main(["score", "--links", str(folder / "links"), "--labels", str(folder / "labels.csv")], spark) == 0
    assert json.loads(capsys.readouterr().out)["tp"] == 1


def test_empty_documents_can_stay(spark, folder):
    pages = spark.createDataFrame([("a", 1, "none"), ("b", 1, PAGE)], "document_id string, page int, text string")
    assert {r.document_id: r.num_tables for r in P.generate(pages, keep_empty=True).collect()} == {"a": 0, "b": 2}


def test_a_model_decides(spark):
    class Keyword:
        def predict(self, states, options):
            return [{k: (0.9 if k in ("result", "T2") else 0.1 / len(o)) for k in o} for o in options]

    pages = spark.createDataFrame([("d", 1, PAGE), ("d", 2, TEXT)], "document_id string, page int, text string")
    tables, _, _ = S.relational(P.generate(pages))
    _, links = P.link_claims(P.X.document_sentences(pages), tables, Keyword)
    got = {(r.sentence_id[-1], r.table_label): r.link_sources for r in links.collect()}
    assert got == {("1", "Table 1"): ["explicit_reference", "model+numeric"], ("1", "Table 2"): ["model"], ("2", "Table 1"): [], ("2", "Table 2"): ["model"]}


def test_the_status_rests_on_the_selected_row(spark):
    class SecondRow:
        def predict(self, states, options):
            return [{k: (0.9 if k in ("result", "T1", "r2", "contradicts") else 0.1 / len(o)) for k in o} for o in options]

    pages = spark.createDataFrame([("d", 1, PAGE), ("d", 2, "## 3. Results\n\nThe surface area of BetaY reached 48.0 m2/g and that of AlphaX 61.5 m2/g, as Table 1 shows.")], "document_id string, page int, text string")
    tables, _, _ = S.relational(P.generate(pages))
    _, links = P.link_claims(P.X.document_sentences(pages), tables, SecondRow)
    one = links.where("table_label = 'Table 1'").first()
    assert (one.row_index, one.exact, one.approx) == (1, 1, 1) and one.in_selected_row == 1 and one.status == "approximatelyConsistent"


def test_layout(tmp_path, monkeypatch):
    monkeypatch.setenv("GRIDQUILL_DATA_ROOT", str(tmp_path))
    assert Layout.at().merged("my ocr!").name == "corpus_my_ocr.json" and Layout.at("/x").predictions("").name == "tool.json"
    assert Layout.at().root == tmp_path and is_protected("a/Gold/b.json") and not is_protected("a/b.json")
