import pytest

pytest.importorskip("gridquill.llm.queries")
import __spark_entry__ as entry
from gridquill.llm import queries as llm

COLUMNS = {
    "p2_found": [("field", "string"), ("item_id", "bigint"), ("defect", "string")],
    "p4_found": [("table_no", "bigint"), ("section_id", "int")],
    "p5_found": [("field", "string"), ("item_id", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.dtypes == COLUMNS[name])
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_every_document_has_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(r.doc_id for r in llm.p6_ids(spark, small).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
