from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridquill.operators import evaluate as E

TABLES = "document_id string, source_pdf string, table_pos int, table_id string, table_label string, page int, caption string, columns array<string>, section_title string, mentions array<string>"
CELLS = "document_id string, table_id string, row_no int, col_no int, cell struct<kind:string,s:string,i:bigint,d:double>"


def corpus(spark, tag=""):
    t = [("d1", "x/a.pdf", 1, f"{tag}t1", "Table 1", 1, "Pore volume of the films", ["a", "b"], "Results", ["See Table 1 here", "More"]), ("d1", "x/a.pdf", 2, f"{tag}t2", "", 3, "Rates", ["c"], "", []), ("d2", "b.pdf", 1, f"{tag}t3", "Table 1", 1, "", [], "", [])]
    c = [("d1", f"{tag}t1", r, k, ("f", str(r + k / 10), None, r + k / 10)) for r in range(2) for k in range(2)] + [("d1", f"{tag}t2", 0, 0, ("s", "x", None, None))]
    return spark.createDataFrame(t, TABLES), spark.createDataFrame(c, CELLS)


def test_a_corpus_agrees_with_itself(spark):
    g, p = corpus(spark), corpus(spark, "p")
    got = {r.field: (r.accuracy, r.precision, r.recall, r.f1) for r in E.evaluate(*g, *p).collect()}
    assert set(got.values()) == {(1.0, 1.0, 1.0, 1.0)}


def test_one_cell_of_four(spark):
    g, (pt, pc) = corpus(spark), corpus(spark, "p")
    pc = pc.withColumn("cell", F.when((F.col("row_no") == 1) & (F.col("col_no") == 1), F.struct(F.lit("s").alias("kind"), F.lit("?").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))).otherwise(F.col("cell")))
    docs = spark.createDataFrame([("d1", "d1"), ("d2", "d2")], "gold_id string, pred_id string")
    got = {r.gold_table: r.cells for r in E.score_tables(g[0], pt, g[1], pc, docs).collect()}
    assert got == {"t1": 0.75, "t2": 1.0, "t3": None}


def test_missing_documents_and_page_match(spark):
    (gt, gc), (pt, pc) = corpus(spark), corpus(spark, "p")
    pt = pt.where("document_id = 'd1'").withColumn("table_label", F.lit(""))
    docs = E.matched_documents(*[x.select("document_id", "source_pdf", F.lit(0).alias("doc_pos")).distinct() for x in (gt, pt)])
    got = {r.gold_table: r.pred_table for r in E.matched_tables(gt, pt, docs).collect()}
    assert got == {"t1": "pt1", "t2": "pt2", "t3": None}
    d = {r.field: r for r in E.evaluate(gt, gc, pt, pc).collect()}["detection"]
    assert (d.recall, d.precision) == (0.6667, 1.0)


def reference_scores(a, b):
    if not a and not b:
        return 1.0, 1.0, 1.0
    if not a or not b:
        return 0.0, 0.0, 0.0
    both = sum((Counter(a) & Counter(b)).values())
    p, r = both / len(b), both / len(a)
    return p, r, 2 * p * r / (p + r) if both else 0.0


words = st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=5, max_size=30))
def test_token_scores_both_ways(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    s = E.token_scores(F.col("a"), F.col("b"))
    inline = {r.i: (r.p, r.r, r.f) for r in df.select("i", s.precision.alias("p"), s.recall.alias("r"), s.f1.alias("f")).collect()}
    bags = {r.i: (r.precision, r.recall, r.f1) for r in E.bag_scores(df.select("i", F.col("a").alias("tokens")), df.select("i", F.col("b").alias("tokens")), "i").collect()}
    for i, (a, b) in enumerate(pairs):
        want = [round(x, 9) for x in reference_scores(a, b)]
        assert [round(x, 9) for x in inline[i]] == want and [round(x, 9) for x in bags[i]] == want


def test_empty_corpora(spark):
    t, c = corpus(spark)
    got = {r.field: r for r in E.evaluate(t.limit(0), c.limit(0), t.limit(0), c.limit(0)).collect()}
    assert got["detection"].f1 == 1.0 and got["cells"].f1 is None
