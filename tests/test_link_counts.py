from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridquill.functions import text as T
from gridquill.plans import corpus_queries as Q
from gridquill.plans import pipelines as P
from gridquill.session import read
from gridquill.sources.corpus import ground_truth

CELL = "struct<kind:string,s:string,i:bigint,d:double>"


def word(s):
    return ("s", s, None, None)


def number(d):
    return ("f", str(d), None, d)


@pytest.fixture(scope="module")
def compendium(spark):
    """A document whose tables stand in different fifties of the global id, and a small one across such a border."""
    tables = [("c", n, f"t{n}", label, "", ["Sample", "Area (m2/g)"], "", [[word("AlphaX"), number(v)], [word("BetaY"), number(v + 100)]]) for n, label, v in [(10, "Table 1", 61.5), (70, "Table 2", 7.31), (130, "Table 3", 61.54), (190, "Table 3", 0.55)]]
    tables += [("o", 49, "t49", "Table 1", "", ["Sample", "Area (m2/g)"], "", [[word("AlphaX"), number(12.7)]]), ("o", 50, "t50", "", "", ["Sample", "Area (m2/g)"], "", [[word("AlphaX"), number(3.25)]])]
    said = ["The surface area of AlphaX reached 61.5 m2/g, as Table 3 shows for it.", "The highest rate of all the samples was 7.31 in the second run, see Table 1.", "The rate increased in line with what was observed for the other samples.", "The rate increased up to 987.6 in the course of the second run, as seen.", "The lowest rate that we measured was 0.55 for the third of the samples."]
    rows = [("c", i, f"c{i}", 1, "3. Results", x) for i, x in enumerate(said)] + [("o", 9, "o9", 1, "3. Results", "The value of the first sample was 3.25, higher than the 12.7 of Table 1."), ("x", 8, "x8", 1, "3. Results", said[0])]
    s = spark.createDataFrame(rows, "document_id string, sent_pos int, sentence_id string, page int, section string, text string").withColumn("table_refs", T.table_references(F.col("text")))
    t = spark.createDataFrame(tables, f"document_id string, table_pos int, table_id string, table_label string, caption string, columns array<string>, section_title string, rows array<array<{CELL}>>")
    return s, t


def tally(counts):
    return {(r.status, tuple(r.link_sources)): r.n for r in counts.collect()}


def test_counts_are_those_of_the_pairs(compendium):
    s, t = compendium
    _, links = P.link_claims(s, t)
    want = Counter((r.status, tuple(r.link_sources)) for r in links.collect())
    got = tally(P.counted_links(s, t))
    assert got == want and sum(got.values()) == 5 * 4 + 2
    assert got["consistent", ("explicit_reference",)] >= 1  # table 3 of the document, three fifties further on


def test_run_pairs_sentences_with_all_tables_of_their_document(spark, small):
    t, _ = ground_truth(spark, small)
    m = read(spark, small, "gt_mentions").dropDuplicates(["mention_id"]).where("text is not null")
    candidates = m.where(P.L.is_candidate(T.scientific(F.col("text")), F.lit("3. Results")))
    most = candidates.join(t.select("document_id", "table_id"), "document_id").count()
    got = sum(r.n for r in Q.q_l13_link_run(spark, small).collect())
    assert 0.95 * most < got <= most  # all but the candidates that are dumps of a table


def test_nothing_that_grows_is_broadcast(spark, compendium, monkeypatch):
    plans = []

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(P, "settled", settled)
    monkeypatch.setattr(P.L, "settled", settled)
    spark.conf.set("spark.sql.defaultSizeInBytes", "1000")  # as little as Spark may take tables for
    try:
        settled(P.counted_links(*compendium))
    finally:
        spark.conf.unset("spark.sql.defaultSizeInBytes")
    assert len(plans) == 6 and "Broadcast" not in "".join(plans)
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8
