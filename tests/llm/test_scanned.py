import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquill.llm import noise as N
from gridquill.llm import truncation as T

BODY = ["The mean particle diameter of the spherical granules was measured by spectroscopy.", "A selectivity of the samples was obtained under a xenon lamp.", "Table 2 lists the surface area of the light-emitting samples and films.", "Product distribution over the granules under a halogen source."]
COUNTS = {w: 500 for b in BODY for w in b.lower().replace(".", "").split()} | {"light-emitting": 300, "cu-": 3}


@pytest.fixture(scope="module")
def repair():
    return N.Repair(N.Lexicon(COUNTS), ["Aa et al. / Aa. # ( # )"])


@pytest.mark.parametrize(
    ("text", "clean", "defects"),
    [
        ("A select-\nivity of the samples", "A selectivity of the samples", ["hyphen"]),
        ("A select¬ \r\nivity of the sam­\nples", "A selectivity of the samples", ["hyphen"]),
        ("light-\nemitting samples", "light-emitting samples", []),
        ("Pores of 10-\n20 nm", "Pores of 10-20 nm", []),
        ("tbe surfacc area of the sarnples", "the surface area of the samples", ["chars"]),
        ("Ta6le 2 l!sts the spherlcal ﬁlms", "Table 2 lists the spherical films", ["chars"]),
        ("A selectivity\n\n– 9 –\n\nof the samples", "A selectivity of the samples", ["pageno"]),
        ("A selectivity\nLümmerich et al. / J. Imag. Photochem. 1 (2019) 669\nof the samples", "A selectivity of the samples", ["header"]),
        ("A selectivity\nLIST OF THE FILMS 12\nof the samples", "A selectivity of the samples", ["header"]),
        ("One line.\nSecond line of it.\n\nA new paragraph.", "One line. Second line of it.\n\nA new paragraph.", []),
        ("", "", []),
    ],
)
def test_repair(repair, text, clean, defects):
    assert repair.all(text, ["list of the films"]) == (clean, defects)


def test_context_decides_between_candidates():
    up, side = np.array([1.0, 0.0], np.float32), np.array([0.0, 1.0], np.float32)
    lexicon = N.Lexicon({"beat": 400, "heat": 400, "removed": 900, "drum": 900}, {"beat": side, "heat": up, "removed": up, "drum": side})
    assert {w for w, _ in lexicon.linked("6eat")} == {"beat", "heat"}
    assert lexicon.corrected("6eat", ["removed"]) == "heat" and lexicon.corrected("6eat", ["drum"]) == "beat"


def test_context_decides_whether_a_rare_word_is_a_misreading():
    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32)
    near, far = rng.normal(size=8), rng.normal(size=8)
    vectors = {f"w{i}": unit(rng.normal(size=8)) for i in range(300)} | {"see": unit(near), "we": unit(near + 0.1), "can": unit(near - 0.1), "dried": unit(-near), "stirred": unit(-near + 0.1)}
    counts = dict.fromkeys(vectors, 900) | {"see": 40, "sec": 1}
    with_, without = N.Lexicon(counts, vectors), N.Lexicon(counts)
    assert with_.corrected("sec", ["we", "can"]) == "see" and with_.corrected("sec", ["dried", "stirred"]) is None
    assert without.corrected("sec", ["we", "can"]) is None  # 40 times as frequent is too little without context


def test_forms_of_headers_are_learnt_from_pages(spark):
    names = ["Abel", "Born", "Curie", "Dirac", "Euler"]
    pages = [(f"d{d}", p, f"{n} et al. / J. Imag. Chem. {d} (201{d}) {700 + p}\n{BODY[p % 4]}\nmore {p}{d}") for d, n in enumerate(names) for p in range(1, 4)]
    lines = N.header_lines(spark.createDataFrame(pages, "document_id string, page int, text string"))
    forms = N.forms_of(lines)
    assert forms == ["Aa et al. / Aa. # ( # )"]
    tool = N.Repair(N.Lexicon(COUNTS), forms)
    assert tool.all("A selectivity Gauss et al. / Adv. Test 9 (1999) 12 of the samples", [])[1] == []
    assert tool.all("A selectivity\nGauss et al. / Adv. Test. 9 (1999) 12\nof the samples", []) == ("A selectivity of the samples", ["header"])


def test_pages_far_apart_share_no_running_header(spark):
    rows = [("d", p, f"{'Chapter head' if p in (3, 5) else 'Odd line'} \nbody {p} of the text\nend") for p in (1, 3, 5, 60)]
    got = {r.header for r in N.header_lines(spark.createDataFrame(rows, "document_id string, page int, text string")).collect()}
    assert got == {"chapter head"}


def relations(spark):
    tables = [(i, f"d{i % 5}", "e", "Note: " * (i % 13) + BODY[i % 4], 1) for i in range(60)] + [(100, "d1", "e", "A select-\nivity of tbe samples", 1), (100, "d1", "e", "A select-\nivity of tbe samples", 2), (101, None, None, None, 1), (102, "d1", "e", "", 1), (103, "d1", "e", "y" * 30_000, 1)]
    mentions = [(i, f"d{i % 5}", "e", BODY[(i + 1) % 4], 1) for i in range(60)] + [(200, "d1", "e", "A selectivity\nMy Running Head 7\nof the samples.", 1), (201, "nowhere", "e", "12\nA selectivity of the samples.", 1), (202, "d1", None, None, 1)]
    pages = [(f"d{d}", p, f"My Running Head {p}\n{BODY[p % 4]} {chr(97 + d) * 3}\nother text {chr(97 + p)}{chr(97 + d)}") for d in range(5) for p in range(1, 6)] + [("d1", 9, None), ("d1", 10, "")]
    return (
        spark.createDataFrame(tables, "table_no bigint, document_id string, engine string, caption string, defects int"),
        spark.createDataFrame(mentions, "mention_id bigint, document_id string, engine string, text string, header int"),
        spark.createDataFrame(pages, "document_id string, page int, text string"),
    )


def test_found_once_per_text_and_defect(spark):
    got = {(r.field, r.item_id, r.defect) for r in N.found(*relations(spark)).collect()}
    assert got == {("caption", 100, "hyphen"), ("caption", 100, "chars"), ("mention", 200, "header"), ("mention", 201, "pageno")}
    out = {(r.field, r.item_id): r.text for r in N.repaired(*relations(spark)).collect()}
    assert out["caption", 100] == "A selectivity of the samples" and out["mention", 200] == "A selectivity of the samples."
    assert ("caption", 101) not in out and ("caption", 102) not in out and len(out["caption", 103]) == 30_000


def test_no_texts(spark):
    t, m, p = relations(spark)
    assert N.found(t.limit(0), m.limit(0), p.limit(0)).count() == 0
    assert T.found(t.limit(0), m.limit(0), p.limit(0)).count() == 0 and T.rates(t.limit(0), m.limit(0), p).count() == 0


def test_censored_fit_finds_the_true_lengths():
    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(4.6, 0.5, 20_000)).astype(int)
    n, c = np.unique(np.minimum(true, 150), return_counts=True)
    mean, dev = T.censored_fit(n, c, n == 150)
    assert abs(mean - 4.6) < 0.02 and abs(dev - 0.5) < 0.02
    found = T.limits(n, c)
    assert found[150] > 0.95 and set(found) <= {149, 150}
    assert T.limits(*np.unique(true, return_counts=True)) == {}
    assert T.limits(np.array([], int), np.array([], int)) == {}


def test_cut_texts(spark):
    t, m, p = relations(spark)
    more = spark.createDataFrame([(i, "d1", "e", x, 0) for i, x in [(500, "A selectivity of the sam"), (501, "Product distribution over the granules under a"), (502, "Product distribution over the…"), (503, "Table 3"), (504, "Product distribution over the granules under a halogen source")]], t.schema)
    said = spark.createDataFrame([(600, "d1", "e", "Table 2 lists the surface", 0), (601, "d1", "e", "Table 2 lists the surface area.\n12", 0), (602, "d1", "e", "It is seen (Fig.", 0), (603, "d1", "e", "Dried for 9 h.", 0)], m.schema)
    got = {(r.field, r.item_id) for r in T.found(t.unionAll(more), m.unionAll(said), p).where(F.col("item_id") >= 500).collect()}
    assert got == {("caption", 500), ("caption", 501), ("caption", 502), ("mention", 600), ("mention", 602)}


def test_headers_of_a_hot_document_stay_few(spark):
    pages = spark.range(4000).select(F.lit("hot").alias("document_id"), F.col("id").cast("int").alias("page"), F.concat(F.lit("The Head Of All\nbody number "), (F.col("id") % 1500).cast("string"), F.lit(" of text\nmore"), F.col("id").cast("string")).alias("text"))
    pages = pages.withColumn("text", F.regexp_replace("text", "number (\\d)", "number $1x"))
    got = N.running_headers(pages).first()
    assert "the head of all" in got.headers and len(got.headers) <= 80


def test_what_endings_say_is_learnt_from_the_values_at_limits():
    def fit(p, times=1):
        counts = [("caption", "e", p, "ends 2^-9", 120), ("caption", "e", p, "unfinished", 150), ("caption", "e", 0.0, "ends 2^-9", 4), ("caption", "e", 0.0, "ends 2^-1", 900), ("caption", "e", 0.0, "closed", 700), ("caption", "e", 0.0, "mark", 6)]
        odds, lost = T.endings_fit([(f, e, q, k, n * times) for f, e, q, k, n in counts])
        return odds["caption", "ends 2^-9"] + np.log(lost["caption", "e"] / (1 - lost["caption", "e"])), lost["caption", "e"]

    anchored, rate = fit(0.97)
    assert anchored > 0 and rate < 0.03  # the four texts off the limit are taken for cut, too
    assert fit(0.97, 100)[0] > 0  # at any size of the data
    assert fit(0.0)[1] > 3 * rate  # without the censored fit, cuts at the limit pass for losses in transfer


def test_the_censored_fit_changes_what_is_found(spark):
    t, m, p = relations(spark)
    long = "Product distribution over the spherical granules under a halogen source and the films "
    more = spark.createDataFrame([(1000 + i, f"d{i % 5}", "f", (f"Run {i} " + long * 3)[: 100 if i % 2 else 30 + i], 0) for i in range(120)], t.schema)
    on, off = (T.judged(t.unionAll(more), m, p, fit_limits=x).where("item_id >= 1000 and field = 'caption'") for x in (True, False))
    at_limit = {r.item_id: r.censored for r in on.collect() if r.item_id % 2}
    assert min(at_limit.values()) > 0.9 and {r.censored for r in off.collect()} == {0.0}
    assert on.where("cut and n_chars = 100").count() >= 55 and off.where("cut_odds > 2").count() < on.where("cut_odds > 2").count()
