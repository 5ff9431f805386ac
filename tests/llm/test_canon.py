import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridquill.llm import canon as C

LIST = [(1, "Introduction", None), (5, "Results and discussion", None), (6, "Results", None), (7, "Discussion", None), (9, "X-ray diffraction", "XRD"), (15, "Infrared spectroscopy", "FTIR"), (14, "UV-vis spectroscopy", "DRS"), (20, "Reactor configuration", None), (21, "Effect of temperature", None), (22, "Effect of light intensity", None), (4, "Catalyst preparation", None)]
NAMED = [
    ("3.2 Results & Discussion of the films", 5), ("rESU1TS AND DISCUSSION", 5), ("Res. & disc.", 5), ("Discussion and Results:", 5), ("R E S U L T S", 6), ("Resutls", 6), ("D I S C U S S I O N", 7), ("## 4 Intro.", 1), ("4.2 XRD results", 9),
    ("X-ray\ndiffraction (continued)", 9), ("IR spectroscopy", 15), ("UV-VIS SPECTR.", 14), ("TEMP. EFFECT", 21), ("**Effect of light intensity – part 1**", 22), ("Catalystpreparation", 4), ("IV. reactor config.", 20),
]
UNNAMED = ["Reactor cleaning", "Effect of pH", "Catalyst deactivation", "Batch 57", "Table 8", "n/a", "17", "Qiresh et al.", "Funding"]


@pytest.fixture(scope="module")
def canon():
    return C.Canon(LIST)


@pytest.mark.parametrize(("value", "entry"), NAMED)
def test_named(canon, value, entry):
    assert canon.match(value)[0] == entry


@pytest.mark.parametrize("value", UNNAMED)
def test_unnamed(canon, value):
    assert canon.match(value)[0] == 0


def edits(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_distance(a, b):
    assert C.distance(a, b) == edits(a, b)


def test_rows(spark):
    entries = spark.createDataFrame(LIST, "section_id int, section_name string, short_form string")
    rows = [(1, "Results", 5), (1, "Results", 6), (2, None, 0), (3, "  \n", 0), (4, "Funding", 0), (5, "x" * 50_000, 0)]
    df = spark.createDataFrame(rows, "table_no bigint, section_title string, entry_id int")
    got = {(r.table_no, r.entry_id) for r in C.assign(df, "table_no", "section_title", entries).collect()}
    assert got == {(1, 6), (4, 0), (5, 0)}
    assert C.assign(df.limit(0), "table_no", "section_title", entries).count() == 0
    assert {r.entry_id for r in C.assign(df, "table_no", "section_title", entries.limit(0)).collect()} == {0}
    assert {r.section_title[:7]: r.n_rows for r in C.unmatched(df, "table_no", "section_title", entries).collect()} == {"Funding": 1, "xxxxxxx": 1}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([n.lower() for _, n, _ in LIST]), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("aeirnlmtsx1 .")), max_size=5), st.booleans())
def test_the_index_loses_no_entry(canon, name, edits_, cut):
    text = list(name)
    for at, c in edits_:
        text[at % (len(text) or 1) : at % (len(text) or 1) + (at % 3)] = c
    text = "".join(text)[: -3 if cut else None]
    got = canon.similar(text)
    whole = [(m[1], bool(m[2])) for m in C.re.finditer(r"([\w|!$’']+)(\.?)", text) if m[1] not in C.EMPTY]
    squeezed = C.squeeze(C.re.sub(r"\b(?:and|&)\b", "and", text))
    every = max((max(canon._by_words(whole, canon.words[i], s), C.alike(squeezed, C.squeeze(n)) - 0.02), -i) for i, n, s in canon.entries)
    assert every[0] < C.LEAST or got == (every[0], -every[1])


def test_all_mentions_that_do_not_overlap(canon):
    assert canon.match("XRD and FTIR, then Results and discussion")[3] == [5, 15, 9]
    assert canon.match("Catalyst preparation")[3] == [4] and canon.match("nothing")[3] == []


def test_a_long_list_costs_no_comparison_with_each_entry():
    names = [(i, f"{a}{b}{c} {b}{a} city", None) for i, (a, b, c) in enumerate((x, y, z) for x in ("bal", "tor", "min", "quel", "sham") for y in ("ando", "ieri", "ulsk", "ovnia", "erth") for z in ("grad", "ville", "mouth", "stedt", "holm", "polis", "fjord", "wick"))]
    long = C.Canon(names)
    assert long.similar("balandograd andobal citv")[1] == 0 and len(long.candidates("balandograd")) < len(names) / 2
