import pytest

from gridquill.llm import encoding as E

CLEAN = {
    "en": "Pores of 22–60 nm dominate; the Ångström-scale shift “as received” is ±3 % at 450 °C for Brüggsol and Öströmby, µ ≈ 3 × 10⁻³.",
    "fr": "Grâce à l’intensité de 85 mW, la sélectivité des poudres dopées à l’argent diminue après l’été, L’âge du dépôt.",
    "ru": "Полученные образцы сушили при температуре, затем добавляли катализатор. Результаты показывают, что волокна сохраняют активность.",
    "zh": "将粉末在550 °C下干燥，然后与催化剂混合。焙烧后生成速率明显下降，而甲烷的生成速率为。",
    "pt": "RELAÇÃO ENTRE A CALCINAÇÃO E A absorção óptica: NÃO houve formação, então a solução foi agitada.",
    "decoy": "CHÂSSIS Â, PÂTE, NÃO, ÃO; Å, Ä, ß, Þ. &deg;C и été",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t + f" {i}", "x") for i, t in enumerate(list(CLEAN.values()) * 12)], "doc_id bigint, text string, chains string")


@pytest.fixture(scope="module")
def model(corpus):
    return E.train(corpus)


@pytest.mark.parametrize("chain", list(E.CHAINS))
def test_garbling_is_inverted_exactly(chain):
    for text in CLEAN.values():
        bad = E.garble(text, chain)
        if bad is not None and bad != text:
            assert E.invert(bad, chain) == text


CASES = [("utf-8>cp1252", "en"), ("utf-8>latin-1", "fr"), ("utf-8>cp437", "fr"), ("utf-8>mac-roman", "en"), ("utf-8>cp1251", "ru"), ("utf-8>cp1252>utf-8>cp1252", "en"), ("cp1251>cp1252", "ru"), ("cp866>cp1251", "ru"), ("koi8-r>cp1251", "ru"), ("gb18030>latin-1", "zh"), ("utf-8>cp1250", "zh"), ("utf-8>latin-1", "pt")]


def test_restores_what_was_garbled_and_leaves_the_rest(spark, corpus, model):
    rows = [(i, E.garble(CLEAN[k], c), CLEAN[k]) for i, (c, k) in enumerate(CASES)]
    rows += [(100, "a&#195;&#169;b stays", "aéb stays"), (101, f"{CLEAN['en']} {E.garble('Für die Bandlücke', 'utf-8>cp1252')} früher", f"{CLEAN['en']} Für die Bandlücke früher")]
    clean = [(200 + i, t, t) for i, t in enumerate(CLEAN.values())] + [(300, None, None), (301, "", ""), (302, "plain ASCII &#65;", "plain ASCII &#65;"), (303, "x" * 200_000, "x" * 200_000)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows + clean], "doc_id bigint, text string")
    got = {r.doc_id: r for r in E.restore(df, model).collect()}
    for i, _, want in rows:
        assert got[i].text == want, i
        assert got[i].chains
    for i, text, _ in clean:
        assert got[i].text == text and not got[i].chains, i


def test_lost_passages_are_found(spark, model):
    df = spark.createDataFrame([(1, "L��ge du d�p�t"), (2, "fine"), (1, "L��ge du d�p�t")], "doc_id bigint, text string")
    rows = E.restore(df, model, affected_only=True).collect()
    assert [(r.doc_id, r.lost) for r in rows] == [(1, 2), (1, 2)]


def test_empty(corpus):
    assert E.found(corpus.limit(0)).count() == 0
