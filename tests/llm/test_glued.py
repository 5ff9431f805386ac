import pytest
from test_encoding import CLEAN

from gridquill.llm import encoding as E


@pytest.fixture(scope="module")
def model():
    words = E.Counter()
    for i, t in enumerate(list(CLEAN.values()) * 12):
        words.update(E.words_of(f"{t} {i}"))
    return E.Classifier.trained(words)


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252>utf-8>cp1252", "utf-8>gb18030"])
def test_garbled_passages_glued_to_clean_characters(model, chain):
    before, wrong, after = "焙烧后生成速率明显下降，", "甲烷的生成速率为。将粉末", "然后与催化剂混合。"
    if "gb18030" in chain:  # pairs of its bytes must be characters
        wrong = next(x for n in range(8, 3, -1) for k in range(len(wrong) - n + 1) if E.garble(x := wrong[k : k + n], chain))
    bad = E.garble(wrong, chain)
    assert bad and bad != wrong
    for head, tail in ((before, ""), ("", after), (before, after)):
        got = E.explain(head + bad + tail, model)
        assert got and got[1] == head + wrong + tail, (head, tail)


def test_clean_words_stay(model):
    for text in CLEAN.values():
        assert [w for w in E.words_of(text) if E.explain(w, model)] == []
