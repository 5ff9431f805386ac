import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridquill.llm import noise as N
from gridquill.llm.canon import fold
from gridquill.session import read


def items_of(spark, small):
    return N.texts(read(spark, small, "gt_tables"), read(spark, small, "gt_mentions"))


def test_vectors_do_not_depend_on_layout(spark, small):
    items, pages = items_of(spark, small), read(spark, small, "ocr_pages")
    one = N.learn(items, pages).vectors
    other = N.learn(items.repartition(7, F.xxhash64("text")).sortWithinPartitions(F.desc("text")), pages.repartition(3)).vectors
    assert len(one) > 100 and set(one) == set(other)
    assert max(np.abs(one[w] - other[w]).max() for w in one) < 1e-4


def test_every_pair_within_the_window_is_counted(spark, small):
    items = items_of(spark, small)
    vocabulary = ["area", "band", "gap", "mean", "of", "rate", "surface", "the"]
    number, want = {w: k for k, w in enumerate(vocabulary)}, Counter()
    for r in items.select("text").collect():
        known = [number[w] for w in re.split(r"[^\w|!$-]+|_", r.text.lower()) if w in number]
        for far in range(1, N.WINDOW + 1):
            for a, b in zip(known, known[far:], strict=False):
                want[min(a, b), max(a, b)] += N.WINDOW + 1 - far
    assert {(r.a, r.b): r.n for r in N.pair_counts(items, vocabulary).collect()} == want


def test_words_of_one_context_are_near_each_other(spark):
    lines = [f"{x} {y} {z}" for x in ("heat", "warm") for y in ("removes", "drives") for z in ("water", "steam")] * 6 + [f"{x} {y} {z}" for x in ("bolt", "nut") for y in ("holds", "joins") for z in ("plate", "rod")] * 6
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    v = N.vectors(rows, sorted({w for x in lines for w in x.split()}))
    assert v["heat"] @ v["water"] > 0.5 > abs(v["heat"] @ v["plate"]) + 0.3 and all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert N.vectors(rows, []) == {} and N.vectors(rows.limit(0), ["heat", "nut"]) == {}


def test_words_of_odd_texts_are_counted(spark):
    odd = ["ΛΟΓΟΣ of İzmir's ﬁlms, x-ray|x", "", None, "---", "a b a", "日本語 é 𝛼β 10!"]
    rows = spark.createDataFrame([(x,) for x in odd], "text string")
    got = {r.word: (r.n, r.own) for r in N.word_counts(rows, rows.limit(0)).collect()}
    assert got["λογος"] == (1, 1) and got["a"] == (2, 2) and got["x-ray|x"] == (1, 1) and got["10!"] == (1, 1) and got["日本語"] == (1, 1) and "" not in got
    assert {r.word for r in N.word_counts(rows.limit(0), rows).collect()} == {w for w in got if len(w) > 1}


def test_whole_texts_are_folded_as_words_are():
    for text in ["Çourn. Ph0tochem!stry  A, 12|345 (2019)\n6–9 $vv ﬁlm", "١٢٣ rn cl \x1f!ll", "", "日本 7#7 h\udc80q"]:
        assert N._flat(text) == re.sub(r"\s+", " ", re.sub(r"\d+", "#", fold(re.sub(r"\d", "7", text.lower())))).strip()
