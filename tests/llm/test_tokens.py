import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquill.llm import mixing, tokens
from gridquill.llm.tokens import LONG, VOCABULARY, BytePairs

ALPHABET = ["'", "s", "l", "ll", "re", " ", "  ", "\n", "\t", "!", "a", "the", "1", "12", "é", "µ", "光", "한", "🔬", "A", "-", "’", "ing", "tion", "==", " ", "ve", "'s"]


@pytest.fixture(scope="module")
def pairs():
    return BytePairs.at(VOCABULARY)


def test_tree_concatenation_is_exact(pairs):
    rng = random.Random(3)
    for _ in range(3000):
        letters = rng.sample(ALPHABET, rng.choice([2, 4, len(ALPHABET)]))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 150)))
        size = rng.choice([1, 3, 7, 20, 40])
        leaves = [(t.encode(), pairs.ids(t)) for t in (text[i : i + size] for i in range(0, len(text), size))]
        assert pairs.concatenate(leaves).tolist() == pairs.encoding.encode_ordinary(text), text


def test_against_the_other_library(pairs):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    for text in ("Pores of 3–7 nm", "µmol g⁻¹ h⁻¹ <|endoftext|> x", "光催化 🔬  \n\n a'll"):
        assert own.encode(text, add_special_tokens=False).ids == pairs.ids(text).tolist()


def test_every_row_comes_out(spark, pairs):
    long = "a" * 20_000 + " word" * 4_000 + "光" * 9_000 + "\n" * 3_000
    rows = [(1, None), (2, ""), (3, " "), (4, "plain text"), (5, long), (5, long), (4, "plain text"), (6, "x" * LONG), (7, "y" * (LONG + 1)), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in tokens.encode(df).collect())
    assert got == sorted(((i or 0), pairs.ids(t).tolist() if t else []) for i, t in rows)
    counts = sorted(((r.doc_id or 0), r.n_tokens) for r in tokens.count_tokens(df).collect())
    assert counts == [(i, len(t)) for i, t in got]
    assert tokens.encode(df.limit(0)).count() == 0


def documents(spark):
    rows = [(i, "word " * (1 + i % 7), "ab"[i % 3 == 0], i) for i in range(600)] + [(1000, None, "a", 0), (1001, "", "b", 0), (1002, "x", None, 0), (1003, "x", "other", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    t = targets(spark, ("a", 0.3, 3), ("b", 0.5, 2), ("none", 0.2, 4), ("a", 0.3, 3))
    mixed = mixing.mix(documents(spark), t).collect()
    total = {s: sum(r.n_tokens * r.times for r in mixed if r.source == s) for s in "ab"}
    have = mixing.sized(documents(spark), t).groupBy("source").agg(F.sum("n_tokens")).collect()
    whole = sum(r[1] for r in have)
    assert all(r.times <= {"a": 3, "b": 2}[r.source] for r in mixed) and len({r.doc_id for r in mixed}) == len(mixed)
    for s, share in (("a", 0.3), ("b", 0.5)):
        cap = dict(have)[s] * {"a": 3, "b": 2}[s]
        want = min(share * whole, cap)
        assert abs(total[s] - want) <= 10 and total[s] <= cap
    out = {r.source: r for r in mixing.shares(documents(spark), t).collect()}
    assert out["none"].tokens == 0 and not out["none"].reached and out["a"].reached
    assert abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9


def test_thresholds_are_nested_and_exact(spark):
    sizes = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (1 + F.col("id") % 50).alias("n_tokens"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h")).cache()
    rows = sorted((r.h, r.n_tokens) for r in sizes.collect())
    sums = np.cumsum([n for _, n in rows])
    before = -1
    for rest in (1, 60, 5_000, 40_000, float(sums[-1]), float(sums[-1]) + 9):
        at = mixing.thresholds(sizes, [{"source": "a", "rest": rest}])["a"]
        taken = sum(h < at for h, _ in rows)
        floor = int(np.searchsorted(sums, rest, side="right"))
        under = rest - (sums[floor - 1] if floor else 0)
        nearer = floor < len(sums) and sums[floor] - rest < under
        assert taken == floor + nearer and at >= before
        before = at


def test_nothing_to_mix(spark):
    t = targets(spark, ("a", 1.0, 1))
    assert mixing.mix(documents(spark).limit(0), t).count() == 0 and mixing.mix(documents(spark), t.limit(0)).count() == 0
    assert mixing.shares(documents(spark).limit(0), t).first().tokens == 0
