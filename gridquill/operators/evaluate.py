"""A predicted corpus scored against a reference corpus.

Relations: ``tables`` (source_pdf, document_id, table_pos, table_id, table_label, page, caption,
columns, section_title, mentions array<string>) and ``cells`` (table_id, row_no, col_no, cell).
Documents meet on the file name, else on the id; tables on the first equal label, else the
first equal page; cells on their position. All of these are equi-joins on pre-aggregated sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquill.functions import latex
from gridquill.functions import text as T

SOFT = 0.5


@dataclass(frozen=True)
class Scores:
    precision: Column
    recall: Column
    f1: Column


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def bag(tokens: Column) -> Column:
    """A bag of tokens as a set: the n-th occurrence of a token is its own element."""
    return T.let(F.array_sort(tokens), lambda s: F.transform(s, lambda t, i: F.concat(t, F.lit(" "), (i - F.array_position(s, t)).cast("string"))))


def score_struct(gold: Column, predicted: Column) -> Column:
    """struct<precision,recall,f1> of two columns that hold bags; two empty ones agree, one empty one fails."""

    def from_overlap(both: Column) -> Column:
        n, m = F.size(gold), F.size(predicted)
        either = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
        pr = F.struct(F.coalesce(either, both / F.greatest(m, F.lit(1))).alias("precision"), F.coalesce(either, both / F.greatest(n, F.lit(1))).alias("recall"))
        return T.let(pr, lambda x: F.struct(x["precision"].alias("precision"), x["recall"].alias("recall"), harmonic(x["precision"], x["recall"]).alias("f1")))

    return T.let(F.size(F.array_intersect(gold, predicted)).cast("double"), from_overlap)


def scores_of(gold: Column, predicted: Column) -> Scores:
    s = score_struct(gold, predicted)
    return Scores(s["precision"], s["recall"], s["f1"])


def token_scores(gold: Column, predicted: Column) -> Scores:
    """As ``scores_of``, of two token arrays."""
    return scores_of(bag(gold), bag(predicted))


def bag_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """key, precision, recall, f1 for long texts: token counts of both sides joined, no nested loops.

    Both sides have ``key`` and ``tokens array<string>``; every key of ``gold`` comes out.
    """
    count = lambda df, n: df.select(key, F.explode("tokens").alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias(n))
    shared = count(gold, "n").join(count(predicted, "m"), [key, "t"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("both"))
    sizes = gold.select(key, F.size("tokens").alias("n")).join(predicted.select(key, F.size("tokens").alias("m")), key, "left").fillna(0, ["m"])
    x = sizes.join(shared, key, "left").fillna(0, ["both"])
    either = F.when((F.col("n") == 0) & (F.col("m") == 0), 1.0).when((F.col("n") == 0) | (F.col("m") == 0), 0.0)
    x = x.withColumn("precision", F.coalesce(either, F.col("both") / F.greatest("m", F.lit(1)))).withColumn("recall", F.coalesce(either, F.col("both") / F.greatest("n", F.lit(1))))
    return x.select(key, "precision", "recall", harmonic(F.col("precision"), F.col("recall")).alias("f1"))


def cell_equal(gold: Column, predicted: Column) -> Column:
    """Numbers within a millionth of the larger of 1 and the reference value, else equal normalised text."""
    number = lambda c: F.coalesce(c["d"], c["i"].cast("double"))
    a, b = number(gold), number(predicted)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(a))).otherwise(T.scientific(gold["s"]) == T.scientific(predicted["s"]))


def source_key(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def matched_documents(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold_id, pred_id (null where none): by file name, else by id; the last of duplicates wins.

    Both sides have document_id, source_pdf, doc_pos.
    """
    p = predicted.select("document_id", source_key(F.col("source_pdf")).alias("key"), "doc_pos")
    by_key = p.groupBy("key").agg(F.max_by("document_id", "doc_pos").alias("by_key"))
    by_id = p.groupBy(F.col("document_id").alias("by_id")).agg(F.lit(1).alias("_"))
    g = gold.select(F.col("document_id").alias("gold_id"), source_key(F.col("source_pdf")).alias("key")).distinct()
    x = g.join(by_key, "key", "left").join(by_id.drop("_"), F.col("gold_id") == F.col("by_id"), "left")
    return x.select("gold_id", F.coalesce("by_key", "by_id").alias("pred_id"))


def matched_tables(gold: DataFrame, predicted: DataFrame, documents: DataFrame) -> DataFrame:
    """gold_id, pred_id, gold_table, pred_table (null where none) for each reference table.

    ``gold`` and ``predicted`` have document_id, table_pos, table_id, table_label, page. First the
    first predicted table with the same label, else the first on the same page; one predicted
    table may serve several.
    """
    first = lambda key: predicted.where(F.length(key) > 0).groupBy("document_id", key).agg(F.min_by("table_id", "table_pos").alias(f"by_{key}"))
    g = gold.select(F.col("document_id").alias("gold_id"), F.col("table_id").alias("gold_table"), "table_pos", "table_label", "page").join(documents, "gold_id", "left")
    for key in ("table_label", "page"):
        side = first(key).withColumnRenamed("document_id", "pred_id")
        g = g.join(side, ["pred_id", key], "left")
    return g.select("gold_id", "pred_id", "gold_table", "table_pos", F.coalesce("by_table_label", "by_page").alias("pred_table"))


def cell_scores(gold: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """gold_table, cell_accuracy: share of equal cells; 0 where the shapes differ, null where both are empty.

    Cells meet on (pair, row, column); a table's shape is its cells' largest row and column.
    """
    p = pairs.where("pred_table is not null").select("gold_table", "pred_table")
    shape = lambda df, name, tag: df.groupBy(F.col("table_id").alias(name)).agg(F.max("row_no").alias(f"{tag}_rows"), F.max("col_no").alias(f"{tag}_cols"), F.count(F.lit(1)).alias(f"{tag}_n"))
    a = gold.withColumnRenamed("table_id", "gold_table").join(p, "gold_table").select("gold_table", "pred_table", "row_no", "col_no", F.col("cell").alias("a"))
    b = predicted.select(F.col("table_id").alias("pred_table"), "row_no", "col_no", F.col("cell").alias("b"))
    hits = a.join(b, ["pred_table", "row_no", "col_no"]).groupBy("gold_table").agg(F.count_if(cell_equal(F.col("a"), F.col("b"))).alias("hits"))
    x = p.join(shape(gold, "gold_table", "g"), "gold_table", "left").join(shape(predicted, "pred_table", "p"), "pred_table", "left").join(hits, "gold_table", "left")
    same = F.col("g_rows").eqNullSafe(F.col("p_rows")) & F.col("g_cols").eqNullSafe(F.col("p_cols"))
    return x.select("gold_table", F.when(~same, 0.0).when(F.col("g_n").isNotNull(), F.coalesce("hits", F.lit(0)) / F.col("g_n")).alias("cell_accuracy"))


def header_scores(gold: Column, predicted: Column) -> Column:
    """Mean token scores, as ``score_struct``, of headers in the same place, from two arrays of bags; null where the widths differ."""
    n = F.size(gold)

    def means(each: Column) -> Column:
        mean = lambda k: F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v[k]) / n
        one = F.struct(*[F.lit(1.0).alias(k) for k in ("precision", "recall", "f1")])
        return F.when(n == 0, one).otherwise(F.struct(*[mean(k).alias(k) for k in ("precision", "recall", "f1")]))

    return F.when(n == F.size(predicted), T.let(F.zip_with(gold, predicted, score_struct), means))


def mention_scores(pairs: DataFrame, gold: str, predicted: str, threshold: float = SOFT) -> DataFrame:
    """``pairs`` with mention_exact_recall, _recall, _precision, _f1, _accuracy, _mean_token_f1 of two array columns.

    A mention is hit if some other-side mention reaches ``threshold`` in F1 or in the share of
    reference tokens found. The mentions of one table are compared within its row, each pair once.
    """
    said = lambda c: F.filter(c, lambda m: F.length(m) > 0)
    x = pairs.withColumns({"_gn": F.transform(said(gold), lambda m: T.scientific(m)), "_pn": F.transform(said(predicted), lambda m: T.scientific(m))})
    x = x.withColumns({"_gb": F.transform("_gn", lambda m: bag(T.words(m))), "_pb": F.transform("_pn", lambda m: bag(T.words(m)))})

    x = x.withColumn("_s", F.transform("_gb", lambda a: F.transform("_pb", lambda b: score_struct(a, b))))
    x = x.withColumn("_m", F.transform("_s", lambda row: F.transform(row, lambda s: F.struct(s["f1"].alias("f1"), ((s["f1"] >= threshold) | (s["recall"] >= threshold)).alias("hit")))))
    n, m = F.size("_gn"), F.size("_pn")
    found = F.size(F.filter("_m", lambda row: F.exists(row, lambda c: c["hit"]))).cast("double")
    right = F.size(F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda j: F.exists("_m", lambda row: F.coalesce(F.get(row, j)["hit"], F.lit(False))))).cast("double")
    best = F.aggregate(F.transform("_m", lambda row: F.coalesce(F.array_max(F.transform(row, lambda c: c["f1"])), F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v)
    x = x.withColumns({"_found": found, "_right": right, "_best": best, "_same": F.size(F.array_intersect("_gn", "_pn"))})
    either = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
    one = lambda v: F.coalesce(either, v)
    recall, precision = F.col("_found") / F.greatest(n, F.lit(1)), F.col("_right") / F.greatest(m, F.lit(1))
    out = {
        "mention_exact_recall": one(F.col("_same") / F.greatest(n, F.lit(1))),
        "mention_recall": one(recall),
        "mention_precision": one(precision),
        "mention_f1": one(harmonic(recall, precision)),
        "mention_accuracy": one(F.coalesce(F.try_divide(F.col("_found"), F.col("_found") + (m - F.col("_right")) + (n - F.col("_found"))), F.lit(1.0))),
        "mention_mean_token_f1": one(F.col("_best") / F.greatest(n, F.lit(1))),
    }
    return x.withColumns(out).drop("_gn", "_pn", "_gb", "_pb", "_s", "_m", "_found", "_right", "_best", "_same")


MENTIONS = ["mention_exact_recall", "mention_recall", "mention_precision", "mention_f1", "mention_accuracy", "mention_mean_token_f1"]


def score_tables(gold: DataFrame, predicted: DataFrame, gold_cells: DataFrame, predicted_cells: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per reference table: matched and its scores, each rounded to four places."""
    pairs = matched_tables(gold, predicted, documents)
    names = ["caption", "columns", "section_title", "mentions"]
    g = gold.select(F.col("table_id").alias("gold_table"), *[F.col(c).alias(f"g_{c}") for c in names])
    p = predicted.select(F.col("table_id").alias("pred_table"), *[F.col(c).alias(f"p_{c}") for c in names])
    x = pairs.join(g, "gold_table").join(p, "pred_table", "left").join(cell_scores(gold_cells, predicted_cells, pairs), "gold_table", "left")
    sides = ("g", "p")
    x = x.withColumns({f"{s}_{c}": T.scientific(latex.expanded(F.coalesce(f"{s}_{c}", F.lit("")))) for s in sides for c in ("caption", "section_title")})
    x = x.withColumns({f"{s}_columns": F.transform(f"{s}_columns", lambda h: T.scientific(h)) for s in sides})
    x = x.withColumns({f"{s}_{c}_bag": bag(T.words(F.col(f"{s}_{c}"))) for s in sides for c in ("caption", "section_title")} | {f"{s}_heads": F.transform(f"{s}_columns", lambda h: bag(T.words(h))) for s in sides})
    x = mention_scores(x, "g_mentions", "p_mentions")
    exact = lambda c: (F.col(f"g_{c}") == F.col(f"p_{c}")).cast("double")
    x = x.withColumns({f"_{c}": score_struct(F.col(f"g_{c}_bag"), F.col(f"p_{c}_bag")) for c in ("caption", "section_title")} | {"_columns": header_scores(F.col("g_heads"), F.col("p_heads"))})
    scores: dict[str, Column] = {"caption_exact": exact("caption"), "columns_exact": exact("columns"), "section_exact": exact("section_title")}
    for name, s in (("caption", "_caption"), ("columns", "_columns"), ("section", "_section_title")):
        scores |= {f"{name}_{k}": F.col(s)[k] for k in ("precision", "recall", "f1")}
    scores |= {"cells": F.col("cell_accuracy")} | {c: F.col(c) for c in MENTIONS}
    matched = F.col("pred_table").isNotNull()
    return x.select("gold_id", "pred_id", "gold_table", "pred_table", matched.alias("matched"), *[F.when(matched, F.round(v, 4)).alias(k) for k, v in scores.items()])


METRICS = {
    "columns": ("columns_exact", "columns_precision", "columns_recall", "columns_f1"),
    "cells": ("cells", "cells", "cells", "cells"),
    "caption": ("caption_exact", "caption_precision", "caption_recall", "caption_f1"),
    "section": ("section_exact", "section_precision", "section_recall", "section_f1"),
    "mentions": ("mention_accuracy", "mention_precision", "mention_recall", "mention_f1"),
}


def detection(gold: Column, matched: Column, predicted: Column, used: Column) -> dict[str, Column]:
    """Scores of finding tables at all, from counts."""
    none = (gold == 0) & (predicted == 0)
    recall = F.when(none, 1.0).when(gold > 0, matched / gold)
    precision = F.when(none, 1.0).when(predicted == 0, 0.0).otherwise(used / predicted)
    union = matched + (predicted - used) + (gold - matched)
    accuracy = F.when(none, 1.0).when(union > 0, matched / union)
    return {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": harmonic(precision, recall)}


def summary(scores: DataFrame, predicted: DataFrame) -> DataFrame:
    """field, accuracy, precision, recall, f1: means over matched tables of the rounded scores, rounded again.

    Predicted tables count only in documents that the reference has.
    """
    found = scores.where("pred_id is not null").select("pred_id").distinct()
    n_pred = predicted.join(found, F.col("document_id") == F.col("pred_id"), "left_semi").agg(F.count(F.lit(1)).alias("predicted"))
    counts = scores.agg(F.count(F.lit(1)).alias("gold"), F.count_if("matched").alias("n"), F.count_distinct(F.when(F.col("matched"), F.col("pred_table"))).alias("used"), *[F.avg(F.when(F.col("matched"), F.col(c))).alias(c) for c in dict.fromkeys(c for m in METRICS.values() for c in m)])
    one = counts.crossJoin(n_pred)  # one row each
    d = detection(F.col("gold"), F.col("n"), F.col("predicted"), F.col("used"))
    rows = [F.struct(F.lit("detection").alias("field"), *[F.round(d[k], 4).alias(k) for k in d])]
    rows += [F.struct(F.lit(name).alias("field"), *[F.round(c, 4).alias(k) for k, c in zip(d, map(F.col, cs), strict=True)]) for name, cs in METRICS.items()]
    return one.select(F.inline(F.array(*rows)))


def evaluate(gold: DataFrame, gold_cells: DataFrame, predicted: DataFrame, predicted_cells: DataFrame) -> DataFrame:
    """The summary of a predicted corpus against a reference corpus."""
    doc = lambda df: df.select("document_id", "source_pdf", F.lit(0).alias("doc_pos")).distinct()
    documents = matched_documents(doc(gold), doc(predicted))
    return summary(score_tables(gold, predicted, gold_cells, predicted_cells, documents), predicted)
