"""The runs end to end: pages to corpus, corpus to scores, sentences to links, corpus to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.config import LinkSettings, is_protected
from gridquill.functions import numbers as N
from gridquill.functions import text as T
from gridquill.operators import claims as L
from gridquill.operators import context as X
from gridquill.operators import corpus as C
from gridquill.operators import evaluate as E
from gridquill.session import settled
from gridquill.sources import corpus as S

#: What a model is asked about a sentence, and the answers it may give.
ROLES = {"result": "reports what the authors measured, observed or concluded", "method": "describes how samples were made or tested", "background": "general knowledge or others' findings", "other": "front matter, caption, equation or fragment"}
TYPES = {"performance": "yield, rate, selectivity, conversion or stability", "property": "a property of the material", "condition": "how the experiment was run", "explanation": "why a result happens", "other": "none of these"}
RELATIONS = {"repeats_value": "quotes a number of the table", "describes_trend": "describes a comparison across the table", "contradicts": "disagrees with the table", "explains": "gives conditions or an explanation", "unrelated": "is not about the table"}
NONE = "none"


def generate(pages: DataFrame, titles: DataFrame | None = None, keep_empty: bool = False) -> DataFrame:
    """document_id, source_pdf, title, num_tables, tables of transcribed pages; ``titles`` has document_id, source_pdf, title."""
    built = X.build_documents(pages)
    known = pages.select("document_id").distinct()
    docs = known.join(built, "document_id", "left" if keep_empty else "inner")
    if titles is not None:
        docs = docs.join(titles.select("document_id", "source_pdf", T.article_title(F.col("title")).alias("title")), "document_id", "left")
    else:
        docs = docs.withColumns({"source_pdf": F.concat("document_id", F.lit(".pdf")), "title": F.lit("")})
    table = "table_id string, table_label string, page int, caption string, columns array<string>, rows array<array<struct<kind:string,s:string,i:bigint,d:double>>>, context struct<section_title:string,mentions:array<struct<page:int,text:string>>>"
    empty = F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in table.split(', '))}>>")
    fields = ["table_id", "table_label", "page", "caption", "columns", "rows", "context"]
    tables = F.coalesce(F.transform("tables", lambda t: F.struct(*[t[f].alias(f) for f in fields])), empty)
    return docs.select("document_id", "source_pdf", "title", F.coalesce("num_tables", F.lit(0)).alias("num_tables"), tables.alias("tables"))


def evaluate_files(spark: SparkSession, reference: str, prediction: str) -> DataFrame:
    (gt, gc, _), (pt, pc, _) = (S.relational(S.read_corpus(spark, p)) for p in (reference, prediction))
    return E.evaluate(gt, gc, pt, pc)


def evaluation_report(spark: SparkSession, reference: str, prediction: str) -> DataFrame:
    """One row per reference document: document_id, prediction_id, tables array<struct<...>> with every score of each table."""
    (gt, gc, _), (pt, pc, _) = (S.relational(S.read_corpus(spark, p)) for p in (reference, prediction))
    doc = lambda df: df.select("document_id", "source_pdf", F.lit(0).alias("doc_pos")).distinct()
    scores = E.score_tables(gt, pt, gc, pc, E.matched_documents(doc(gt), doc(pt)))
    each = F.struct(*[c for c in scores.columns if c not in ("gold_id", "pred_id")])
    return scores.groupBy(F.col("gold_id").alias("document_id")).agg(F.max("pred_id").alias("prediction_id"), F.count_if("matched").alias("matched_tables"), F.sort_array(F.collect_list(each)).alias("tables"))  # a document's own tables


def validated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(violations, summary) of nested documents."""
    t = documents.select("document_id", F.explode("tables").alias("t")).select("document_id", "t.*", F.col("t.context.section_title").alias("section_title"), F.col("t.context.mentions").alias("mentions"), F.size("t.rows").alias("n_rows"), F.size("t.columns").alias("n_columns"))
    return C.violations(documents, t), C.corpus_summary(documents, t)


def exported(documents: DataFrame, source: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Turtle lines of a corpus, each file with its prefixes; reference data of humans is refused."""
    if is_protected(source):
        raise ValueError(f"{source} lies under a protected folder")
    tables, _, mentions = S.relational(documents)
    return C.turtle_lines(C.triples(documents, tables, mentions.withColumn("mention_no", F.col("pos") + 1)), prefixes)


def _options(names: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def claim_state(text, section, mask: bool):
    said = T.masked_references(text) if mask else text
    return F.concat_ws("\n", F.concat(F.lit("Sentence: "), said), F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))))


def table_options(views: DataFrame) -> DataFrame:
    """document_id, table_options: option T<number> (T_<position> without one) -> title, and none."""
    title = T.caption_title(F.col("caption"))
    shown = F.when(title == "", F.array_join(F.slice("columns", 1, 6), "; ")).otherwise(title)
    each = views.select("document_id", "table_pos", option_key().alias("key"), T.shortened(shown, 120).alias("value"))
    last = each.groupBy("document_id", "key").agg(F.max_by("value", "table_pos").alias("value"))
    none = F.create_map(F.lit(NONE), F.lit("none of these tables"))
    return last.groupBy("document_id").agg(F.map_concat(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))), none).alias("table_options"))


def option_key():
    return F.coalesce(F.concat(F.lit("T"), "number"), F.concat(F.lit("T_"), (F.col("table_pos") + 1).cast("string")))


def _answers(asked: DataFrame, model: type | None) -> DataFrame:
    """key columns and probabilities; without a model every option is as likely."""
    if model is None:
        return asked.select(*[c for c in asked.columns if c not in ("state", "options")], L.uniform(F.col("options")).alias("probabilities"))
    return L.ask(asked, model)


def _choice(p):
    """The likeliest option; of equals the first."""
    entries = F.transform(F.map_entries(p), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("order"), e["key"].alias("key")))
    return F.array_max(entries)["key"]


def link_claims(sentences: DataFrame, tables: DataFrame, model: type | None = None, settings: LinkSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, links): candidate sentences with their claim, and each with each table of its document.

    ``sentences`` as from ``context.document_sentences``, ``tables`` with document_id, table_pos,
    table_id, table_label, caption, columns, section_title, rows. The pairs of sentences and
    tables are those within a document, as the ranking needs all of its tables.
    """
    s = settings or LinkSettings()
    views = L.views(tables)
    numbers, cells = L.stated_numbers(sentences), L.numeric_cells(tables)
    matches = L.numeric_matches(numbers, cells)
    candidates = L.candidate_sentences(sentences, L.table_dumps(sentences, tables, matches), s.only_referenced, s.most_candidates)
    key = ["document_id", "sentence_id"]
    roles = _answers(candidates.select(*key, claim_state(F.col("text"), F.col("section"), False).alias("state"), _options(ROLES).alias("options")), model).withColumnRenamed("probabilities", "role_p")
    types = _answers(candidates.select(*key, claim_state(F.col("text"), F.col("section"), False).alias("state"), _options(TYPES).alias("options")), model).withColumnRenamed("probabilities", "type_p")
    asked = candidates.join(table_options(views), "document_id").select(*key, claim_state(F.col("text"), F.col("section"), s.mask_references).alias("state"), F.col("table_options").alias("options"))
    which = _answers(asked, model).withColumnRenamed("probabilities", "table_p")
    records = candidates.join(roles, key).join(types, key).join(which, key, "left")
    role, p_claim = _choice(F.col("role_p")), F.coalesce(F.col("role_p")["result"], F.lit(0.0))
    records = records.withColumns({"role": role, "type": _choice(F.col("type_p")), "p_claim": p_claim}).withColumn("is_claim", (F.col("role") == "result") | (F.col("p_claim") >= s.claim_threshold))
    own = ["document_id", "table_id", "table_pos", "table_label", "number", "text", "row_options", "column_options"]
    pairs = records.select(*key, F.col("text").alias("sentence"), "section", "table_refs", "is_claim", "table_p").join(views.select(*own), "document_id")
    explicit = F.coalesce(F.array_contains("table_refs", F.col("number")), F.lit(False))
    kinds = matches.groupBy(*key, "table_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "rounded", "approx")])
    pairs = pairs.join(kinds, [*key, "table_id"], "left").fillna(0, ["exact", "rounded", "approx"])
    pairs = pairs.withColumns({"p_link": F.round(F.coalesce(F.col("table_p")[option_key()], F.lit(0.0)), 4), "p_no_table": F.coalesce(F.col("table_p")[NONE], F.lit(0.0)), "explicit_reference": explicit, "supported": F.col("exact") + F.col("rounded") > 0})
    links = L.decided(pairs, s.link_threshold)
    needed = links.where("explicit_reference or (is_claim and rank <= 2)")
    state = F.concat_ws("\n\n", claim_state(F.col("sentence"), F.col("section"), s.mask_references), "text")
    answers = None
    none = lambda what: F.create_map(F.lit(NONE), F.lit(f"no single {what}"))
    for name, options in (("relation", _options(RELATIONS)), ("row", F.map_concat("row_options", none("row"))), ("column", F.map_concat("column_options", none("column")))):
        got = _answers(needed.select(*key, "table_id", state.alias("state"), options.alias("options")), model).select(*key, "table_id", _choice(F.col("probabilities")).alias(name), F.array_max(F.map_values("probabilities")).alias(f"{name}_p"))
        answers = got if answers is None else answers.join(got, [*key, "table_id"])
    links = links.join(answers, [*key, "table_id"], "left")
    index = lambda c: (F.regexp_extract(F.coalesce(c, F.lit("")), r"^[rc](\d+)$", 1).try_cast("int") - 1)
    has_numbers = F.exists(N.stated(F.col("sentence")), lambda n: n["informative"])
    links = links.withColumns({"row_index": index(F.col("row")), "column_index": index(F.col("column"))})
    kinds = [F.col(k) for k in ("exact", "rounded", "approx")]
    if model is not None:  # the status rests on the row that the model picked, where numbers match in it
        links = _focused(links, matches, key)
        kinds = [F.when(F.col("in_selected_row") > 0, F.col(f"row_{k}")).otherwise(F.col(k)) for k in ("exact", "rounded", "approx")]
    links = links.withColumn("status", L.status(*kinds, F.col("relation"), F.coalesce("relation_p", F.lit(0.0)), has_numbers)).drop("row_exact", "row_rounded", "row_approx")
    return records.drop("role_p", "type_p", "table_p"), links.drop("text", "row_options", "column_options", "table_p")


def _focused(links: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """``links`` with in_selected_row, in_selected_cell (numbers that match there) and row_exact, row_rounded, row_approx of the selected row."""
    own = links.where("row_index is not null").select(*key, "table_id", "row_index", "column_index")
    there = matches.select(*key, "table_id", F.col("row").alias("at_row"), F.col("column").alias("at_column"), "kind")
    both = own.join(there, [*key, "table_id"]).where("at_row = row_index")
    kinds = [F.count_if(F.col("kind") == k).alias(f"row_{k}") for k in ("exact", "rounded", "approx")]
    seen = both.groupBy(*key, "table_id").agg(*kinds, F.count(F.lit(1)).alias("in_selected_row"), F.count_if(F.col("at_column") == F.col("column_index")).alias("in_selected_cell"))
    return links.join(seen, [*key, "table_id"], "left").fillna(0, ["in_selected_row", "in_selected_cell", "row_exact", "row_rounded", "row_approx"])


def counted_links(sentences: DataFrame, tables: DataFrame, settings: LinkSettings | None = None) -> DataFrame:
    """status, link_sources, n of the links that ``link_claims`` gives without a model; the pairs are counted, not formed."""
    s = settings or LinkSettings()
    sentences, tables = settled(sentences), settled(tables)
    counts = settled(L.match_counts(L.numeric_matches(L.stated_numbers(sentences), L.numeric_cells(tables))))
    candidates = L.candidate_sentences(sentences, L.dumps_of(sentences, tables, counts), s.only_referenced, s.most_candidates)
    return L.link_counts(candidates, tables.withColumn("number", T.label_number(F.col("table_label"))), counts, s.link_threshold)


def upserted(run: DataFrame, update: DataFrame, key: str = "document_id") -> DataFrame:
    """A run's rows with those of the updated documents replaced."""
    return run.join(update.select(key).distinct(), key, "left_anti").unionByName(update, allowMissingColumns=True)
