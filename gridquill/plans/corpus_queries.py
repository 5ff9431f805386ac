"""Queries for context, evaluation, corpora, claims and streams, with their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import numbers as N
from gridquill.functions import text as T
from gridquill.operators import claims as L
from gridquill.operators import context as X
from gridquill.operators import corpus as C
from gridquill.operators import evaluate as E
from gridquill.plans import pipelines as P
from gridquill.plans import sql as S
from gridquill.session import beside, read, shared_folder
from gridquill.sources.corpus import ground_truth
from gridquill.streaming import incremental as stream

SQL: dict[str, str] = {}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(name: str) -> Column:
    return F.col(name).cast("string")


def q_c1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    one = _text("Order ", _str("o_orderkey"), " is of prior-\nity ", F.col("o_orderpriority"))
    text = F.when(k == 0, _text("# Heading\n", one, ".\n\n![fig](x.png)\n\nIt ships\nlater.")).when(k == 1, _text(one, ".\nIt ships\nlater.")).otherwise(_text(one, "\nand ships later"))
    return X.page_paragraphs(o.select(_str("o_orderkey").alias("document_id"), F.lit(1).alias("page"), text.alias("text"))).select("document_id", "pos", "text")


SQL["q_c1_paragraphs"] = """
with o as (select o_orderkey::varchar as document_id, o_orderkey % 3 k, 'Order ' || o_orderkey || ' is of priority ' || o_orderpriority as one from orders)
select document_id, 0::int as pos, one || case when k = 2 then ' and ships later' else '.' end as text from o
union all select document_id, 1::int, 'It ships later.' from o where k <> 2"""


def q_c2_sentences(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "gt_mentions").where("text is not null").select("mention_id", T.collapse(F.col("text")).alias("t")).distinct()
    return m.select("mention_id", F.posexplode(X.sentences_of(F.col("t"))).alias("pos", "sentence"))


SQL["q_c2_sentences"] = rf"""
with m as (select distinct mention_id, {S.collapsed("text")} as t from gt_mentions where text is not null),
s as (select mention_id, regexp_replace(t, '((?:\b(?:Fig|Figs|Eq|Eqs|Ref|Refs|Tab|No|Nos|vs|ca|approx|wt|at|e\.g|i\.e|cf|resp|min|max|ref|al|etc|Vol|pp)|(?:^|[^\w\pL])[A-Z])\.) ', '\1' || chr(2), 'g') as t from m),
b as (select mention_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '') as l from s)
select mention_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as sentence from b"""


def _headings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.year("o_orderdate").alias("page"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"))
    return o.where("title like '1%'").withColumn("title", F.concat_ws(" ", "title", _str("pos"))), o.where("title like '5%'").drop("title")


def q_c3_sections_as_of(spark: SparkSession, d: str) -> DataFrame:
    return X.as_of_sections(*_headings(spark, d))


SQL["q_c3_sections_as_of"] = """
with b as (select o_custkey document_id, year(o_orderdate)::int page, o_orderkey pos, case when o_orderpriority like '1%' then o_orderpriority || ' ' || o_orderkey end title, o_orderpriority p
  from orders where o_orderpriority like '1%' or o_orderpriority like '5%'),
w as (select *, last_value(title ignore nulls) over (partition by document_id order by page, pos rows between unbounded preceding and 1 preceding) s from b)
select document_id, page, pos, coalesce(s, '') as section_title from w where p like '5%'"""


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """Three pages per supplier: heading, caption and table; a second table without caption; prose that names table 1."""
    s = read(spark, d, "supplier")
    k, name = _str("s_suppkey"), F.col("s_name")
    table = lambda a: _text("<table><thead><tr><th>name</th><th>key</th></tr></thead><tbody><tr><td>", a, "</td><td>", k, "</td></tr></tbody></table>")
    one = _text("# A study of ", name, "\n\n## 2. Results\n\n**Table 1**\n\nBalance of ", name, "\n\n", table(name), "\n\nTable 2: Other ", name, "\n\n", table("x"))
    two = _text(table("y"), "\n\n### 3. Discussion\n\nAs Table 1 shows, ", name, " has key ", k, ". It is listed in Fig. 2 too.\n\nNothing here.")
    three = _text("## References\n\n[1] Table 1 of another work by ", name, ".")
    pages = F.array(one, two, three)
    return s.select(_str("s_suppkey").alias("document_id"), "s_name", F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def q_c4_located(spark: SparkSession, d: str) -> DataFrame:
    return X.locate_tables(_rendered(spark, d)).select("document_id", "page", "pos", "caption", "number", "section_title")


SQL["q_c4_located"] = """
with s as (select s_suppkey::varchar as document_id, replace(s_name, '_', '') n from supplier)
select document_id, 1::int as page, 0::int as pos, 'Table 1 Balance of ' || n as caption, '1' as number, '2. Results' as section_title from s
union all select document_id, 1, 1, 'Table 2: Other ' || n, '2', '2. Results' from s
union all select document_id, 2, 0, '', null, '2. Results' from s"""


def q_c5_nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    """More captions than tables: each table takes the nearest one."""
    s = read(spark, d, "supplier")
    text = _text("Table 7: Far away from it all\n\nsome words\n\nTable 8: Next to ", F.col("s_name"), "\n\n<table><tr><th>a</th></tr><tr><td>1</td></tr></table>")
    pages = s.select(_str("s_suppkey").alias("document_id"), F.lit(1).alias("page"), text.alias("text"))
    return X.locate_tables(pages).select("document_id", "number", "caption")


SQL["q_c5_nearest_caption"] = "select s_suppkey::varchar as document_id, '8' as number, 'Table 8: Next to ' || regexp_replace(s_name, '([A-Za-z])_(\\d+)', '\\1\\2', 'g') as caption from supplier"


def q_c6_mentions(spark: SparkSession, d: str) -> DataFrame:
    pages = _rendered(spark, d)
    return X.mentions(pages, X.locate_tables(pages)).select("document_id", "number", "page", "text")


SQL["q_c6_mentions"] = """
with s as (select s_suppkey::varchar as document_id, replace(s_name, '_', '') n, s_suppkey k from supplier)
select document_id, '1' as number, 2::int as page, 'As Table 1 shows, ' || n || ' has key ' || k || '. It is listed in Fig. 2 too.' as text from s
union all select document_id, '1', 3, '[1] Table 1 of another work by ' || n || '.' from s"""


def q_c7_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.running_lines(read(spark, d, "ocr_pages").where("text is not null").select("document_id", "page", "text"))


SQL["q_c7_running_lines"] = r"""
with l as (select distinct document_id, page, regexp_replace(trim(unnest(string_split(text, chr(10)))), '\d+', '#', 'g') as line from ocr_pages where text is not null),
n as (select document_id, count(distinct page) pages from ocr_pages where text is not null group by 1)
select document_id, line from (select document_id, line, count(*) c from l where line <> '' group by 1, 2) join n using (document_id) where pages >= 3 and c >= greatest(3, floor(0.3 * pages))"""


def q_c8_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = X.build_documents(_rendered(spark, d))
    t = docs.select("document_id", "num_tables", F.explode("tables").alias("t"))
    return t.select("document_id", "num_tables", "t.table_id", "t.table_label", "t.caption", F.size("t.context.mentions").alias("n_mentions"), F.get(F.get("t.rows", F.lit(0)), F.lit(1))["i"].alias("key"))


SQL["q_c8_documents"] = """
with s as (select s_suppkey::varchar as document_id, replace(s_name, '_', '') n, s_suppkey as key from supplier)
select document_id, 3::int as num_tables, document_id || '_table_01' as table_id, 'Table 1' as table_label, 'Table 1 Balance of ' || n as caption, 2::int as n_mentions, key from s
union all select document_id, 3, document_id || '_table_02', 'Table 2', 'Table 2: Other ' || n, 0, key from s
union all select document_id, 3, document_id || '_table_03', '', '', 0, key from s"""


def q_c9_body_sentences(spark: SparkSession, d: str) -> DataFrame:
    return X.document_sentences(_rendered(spark, d)).select("document_id", "sentence_id", "page", "section", "text", F.array_join("table_refs", ",").alias("refs"))


SQL["q_c9_body_sentences"] = """
with s as (select s_suppkey::varchar as document_id, replace(s_name, '_', '') n, s_suppkey k from supplier)
select document_id, document_id || '_s0001' as sentence_id, 1::int as page, '2. Results' as section, 'Balance of ' || n as text, '' as refs from s
union all select document_id, document_id || '_s0002', 2, '3. Discussion', 'As Table 1 shows, ' || n || ' has key ' || k || '.', '1' from s
union all select document_id, document_id || '_s0003', 2, '3. Discussion', 'It is listed in Fig. 2 too.', '' from s
union all select document_id, document_id || '_s0004', 2, '3. Discussion', 'Nothing here.', '' from s"""


def _predicted(tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference with faults: missing tables, longer captions, lost sections, changed cells."""
    p = tables.where("table_pos % 13 <> 0")
    caption = F.when(F.col("table_pos") % 3 == 0, F.concat_ws(" ", "caption", F.lit("seen anew"))).otherwise(F.col("caption"))
    p = p.withColumn("caption", caption).withColumn("section_title", F.when(F.col("table_pos") % 4 == 0, "").otherwise(F.col("section_title")))
    p = p.withColumn("columns", F.when(F.col("table_pos") % 5 == 0, F.transform("columns", lambda c, i: F.when(i == 0, F.concat(c, F.lit(" name"))).otherwise(c))).otherwise(F.col("columns")))
    p = p.withColumn("mentions", F.filter("mentions", lambda m, i: i > 0)).withColumn("table_id", F.concat(F.lit("p_"), "table_id"))
    worse = F.when((F.col("row_no") + F.col("col_no")) % 7 == 0, F.struct(F.lit("s").alias("kind"), F.lit("?").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))).otherwise(F.col("cell"))
    return p, cells.withColumn("cell", worse).withColumn("table_id", F.concat(F.lit("p_"), "table_id"))


def q_e1_evaluate(spark: SparkSession, d: str) -> DataFrame:
    t, c = ground_truth(spark, d)
    return E.evaluate(t, c, *_predicted(t, c))


_GOLD = """
t0 as (select distinct on (table_no) * from gt_tables),
m0 as (select table_no, list(text order by mention_pos, text) filter (text is not null) as mentions from (select distinct on (mention_id) * from gt_mentions) group by 1),
g as (select document_id, table_no as table_pos, table_id, table_label, page, caption, col_headers as cols, coalesce(section_title, '') as section, coalesce(mentions, []) as mentions from t0 left join m0 using (table_no)),
p as (select document_id, table_pos, 'p_' || table_id as table_id, table_label, page, case when table_pos % 3 = 0 then concat_ws(' ', caption, 'seen anew') else caption end as caption,
  case when table_pos % 5 = 0 and len(cols) > 0 then list_prepend(cols[1] || ' name', cols[2:]) else cols end as cols, case when table_pos % 4 = 0 then '' else section end as section, mentions[2:] as mentions
  from g where table_pos % 13 <> 0),
bl as (select document_id, table_label, arg_min(table_id, table_pos) as b from p where length(table_label) > 0 group by 1, 2),
bp as (select document_id, page, arg_min(table_id, table_pos) as b from p where page is not null group by 1, 2),
x as (select g.*, coalesce(bl.b, bp.b) as pred from g left join bl using (document_id, table_label) left join bp on bp.document_id = g.document_id and bp.page = g.page)"""
_CELLS = """
gc as (select t0.table_id, row_no, col_no, cell from (select distinct on (cell_id) * from gt_cells) join t0 using (table_no)),
pc as (select 'p_' || table_id as pred, row_no, col_no, case when (row_no + col_no) % 7 = 0 then {'kind': 's', 's': '?', 'i': null::bigint, 'd': null::double} else cell end as cell from gc),
gs as (select table_id, max(row_no) r, max(col_no) c, count(*) n from gc group by 1), ps as (select pred, max(row_no) r, max(col_no) c from pc group by 1),
h as (select x.table_id, count(*) filter (case when coalesce(gc.cell.d, gc.cell.i::double) is not null and coalesce(pc.cell.d, pc.cell.i::double) is not null
  then abs(coalesce(gc.cell.d, gc.cell.i) - coalesce(pc.cell.d, pc.cell.i)) <= 1e-6 * greatest(1.0, abs(coalesce(gc.cell.d, gc.cell.i::double))) else SCI(gc.cell.s) = SCI(pc.cell.s) end) as hits
  from x join gc using (table_id) join pc on pc.pred = x.pred and pc.row_no = gc.row_no and pc.col_no = gc.col_no group by 1),
cs as (select x.table_id, case when gs.r is not distinct from ps.r and gs.c is not distinct from ps.c then case when gs.n is not null then coalesce(hits, 0)::double / gs.n end else 0.0 end as acc
  from x left join gs using (table_id) left join ps on ps.pred = x.pred left join h on h.table_id = x.table_id where x.pred is not null)"""


def _macro(sql: str) -> str:
    """``SCI(x)`` and ``WORDS(x)`` written out."""
    import re

    for name, f in (("SCI", S.scientific), ("WORDS", S.words)):
        sql = re.sub(rf"{name}\(([\w.]+)\)", lambda m: f(m[1]), sql)  # noqa: B023
    return sql


SQL["q_e1_detection"] = f"""
with {_GOLD}, n as (select count(*) gold, count(pred) m, count(distinct pred) used, (select count(*) from p where document_id in (select document_id from g)) pr from x)
select round(m::double / (m + (pr - used) + (gold - m)), 4) as accuracy, round(used::double / pr, 4) as "precision", round(m::double / gold, 4) as recall, round({S.harmonic("(used::double / pr)", "(m::double / gold)")}, 4) as f1 from n"""


def q_e1_detection(spark: SparkSession, d: str) -> DataFrame:
    return q_e1_evaluate(spark, d).where("field = 'detection'").drop("field")


def q_e1_cells(spark: SparkSession, d: str) -> DataFrame:
    t, c = ground_truth(spark, d)
    p, pc = _predicted(t, c)
    docs = t.select(F.col("document_id").alias("gold_id"), F.col("document_id").alias("pred_id")).distinct()
    return E.cell_scores(c, pc, E.matched_tables(t, p, docs)).select(F.col("gold_table").alias("table_id"), F.round("cell_accuracy", 4).alias("cells"))


SQL["q_e1_cells"] = _macro(f"with {_GOLD}, {_CELLS} select table_id, round(acc, 4) as cells from cs")


SQL["q_e1_text"] = _macro(f"""
with {_GOLD},
y as (select x.table_id, SCI(x.caption) gc, SCI(p.caption) pc, WORDS(x.caption) ga, WORDS(p.caption) pa, SCI(x.section) gs, SCI(p.section) ps, WORDS(x.section) gb, WORDS(p.section) pb from x join p on p.table_id = x.pred)
select table_id, (gc = pc)::int::double as caption_exact, round({S.precision("ga", "pa")}, 4) as caption_precision, round({S.recall("ga", "pa")}, 4) as caption_recall,
  (gs = ps)::int::double as section_exact, round({S.harmonic(S.precision("gb", "pb"), S.recall("gb", "pb"))}, 4) as section_f1 from y""")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t, c = ground_truth(spark, d)
    p, pc = _predicted(t, c)
    docs = t.select(F.col("document_id").alias("gold_id"), F.col("document_id").alias("pred_id")).distinct()
    return E.score_tables(t, p, c, pc, docs).where("matched").withColumnRenamed("gold_table", "table_id")


def q_e1_text(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("table_id", "caption_exact", "caption_precision", "caption_recall", "section_exact", "section_f1")


def q_e2_bags(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the next one: token scores by joined counts, whatever the length."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce(T.words(T.collapse(F.col("text"))), F.array().cast("array<string>")).alias("tokens"))
    gold = docs.select(F.col("doc_id").alias("id"), "tokens")
    pred = docs.select((F.col("doc_id") - 1).alias("id"), "tokens")
    got = E.bag_scores(gold, pred, "id")
    return got.select("id", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


SQL["q_e2_bags"] = rf"""
with t as (select doc_id, coalesce(regexp_extract_all(lower({S.collapsed("text")}), '[a-z0-9]+(?:[./^-][a-z0-9]+)*'), []) w from documents),
c as (select doc_id, u, count(*) n from (select doc_id, unnest(w) u from t) group by 1, 2),
o as (select a.doc_id, sum(least(a.n, b.n)) shared from c a join c b on b.doc_id = a.doc_id + 1 and a.u = b.u group by 1),
s as (select a.doc_id id, len(a.w) n, coalesce(len(b.w), 0) m, coalesce(shared, 0)::double v from t a left join t b on b.doc_id = a.doc_id + 1 left join o on o.doc_id = a.doc_id),
r as (select id, case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else v / m end p, case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else v / n end r from s)
select id, round(p, 4) as "precision", round(r, 4) as recall, round({S.harmonic("p", "r")}, 4) as f1 from r"""


def q_e3_headers(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("table_id", "columns_exact", "columns_precision", "columns_recall", "columns_f1")


SQL["q_e3_headers"] = _macro(f"""
with {_GOLD}, y as (select x.table_id, x.cols a, p.cols b from x join p on p.table_id = x.pred where x.cols is not null and p.cols is not null),
u as (select table_id, a, b, unnest(range(1, len(a) + 1)) i from y where len(a) = len(b) and len(a) > 0), v as (select table_id, a[i] ai, b[i] bi from u),
w as (select table_id, WORDS(ai) ga, WORDS(bi) pa, SCI(ai) = SCI(bi) as same from v),
z as (select table_id, {S.precision("ga", "pa")} pp, {S.recall("ga", "pa")} rr, same from w),
m as (select table_id, avg(pp) p, avg(rr) r, avg({S.harmonic("pp", "rr")}) f, bool_and(same) e from z group by 1)
select table_id, case when len(a) = len(b) then case when len(a) = 0 or e then 1.0 else 0.0 end else 0.0 end as columns_exact,
  round(case when len(a) = 0 and len(b) = 0 then 1.0 else p end, 4) as columns_precision, round(case when len(a) = 0 and len(b) = 0 then 1.0 else r end, 4) as columns_recall, round(case when len(a) = 0 and len(b) = 0 then 1.0 else f end, 4) as columns_f1 from y left join m using (table_id)""")


def q_e4_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("table_id", "mention_exact_recall", "mention_recall", "mention_precision", "mention_accuracy", "mention_mean_token_f1")


_HIT = lambda a, b: f"({S.recall(a, b)} >= 0.5 or {S.harmonic(S.precision(a, b), S.recall(a, b))} >= 0.5)"
SQL["q_e4_mentions"] = _macro(f"""
with {_GOLD}, y as (select x.table_id, list_filter(x.mentions, lambda z: length(z) > 0) a, list_filter(p.mentions, lambda z: length(z) > 0) b from x join p on p.table_id = x.pred),
ga as (select table_id, i, t, WORDS(t) w, SCI(t) s from (select table_id, unnest(range(1, len(a) + 1)) i, unnest(a) t from y)),
pb as (select table_id, i, t, WORDS(t) w, SCI(t) s from (select table_id, unnest(range(1, len(b) + 1)) i, unnest(b) t from y)),
k as (select ga.table_id, ga.i gi, pb.i pi, ga.s = pb.s same, {_HIT("ga.w", "pb.w")} hit, {S.harmonic(S.precision("ga.w", "pb.w"), S.recall("ga.w", "pb.w"))} f from ga join pb using (table_id)),
gh as (select table_id, count(*) filter (h) gh, avg(f) mf from (select table_id, gi, bool_or(hit) h, max(f) f from k group by 1, 2) group by 1),
ph as (select table_id, count(*) filter (h) ph from (select table_id, pi, bool_or(hit) h from k group by 1, 2) group by 1),
ex as (select ga.table_id, count(distinct ga.s) e from ga join pb on pb.table_id = ga.table_id and pb.s = ga.s group by 1),
r as (select y.table_id, len(a) n, len(b) m, coalesce(gh, 0)::double gh, coalesce(ph, 0)::double ph, mf, coalesce(e, 0)::double e from y left join gh using (table_id) left join ph using (table_id) left join ex using (table_id))
select table_id, case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else round(e / n, 4) end as mention_exact_recall, case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else round(gh / n, 4) end as mention_recall,
  case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else round(ph / m, 4) end as mention_precision,
  case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 when gh + (m - ph) + (n - gh) = 0 then 1.0 else round(gh / (gh + (m - ph) + (n - gh)), 4) end as mention_accuracy,
  case when n = 0 and m = 0 then 1.0 when n = 0 or m = 0 then 0.0 else round(mf, 4) end as mention_mean_token_f1 from r""")


def q_e5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Reference documents matched by file name, else by id; some missing, some renamed, some twice."""
    o = read(spark, d, "customer")
    key = F.col("c_custkey")
    gold = o.select(_str("c_custkey").alias("document_id"), _text("a/b/", F.col("c_name"), ".pdf").alias("source_pdf"), F.lit(0).alias("doc_pos"))
    pred = o.where(key % 5 != 0).select(F.when(key % 5 == 1, _str("c_custkey")).otherwise(_text("p", _str("c_custkey"))).alias("document_id"), F.when(key % 5 == 1, F.lit("other.pdf")).otherwise(_text("c/", F.col("c_name"), ".pdf")).alias("source_pdf"), key.cast("int").alias("doc_pos"))
    return E.matched_documents(gold, pred)


SQL["q_e5_documents"] = "select c_custkey::varchar as gold_id, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then c_custkey::varchar else 'p' || c_custkey end as pred_id from customer"


def q_e6_table_match(spark: SparkSession, d: str) -> DataFrame:
    t, c = ground_truth(spark, d)
    p, _ = _predicted(t, c)
    docs = t.select(F.col("document_id").alias("gold_id"), F.col("document_id").alias("pred_id")).distinct()
    return E.matched_tables(t, p, docs).select(F.col("gold_table").alias("table_id"), "pred_table")


SQL["q_e6_table_match"] = f"with {_GOLD} select table_id, pred as pred_table from x"


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    cell = F.struct(F.lit("s").alias("kind"), F.lit("x").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))
    rows = F.array(F.array(cell, cell), F.when(key % 17 == 0, F.array(cell)).otherwise(F.array(cell, cell)))
    tables = o.select(_str("o_custkey").alias("document_id"), F.when(key % 19 == 0, F.concat(_str("o_custkey"), F.lit("_t"))).otherwise(_str("o_orderkey")).alias("table_id"), (key % 23).cast("int").alias("page"), F.array(F.lit("a"), F.lit("b")).alias("columns"), rows.alias("rows"), F.col("o_orderpriority").alias("caption"), F.when(key % 2 == 0, "").otherwise("s").alias("section_title"), F.when(key % 3 == 0, F.array(F.lit("m"), F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("mentions"), F.lit(2).alias("n_rows"), F.lit(2).alias("n_columns"))
    size = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    documents = read(spark, d, "customer").join(size, F.col("o_custkey") == F.col("c_custkey"), "left").select(_str("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.coalesce("n", F.lit(0))).cast("int").alias("num_tables"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("title"))
    return documents, tables


def q_v1_violations(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(*_faulty(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL["q_v1_violations"] = """
select 'num_tables' as rule, count(*) n from (select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1) where c_custkey % 10 = 0 and n <> 99
union all select 'table_id_unique', count(*) from (select o_custkey from orders where o_orderkey % 19 = 0 group by 1 having count(*) > 1)
union all select 'rectangular', count(*) from orders where o_orderkey % 17 = 0 union all select 'page_positive', count(*) from orders where o_orderkey % 23 = 0"""


def q_v2_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_summary(*_faulty(spark, d))


SQL["q_v2_summary"] = """
select (select count(*) from customer) as documents, (select count(*) from customer where c_custkey % 4 <> 0) as with_title,
  (select count(*) from customer where c_custkey % 10 <> 0 and c_custkey not in (select o_custkey from orders)) as without_tables,
  count(*) as tables, count(*) filter (length(trim(o_orderpriority)) > 0) as with_caption, count(*) filter (o_orderkey % 2 <> 0) as with_section, count(*) filter (o_orderkey % 3 = 0) as with_mentions,
  (2 * count(*) filter (o_orderkey % 3 = 0))::bigint as mentions, 2.0 as mean_rows, 2.0 as mean_columns from orders"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    key = F.col("c_custkey")
    doc = lambda df, note: df.select(F.col("c_name").alias("source_pdf"), F.when(key % 6 == 0, 0).otherwise(2).alias("num_tables"), F.lit(note).alias("note"), F.lit(None).cast("int").alias("pos"))
    inputs = c.where(key % 2 == 0).select(F.col("c_name").alias("source_pdf"), key.cast("int").alias("pos"))
    return inputs, doc(c.where(key % 3 == 0), "old"), doc(c.where(key % 4 == 0), "new")


def q_i1_resume(spark: SparkSession, d: str) -> DataFrame:
    inputs, existing, _ = _runs(spark, d)
    return C.pending(inputs, existing).select("source_pdf", "pos")


SQL["q_i1_resume"] = "select c_name as source_pdf, c_custkey::int as pos from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0"


def q_i2_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.merged(*_runs(spark, d)).select("source_pdf", "num_tables", "note", "pos", "is_leftover")


SQL["q_i2_merge"] = """
select c_name as source_pdf, 2::int as num_tables, case when c_custkey % 4 = 0 then 'new' else 'old' end as note, case when c_custkey % 2 = 0 then c_custkey::int end as pos, c_custkey % 2 <> 0 as is_leftover
from customer where (c_custkey % 3 = 0 or c_custkey % 4 = 0) and c_custkey % 6 <> 0"""


def q_i3_failures(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    error = F.when(F.col("c_custkey") % 7 == 0, F.lit("ValueError: damaged")).when(F.col("c_custkey") % 31 == 0, F.lit("ImportError: no tool"))
    out = C.failures(c.select(F.col("c_name").alias("source_pdf"), error.alias("error")))
    return out.withColumn("aborts", C.is_environment_error(F.col("error")))


SQL["q_i3_failures"] = """
select c_name as pdf, case when c_custkey % 7 = 0 then 'ValueError: damaged' else 'ImportError: no tool' end as error, c_custkey % 7 <> 0 as aborts from customer where c_custkey % 7 = 0 or c_custkey % 31 = 0"""


def q_r1_triples(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "papers").dropDuplicates(["document_id"])
    t = read(spark, d, "gt_tables").dropDuplicates(["table_no"]).withColumn("columns", F.col("col_headers")).withColumn("caption", T.collapse(F.coalesce("caption", F.lit(""))))
    m = read(spark, d, "gt_mentions").dropDuplicates(["mention_id"]).join(t.select("table_no", "table_id"), "table_no").withColumn("mention_no", F.col("mention_pos") + 1)
    return C.triples(p, t, m).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


SQL["q_r1_triples"] = r"""
with p as (select distinct on (document_id) * from papers), t as (select distinct on (table_no) * from gt_tables), m as (select distinct on (mention_id) * from gt_mentions where length(trim(text)) > 0),
s as (select 'd' || document_id s, 'a' p from p union all select 'd' || document_id, 'schema:identifier' from p where length(trim(source_pdf)) > 0 union all select 'd' || document_id, 'prov:hadPrimarySource' from p where length(trim(source_pdf)) > 0
union all select 'd' || document_id, 'schema:name' from p where length(trim(title)) > 0
union all select 't' || table_id, unnest(['a', 'schema:name', 'sc:belongsToArticle']) from t union all select 't' || table_id, 'schema:pageStart' from t where page is not null
union all select 't' || table_id, 'schema:description' from t where length(trim(regexp_replace(caption, '\s+', ' ', 'g'))) > 0 union all select 't' || table_id, 'schema:articleSection' from t where length(trim(section_title)) > 0
union all select 't' || table_id, 'csvw:column' from (select table_id, unnest(col_headers) c from t) where length(trim(c)) > 0
union all select 'm' || mention_id, unnest(['a', 'schema:text', 'schema:about', 'prov:wasDerivedFrom']) from m union all select 'm' || mention_id, 'schema:pageStart' from m where page is not null)
select p, count(*) n, count(distinct s) subjects from s group by p"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """One sentence per line item, in five kinds."""
    li = read(spark, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    q, price = F.col("l_quantity").cast("int").cast("string"), F.format_string("%.2f", "l_extendedprice")
    text = (
        F.when(k == 0, _text("In Table 3 the samples gave ", q, " nm and a yield of ", price, " m2/g after drying [3,4]."))
        .when(k == 1, _text("Short ", q, "."))
        .when(k == 2, _text(*[x for _ in range(7) for x in (q, " ")], "and nothing more is said of all these items"))
        .when(k == 3, _text("Corresponding author of item ", price, " can be reached at the usual address here."))
        .otherwise(F.lit("We greet all those who were with us on that very long and sunny day in May."))
    )
    return li.select(_str("l_suppkey").alias("document_id"), _text(_str("l_orderkey"), "_", _str("l_linenumber")).alias("sentence_id"), F.lit("Methods").alias("section"), text.alias("text"))


def q_l1_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    flags = s.select("sentence_id", L.is_residue(F.col("text")).alias("residue"), L.is_candidate(F.col("text"), F.col("section")).alias("candidate"))
    return flags


SQL["q_l1_candidates"] = "select l_orderkey || '_' || l_linenumber as sentence_id, (l_orderkey + l_linenumber) % 5 = 2 as residue, (l_orderkey + l_linenumber) % 5 = 0 as candidate from lineitem"


def q_l2_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).where("text like 'In Table%'").select("sentence_id", F.posexplode(N.stated(F.col("text"))).alias("pos", "n"))
    return s.select("sentence_id", "pos", "n.*")


SQL["q_l2_numbers"] = """
with l as (select l_orderkey || '_' || l_linenumber as sentence_id, l_quantity::int q, printf('%.2f', l_extendedprice) p from lineitem where (l_orderkey + l_linenumber) % 5 = 0)
select sentence_id, 0::int as pos, q::double as "value", 0::int as decimals, q::varchar as raw, 'nm' as unit, q >= 10 as informative from l
union all select sentence_id, 1, p::double, 2, p, 'm2/g', p::double <> 0 from l"""


def _numbers_and_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li, part = read(spark, d, "lineitem"), read(spark, d, "part")
    n = li.select((F.col("l_partkey") % 50).alias("document_id"), _text(_str("l_orderkey"), "_", _str("l_linenumber")).alias("sentence_id"), F.round(F.col("l_extendedprice") / 10, 1).alias("value"))
    n = n.select("document_id", "sentence_id", "value", F.lit(1).alias("decimals"), F.format_string("%.1f", "value").alias("raw"), F.lit("").alias("unit"), (F.col("value") != 0).alias("informative"))
    c = part.select((F.col("p_partkey") % 50).alias("document_id"), _str("p_partkey").alias("table_id"), F.lit(0).alias("row"), F.lit(1).alias("column"), F.lit("").alias("unit_text"), F.round("p_retailprice", 2).alias("value"), F.format_string("%.2f", F.round("p_retailprice", 2)).alias("raw"), F.lit(2).alias("decimals"))
    return n, c


def q_l3_matches(spark: SparkSession, d: str) -> DataFrame:
    m = L.numeric_matches(*_numbers_and_cells(spark, d))
    return m.select("sentence_id", "table_id", F.when(F.col("kind") == "rounded", "approx").otherwise(F.col("kind")).alias("kind"))


SQL["q_l3_matches"] = """
with n as (select distinct l_partkey % 50 doc, l_orderkey || '_' || l_linenumber as sentence_id, round(l_extendedprice / 10, 1) v from lineitem), c as (select p_partkey % 50 doc, p_partkey::varchar as table_id, round(p_retailprice, 2) w from part)
select sentence_id, table_id, case when abs(v - w) <= 1e-9 * greatest(abs(v), abs(w)) then 'exact' else 'approx' end as kind from n join c using (doc) where v <> 0 and w <> 0 and abs(v - w) / abs(w) <= 0.01"""


def _table_relation(spark: SparkSession, d: str) -> DataFrame:
    """One table per nation: its customers' segments with counts."""
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda kind, s, i: F.struct(F.lit(kind).alias("kind"), s.alias("s"), i.alias("i"), F.lit(None).cast("double").alias("d"))
    row = F.array(cell("s", F.col("c_mktsegment"), F.lit(None).cast("bigint")), cell("i", _str("n"), F.col("n")))
    rows = g.groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    t = n.join(rows, F.col("n_nationkey") == F.col("c_nationkey"))
    return t.select(_str("n_regionkey").alias("document_id"), _str("n_nationkey").alias("table_id"), F.col("n_nationkey").alias("table_pos"), _text("Table ", _str("n_nationkey")).alias("table_label"), _text("Table ", _str("n_nationkey"), ": Segments of nation").alias("caption"), F.array(F.lit("segment"), F.lit("customers")).alias("columns"), F.lit("Results").alias("section_title"), "rows")


def q_l4_views(spark: SparkSession, d: str) -> DataFrame:
    v = L.views(_table_relation(spark, d))
    return v.select("table_id", "number", "label_col", "text", F.size("row_options").alias("n_rows"), F.col("column_options")["c1"].alias("c1"), F.size(F.map_keys(L.uniform(F.col("row_options")))).alias("answers"))


SQL["q_l4_views"] = """
with g as (select c_nationkey, c_mktsegment, count(*) n from customer group by all), r as (select c_nationkey, string_agg(c_mktsegment || ' | ' || n, chr(10) order by c_mktsegment) body, count(*)::int k from g group by 1)
select c_nationkey::varchar as table_id, c_nationkey::varchar as number, 0::int as label_col, 'Table ' || c_nationkey || ': Segments of nation' || chr(10) || 'Table section: Results' || chr(10) || 'segment | customers' || chr(10) || body as text,
  k as n_rows, 'customers' as c1, k as answers from r join nation on n_nationkey = c_nationkey"""


def q_l5_table_dumps(spark: SparkSession, d: str) -> DataFrame:
    t = _table_relation(spark, d).where(F.size("rows") >= 5)
    many = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r[0]["s"], F.concat(r[1]["s"], F.lit(".0")), r[1]["s"])), " ")
    few = F.array_join(F.transform(F.slice("rows", 1, 2), lambda r: F.concat_ws(" ", r[0]["s"], r[1]["s"])), " ")
    both = F.array(F.struct(_text("dump", F.col("table_id")).alias("id"), many.alias("t")), F.struct(_text("prose", F.col("table_id")).alias("id"), few.alias("t")))
    s = t.select("document_id", F.inline(both)).withColumnsRenamed({"id": "sentence_id", "t": "text"})
    m = L.numeric_matches(L.stated_numbers(s), L.numeric_cells(t))
    return L.table_dumps(s, t, m).select("sentence_id")


SQL["q_l5_table_dumps"] = """
with g as (select c_nationkey, c_mktsegment, count(*) n from customer group by all), s as (select c_nationkey k, count(*) c from g group by 1 having c >= 5)
select 'dump' || k as sentence_id from s where (select count(*) from g a where a.c_nationkey = k and a.n >= 1) >= 5
  and (select sum(w) from (select a.n, (select count(*) from g b where b.c_nationkey = k and (b.n = a.n or abs(a.n - b.n) / b.n::double <= 0.01)) * (case when a.n >= 10 then 2 else 1 end) w from (select distinct n from g where c_nationkey = k) a)) >= 6"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Sentence-table pairs with made-up but fixed answers: 3 to 5 candidate tables per order."""
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    each = o.select(_str("o_custkey").alias("document_id"), _str("o_orderkey").alias("sentence_id"), key, F.explode(F.sequence(F.lit(1), (F.lit(3) + key % 3).cast("int"))).alias("table_pos"))
    p = F.round(((key * 7 + F.col("table_pos") * 13) % 11) / 11, 4)
    return each.select("document_id", "sentence_id", "table_pos", _str("table_pos").alias("table_id"), _str("table_pos").alias("number"), _text("Table ", _str("table_pos")).alias("table_label"), p.alias("p_link"), F.round((key % 7) / 7, 4).alias("p_no_table"), (key % 2 == 0).alias("is_claim"), (key % 5 == F.col("table_pos")).alias("explicit_reference"), ((key + F.col("table_pos")) % 3 == 0).alias("supported"), F.array(_text(((key % 4) + 1).cast("string"))).alias("refs"), (key % 3).cast("int").alias("row_index"), F.lit(1).alias("column_index"))


_LINKS = """
l as (select o_custkey::varchar as document_id, o_orderkey::varchar as sentence_id, o_orderkey k, unnest(range(1, 4 + (o_orderkey % 3)::bigint))::int as t from orders),
r as (select *, round(((k * 7 + t * 13) % 11) / 11.0::double, 4) p, round((k % 7) / 7.0::double, 4) q from l), w as (select *, row_number() over (partition by sentence_id order by p desc, t) rk from r)"""


def q_l6_decisions(spark: SparkSession, d: str) -> DataFrame:
    return L.decided(_links(spark, d)).select("sentence_id", "table_id", F.col("rank").cast("bigint").alias("rank"), F.array_join("link_sources", "+").alias("sources"), "linked")


SQL["q_l6_decisions"] = f"""
with {_LINKS}, e as (select *, k % 5 = t as ex, case when k % 2 = 0 then case when rk = 1 and p > q then 'model' when (k + t) % 3 = 0 and rk <= 2 then 'model+numeric' end end as m from w)
select sentence_id, t::varchar as table_id, rk as rank, concat_ws('+', case when ex then 'explicit_reference' end, m) as sources, ex or m is not null as linked from e"""


def q_l7_needed_and_predicted(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    need = L.needed_pairs(links).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("needed"))
    return L.predicted_tables(links).join(need, "sentence_id", "left").select("sentence_id", "predicted", F.coalesce("needed", F.lit(0)).alias("needed"))


SQL["q_l7_needed_and_predicted"] = f"""
with {_LINKS} select sentence_id, max(case when rk = 1 then case when q >= p then 'none' else 'Table ' || t end end) as predicted, count(*) filter (k % 5 = t or (k % 2 = 0 and rk <= 2)) as needed from w group by 1"""


def q_l8_status(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    s = L.status((k % 5 == 0).cast("int"), (k % 7 == 0).cast("int"), (k % 3 == 0).cast("int"), F.when(k % 2 == 0, "contradicts").otherwise("states"), (k % 11) / 11, k % 13 != 0)
    return o.select("o_orderkey", s.alias("status"))


SQL["q_l8_status"] = """
select o_orderkey, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'consistent' when o_orderkey % 3 = 0 then 'approximatelyConsistent' when o_orderkey % 2 = 0 and (o_orderkey % 11) / 11.0::double >= 0.5 then 'inconsistent_suspected'
  when o_orderkey % 13 <> 0 then 'unverified' else 'qualitative' end as status from orders"""


def _matches(links: DataFrame) -> DataFrame:
    k = F.col("sentence_id").cast("bigint")
    m = links.where(F.col("supported")).select("document_id", "sentence_id", "table_id", F.when(k % 2 == 0, "exact").otherwise("rounded").alias("kind"), (k % 2).cast("int").alias("row"), F.lit(1).alias("column"))
    return m


def q_l9_link_scores(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return L.evaluate_links(links, _matches(links)).select("document_id", "evaluable_sentences", "tables", "top1", F.round(F.col("mrr") * F.col("evaluable_sentences") * 60).cast("bigint").alias("rr_sixtieths"), "none_rate", "numeric_top1", "random_top1", "row_evaluable", "row_top1", "column_evaluable", "column_top1")


_SCORES = f"""
with {_LINKS}, d as (select document_id, count(distinct t) n, list(distinct t::varchar) ns from w group by 1 having count(distinct t) >= 2),
x as (select w.*, d.n, (k % 4) + 1 as target, ((k + t) % 3 = 0)::int as sup from w join d using (document_id) where list_contains(d.ns, ((k % 4) + 1)::varchar)),
b as (select *, max(sup) over (partition by sentence_id) best from x),
s as (select document_id, sentence_id, any_value(n) n, max((rk = 1 and t = target)::int) top1, max(case when t = target then 1.0::double / rk else 0 end) rr, max((rk = 1 and q >= p)::int) none_,
  (max(best) > 0 and count(*) filter (sup = best) = 1 and bool_or(t = target and sup = best))::int num, max(case when t = target and sup = 1 then ((k % 3) = (k % 2))::int end) rh, max(case when t = target and sup = 1 then 1 end) ch from b group by 1, 2)
select document_id, count(*) evaluable_sentences, any_value(n) tables, round(avg(top1), 4) top1, round(avg(rr), 4) mrr, round(avg(none_), 4) none_rate, round(avg(num), 4) numeric_top1, round(1.0::double / any_value(n), 4) random_top1,
  count(rh) row_evaluable, round(avg(rh), 4) row_top1, count(ch) column_evaluable, round(avg(ch), 4) column_top1 from s group by 1"""


SQL["q_l9_link_scores"] = f"select * exclude (mrr), round(mrr * evaluable_sentences * 60)::bigint as rr_sixtieths from ({_SCORES})"


def q_l10_pooled(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return L.pooled(L.evaluate_links(links, _matches(links))).select("evaluable_sentences", "row_evaluable", "column_evaluable", "top1", "mrr", "none_rate", "numeric_top1", "random_top1", "row_top1", "column_top1")


SQL["q_l10_pooled"] = f"""
with e as ({_SCORES})
select sum(evaluable_sentences)::bigint evaluable_sentences, sum(row_evaluable)::bigint row_evaluable, sum(column_evaluable)::bigint column_evaluable, """ + ", ".join(f"round(sum({r} * {w}) / sum(case when {r} is not null then {w} end), 4) as {r}" for r, w in L.RATES.items()) + " from e"


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 50 == 0, F.lit("same text")).otherwise(_text("Sentence  no. ", _str("o_orderkey"), "\n"))
    r = o.select(_str("o_custkey").alias("document_id"), _str("o_orderkey").alias("sentence_id"), text.alias("text"), (k % 3 == 0).alias("is_claim"), F.when(k % 4 == 0, "result").otherwise("method").alias("role"), F.lit("numeric").alias("type"), F.when(k % 5 == 0, "none").otherwise(_text("Table ", (k % 5).cast("string"))).alias("predicted"))
    sid = F.when(k % 6 == 0, F.lit("lost")).otherwise(_str("o_orderkey"))
    gold_text = F.when(k % 7 == 0, F.lit("other")).when(k % 11 == 0, F.lit("")).otherwise(_text("Sentence no. ", _str("o_orderkey")))
    g = o.where(k % 2 == 0).select(_str("o_custkey").alias("document_id"), sid.alias("sentence_id"), gold_text.alias("text"), F.when(k % 9 == 0, "").when(k % 3 == 0, "yes").otherwise("No").alias("gold_is_claim"), F.when(k % 8 == 0, "result").otherwise("").alias("gold_role"), F.lit("numeric").alias("gold_type"), F.when(k % 10 == 0, "ninguna").otherwise(_text("table ", (k % 5).cast("string"))).alias("gold_table"))
    return r, g


def q_l11_claim_scores(spark: SparkSession, d: str) -> DataFrame:
    r, g = _records(spark, d)
    return L.scored_claims(r, g)


SQL["q_l11_claim_scores"] = """
with r as (select o_custkey c, o_orderkey k, case when o_orderkey % 50 = 0 then 'same text' else 'Sentence no. ' || o_orderkey end t from orders),
u as (select c, t, count(*) n, any_value(k) k from r group by 1, 2 having count(*) = 1),
g as (select o_custkey c, o_orderkey k, o_orderkey % 6 = 0 lost, case when o_orderkey % 7 = 0 then 'other' when o_orderkey % 11 = 0 then '' else 'Sentence no. ' || o_orderkey end gt from orders where o_orderkey % 2 = 0),
m as (select g.*, case when not lost then g.k else u.k end rk, lost and u.k is not null rec from g left join u on u.c = g.c and u.t = g.gt and g.gt <> ''),
n as (select m.*, rk is null mis, rk is not null and gt <> '' and (case when rk % 50 = 0 then 'same text' else 'Sentence no. ' || rk end) <> gt mm from m),
o as (select *, not mis and not mm ok, case when k % 9 = 0 then null else k % 3 = 0 end gold, coalesce(rk % 3 = 0, false) said, case when k % 10 = 0 then 'none' else (k % 5)::varchar end target, case when rk % 5 = 0 then 'none' else (rk % 5)::varchar end got from n),
c as (select count(*) filter (ok and gold is not null) labeled, count(*) filter (mis) missing_sentences, count(*) filter (mm) text_mismatches, count(*) filter (rec) recovered_by_text, count(*) filter (ok and gold and said) tp, count(*) filter (ok and not gold and said) fp, count(*) filter (ok and gold and not said) fn,
  count(*) filter (ok and k % 8 = 0) role_labeled, count(*) filter (ok and k % 8 = 0 and rk % 4 = 0) rh, count(*) filter (ok) type_labeled, count(*) filter (ok and target <> 'none') table_labeled, count(*) filter (ok and target <> 'none' and got = target) th, count(*) filter (ok and target = 'none') no_table_labeled, count(*) filter (ok and target = 'none' and got = 'none') nh from o)
select labeled, missing_sentences, text_mismatches, recovered_by_text, tp, fp, fn, round(tp::double / (tp + fp), 4) as "precision", round(tp::double / (tp + fn), 4) as recall, round(2 * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)), 4) as f1,
  role_labeled, round(rh::double / role_labeled, 4) as role_accuracy, type_labeled, 1.0 as type_accuracy, table_labeled, round(th::double / table_labeled, 4) as table_accuracy, no_table_labeled, round(nh::double / no_table_labeled, 4) as no_table_accuracy from c"""


def q_l13_link_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole linking run without a model: mentions as sentences, the reference's tables; links by status and source."""
    t, _ = ground_truth(spark, d)
    m = read(spark, d, "gt_mentions").dropDuplicates(["mention_id"]).where("text is not null")
    sentences = m.select("document_id", F.col("mention_id").alias("sent_pos"), _text("s", _str("mention_id")).alias("sentence_id"), "page", F.lit("3. Results").alias("section"), T.scientific(F.col("text")).alias("text")).withColumn("table_refs", T.table_references(F.col("text")))
    # a table's cells lie together, so that deliveries, rows and tables need one exchange of cells
    c = read(spark, d, "gt_cells").select("table_no", "cell_id", "row_no", "col_no", "cell").repartition("table_no").dropDuplicates(["table_no", "cell_id"])
    row = c.groupBy("table_no", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]).alias("r"))
    grid = row.groupBy(F.col("table_no").cast("int").alias("table_pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "r"))), lambda x: x["r"]).alias("rows"))
    tables = t.drop("mentions").withColumn("caption", F.coalesce("caption", F.lit(""))).join(beside(grid), "table_pos")
    links = P.counted_links(sentences, tables)
    return links.select("status", F.array_join("link_sources", "+").alias("sources"), "n")


def q_l12_histogram(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(q_l8_status(spark, d), "status").select(F.explode("counts").alias("status", "n"))


SQL["q_l12_histogram"] = f"select status, count(*) n from ({SQL['q_l8_status']}) group by 1"


def q_m1_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the event stream, read as a file stream in one go and kept in the shared folder."""
    shared_folder(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get() if not spark.sparkContext.master.startswith("local[") else tempfile.mkdtemp(prefix="gridquill-")
    base = f"{base.rstrip('/')}/stream-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    source = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")

    def write(batch: DataFrame, number: int) -> None:
        stream.event_counts(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("window_start", "event_type").agg(F.sum("n").alias("n")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


SQL["q_m1_stream"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) n from events group by 1, 2"

QUERIES = [v for k, v in list(globals().items()) if k.startswith("q_")]
