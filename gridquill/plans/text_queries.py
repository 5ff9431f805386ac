"""Queries for sources, text functions and table parsing, with their SQL.

Tables in text are rendered from relations here and parsed back by the operators; the SQL never
sees the text, so it states what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.functions import latex
from gridquill.functions import text as T
from gridquill.operators import corpus as C
from gridquill.operators import tables as tab
from gridquill.plans import sql as S
from gridquill.session import read
from gridquill.sources import corpus as files
from gridquill.sources import extractors as X

SQL: dict[str, str] = {}


def q_s2_first_files(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "papers").select(F.element_at(F.split("source_pdf", "/"), -1).alias("name")).distinct()
    return files.in_order(names, 25)


SQL["q_s2_first_files"] = "select distinct string_split(source_pdf, '/')[-1] as name from papers order by name limit 25"


def q_s3_working_set(spark: SparkSession, d: str) -> DataFrame:
    papers = read(spark, d, "papers")
    reference = papers.select("source_pdf", F.col("registered_at").alias("position"))
    there = read(spark, d, "gt_tables").select("document_id").distinct()
    files = papers.join(there, "document_id", "left_semi").select(F.col("source_pdf").alias("name"))
    return C.working_set(reference, files)


SQL["q_s3_working_set"] = """
select r.name, r.position, coalesce(f.found, false) found
from (select string_split(source_pdf, '/')[-1] as name, min(registered_at) as position from papers group by 1) r
left join (select distinct source_pdf as name, true as found from papers where document_id in (select document_id from gt_tables)) f using (name)"""


def q_s4_name_match(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "papers").select(F.col("source_pdf").alias("name")).distinct()
    return files.named_like(names, "TiO2")


SQL["q_s4_name_match"] = "select distinct source_pdf as name from papers where contains(lower(source_pdf), 'tio2')"


def q_n1_scientific(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, "gt_tables").select(F.explode("col_headers").alias("label")).distinct()
    return heads.select("label", T.scientific(F.col("label")).alias("plain"))


SQL["q_n1_scientific"] = f"select label, {S.scientific('label')} as plain from (select distinct unnest(col_headers) as label from gt_tables)"


def q_n2_scripts(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    raw = F.concat(F.lit("SiO₂ "), F.col("p_size").cast("string"), F.lit(" µ mol g⁻¹ h ^ -1 – Å a_bc E_g"))
    return part.select("p_partkey", T.scientific(raw).alias("plain"))


SQL["q_n2_scripts"] = "select p_partkey, 'SiO2 ' || p_size || ' umol g^-1 h^-1 - A a_bc Eg' as plain from part"


def q_n3_header_labels(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    mark = F.element_at(F.array(F.lit("^a"), F.lit(" †"), F.lit(" ^b *"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select("p_partkey", T.header_label(F.concat("p_brand", mark)).alias("label"))


SQL["q_n3_header_labels"] = "select p_partkey, p_brand as label from part"


def q_n4_units(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("µmol·g⁻¹·h⁻¹,", "m² g⁻¹ ;", " cm^3 × g ^-1", "°C:"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", T.unit(raw).alias("unit"), T.unit_key(raw).alias("key"))


SQL["q_n4_units"] = """
select p_partkey, ['umol g^-1 h^-1', 'm^2 g^-1', 'cm^3 g^-1', '°C'][p_partkey % 4 + 1] as unit,
  ['umol·g⁻¹·h⁻¹,', 'm²g⁻¹;', 'cm3×g-1', 'degc:'][p_partkey % 4 + 1] as key from part"""


def q_n5_cells(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    q = F.col("l_quantity").cast("int")
    raw = (
        F.when(k == 0, F.format_number(q * 1000 + 1000, 0))
        .when(k == 1, F.concat(q.cast("string"), F.lit(",25")))
        .when(k == 2, F.lit(" – "))
        .when(k == 3, F.concat(F.lit("ND "), "l_returnflag"))
        .otherwise(F.concat(q.cast("string"), F.lit(".0")))
    )
    cell = T.coerced(raw)
    return li.select("l_orderkey", "l_linenumber", cell["kind"].alias("kind"), cell["s"].alias("s"), cell["i"].alias("i"), cell["d"].alias("d"))


SQL["q_n5_cells"] = """
with x as (select l_orderkey, l_linenumber, l_quantity::int q, l_returnflag f, (l_orderkey + l_linenumber) % 5 k from lineitem)
select l_orderkey, l_linenumber,
  case k when 0 then 'i' when 1 then 'f' when 2 then 'm' when 3 then 's' else 'f' end as kind,
  case k when 0 then (q * 1000 + 1000)::varchar when 1 then q || '.25' when 2 then '-' when 3 then 'ND ' || f else q || '.0' end as s,
  case when k = 0 then (q * 1000 + 1000)::bigint end as i,
  case k when 1 then q + 0.25 when 4 then q::double end as d from x"""


def q_n6_ids(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    file = F.concat(F.lit("data/"), "s_name", F.lit(" (2nd Ed.)-main.pdf"))
    return s.select("s_suppkey", T.document_id(file).alias("document_id"), T.turtle_name("article", F.col("s_name")).alias("iri"))


SQL["q_n6_ids"] = r"""
select s_suppkey, 'doc_' || trim(regexp_replace(lower(s_name || ' (2nd Ed.)'), '[^a-z0-9]+', '_', 'g'), '_') as document_id,
  'inst:article_' || trim(regexp_replace(s_name, '[^A-Za-z0-9_-]+', '_', 'g'), '_') as iri from supplier"""


def q_n7_titles(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "papers").select("document_id", "title", "source_pdf").distinct()
    k = F.length("document_id") % 5
    raw = F.when(k == 0, F.col("source_pdf")).when(k == 1, F.concat(F.lit("Microsoft Word - "), "title")).when(k == 2, F.lit("MJAS Vol 21 No 1 (2017)")).when(k == 3, F.lit("ja304 1..6 pages")).otherwise(F.col("title"))
    return p.select("document_id", T.article_title(raw).alias("title"))


SQL["q_n7_titles"] = rf"""
with p as (select distinct document_id, title, source_pdf, length(document_id) % 5 k from papers),
r as (select document_id, case k when 1 then title when 4 then title when 0 then source_pdf end as t, k from p),
c as (select document_id, {S.collapsed("trim(" + S.collapsed("t") + ", '*')")} as t, k from r)
select document_id, case when t is null or k in (0, 2, 3) and (regexp_matches(t, '(?i)\.pdf$') or k > 0) or lower(t) in ('no job name', 'untitled', 'manuscript', 'doi:', 'title')
  or contains(t, '\') or contains(t, '..') or regexp_matches(t, '(?i)\.(?:pdf|txt|doc)$') or len(string_split_regex(t, '\s+')) < 3 then '' else t end as title from c"""


def q_n8_captions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "gt_tables").where("caption is not null").select("table_no", T.scientific(F.col("caption")).alias("c")).distinct()
    return t.select("table_no", T.caption_title(F.col("c")).alias("title"), T.is_label_only(F.col("c")).alias("label_only"), T.caption_number(F.col("c")).alias("number"))


SQL["q_n8_captions"] = rf"""
with t as (select distinct table_no, {S.scientific("caption")} as c from gt_tables where caption is not null)
select table_no, {S.caption_title("c")} as title, {S.label_only("c")} as label_only,
  nullif(upper(regexp_extract(c, '^(?:\*\*)?(?:Table|Tab\.?)\s+({S.NUMBER})(?:\*\*)?\b', 1, 'i')), '') as number from t"""


def q_n9_references(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    k = (F.col("o_orderkey") % 40).cast("string")
    raw = F.concat(F.lit("As Tables "), k, F.lit(" and S7 show, see Fig. 2 and table "), k, F.lit("; the rest is in Tab. IV."))
    return o.select("o_orderkey", F.array_join(T.table_references(raw), ",").alias("refs"), T.masked_references(raw).alias("masked"))


SQL["q_n9_references"] = """
select o_orderkey, array_to_string(list_sort([(o_orderkey % 40)::varchar, 'S7', 'IV']), ',') as refs,
  'As the table show, see Fig. 2 and the table; the rest is in the table.' as masked from orders"""


def q_n10_math(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit("H$_{"), k, F.lit(r"}$O at 3 $\times$ 10$^{"), k, F.lit(r"}$ $\mu$ mol, \(CO_2\), cost $7 or $8"))
    return s.select("s_suppkey", T.scientific(latex.expanded(raw)).alias("plain"))


SQL["q_n10_math"] = "select s_suppkey, 'H' || s_suppkey || 'O at 3 × 10^' || s_suppkey || ' u mol, CO2, cost $7 or $8' as plain from supplier"


def q_n11_layout_marks(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    raw = F.concat(F.lit("<|det|>title [1, 2]<|/det|>"), "c_name", F.lit("\n<|det|>image [3, 4]<|/det|>\n<|det|>text [5]<|/det|>It buys "), "c_mktsegment", F.lit(".\nOften."))
    return c.select("c_custkey", T.layout_stripped(raw).alias("plain"))


SQL["q_n11_layout_marks"] = "select c_custkey, c_name || chr(10) || chr(10) || 'It buys ' || c_mktsegment || '.' || chr(10) || 'Often.' as plain from customer"


def q_n12_merged_captions(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    parts = F.array(F.concat(F.lit("Table "), F.col("n_nationkey").cast("string")), F.concat(F.lit("Table "), F.col("n_nationkey").cast("string"), F.lit(" "), "n_name"), F.col("n_name"), F.lit("in 1998"))
    return n.select("n_nationkey", T.merged_captions(parts).alias("caption"))


SQL["q_n12_merged_captions"] = "select n_nationkey, 'Table ' || n_nationkey || ' ' || replace(n_name, '_', '') || ' in 1998' as caption from nation"


def _by_nation(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _joined(rows: DataFrame, key: str, order: str, piece, sep: str = "") -> DataFrame:
    """One text per key: the pieces of its rows in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("piece")))), lambda x: x["piece"])
    return rows.groupBy(key).agg(F.array_join(lines, sep).alias("body"))


def _cells(flat: DataFrame, *names: str) -> DataFrame:
    return tab.exploded(flat).select(*names, "row_no", "col_no", "column", "cell")


def q_t1_html(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "o_orderpriority", F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>"))
    pages = _joined(_by_nation(spark, d), "n_name", "o_orderpriority", row).withColumn("html", F.concat(F.lit("<table><thead><tr><th>priority</th><th>orders</th></tr></thead><tbody>"), "body", F.lit("</tbody></table>")))
    flat = pages.select("n_name", tab.parse_html(F.col("html")).alias("flat"))
    c = _cells(flat, "n_name")
    label, value = c.where("col_no = 0").select("n_name", "row_no", F.col("cell.s").alias("o_orderpriority")), c.where("col_no = 1").select("n_name", "row_no", F.col("cell.i").alias("n"))
    return label.join(value, ["n_name", "row_no"]).select("n_name", "o_orderpriority", "n")


SQL["q_t1_html"] = "select n_name, o_orderpriority, count(*) n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all"


def q_t2_spans(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(F.col("l_linestatus") == s).alias(s) for s in "FO"], F.sum(F.col("l_quantity")).cast("bigint").alias("q"))
    body = F.concat(F.lit("<tr><td>"), "l_returnflag", F.lit("</td><td>"), F.col("F").cast("string"), F.lit("</td><td>"), F.col("O").cast("string"), F.lit("</td><td>"), F.col("q").cast("string"), F.lit("</td></tr>"))
    head = "<table><thead><tr><th rowspan='2'>flag</th><th colspan='2'>status</th><th rowspan='2'>quantity</th></tr><tr><th>F</th><th>O</th></tr></thead>"
    flat = g.select("l_returnflag", tab.parse_html(F.concat(F.lit(head), body, F.lit("</table>"))).alias("flat"))
    return _cells(flat, "l_returnflag").where("col_no > 0").select("l_returnflag", "column", F.col("cell.i").alias("n"))


SQL["q_t2_spans"] = """
with g as (select l_returnflag, count_if(l_linestatus = 'F') f, count_if(l_linestatus = 'O') o, sum(l_quantity)::bigint q from lineitem group by 1)
select l_returnflag, 'statusF' as "column", f::bigint as n from g union all select l_returnflag, 'statusO', o::bigint from g union all select l_returnflag, 'quantity', q from g"""


def q_t3_caption(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    body = _joined(n, "n_regionkey", "n_nationkey", row).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    html = F.concat(F.lit("<table><thead><tr><th colspan=2>Table "), F.col("r_regionkey").cast("string"), F.lit("</th></tr><tr><th colspan=2>Nations of "), "r_name", F.lit("</th></tr><tr><th>nation</th><th>key</th></tr></thead><tbody>"), "body", F.lit("</tbody></table>"))
    flat = body.select("r_regionkey", tab.parse_html(html).alias("flat"))
    return flat.select("r_regionkey", F.col("flat.embedded_caption").alias("caption"), F.array_join("flat.columns", "|").alias("columns"), F.size("flat.rows").cast("bigint").alias("n_rows"))


SQL["q_t3_caption"] = """
select r_regionkey, 'Table ' || r_regionkey || ' Nations of ' || r_name as caption, 'nation|key' as columns, count(*) n_rows
from nation join region on n_regionkey = r_regionkey group by r_regionkey, r_name"""


def q_t4_unit_row(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("size"))
    grid = F.array(F.array(F.lit("brand"), F.lit("rate"), F.lit("")), F.array(F.lit("-"), F.lit("umol/g"), F.lit("nm")), F.array(F.col("p_brand"), F.col("n").cast("string"), F.col("size").cast("string")))
    flat = p.select("p_brand", tab.parse_grid(grid).alias("flat"))
    return _cells(flat, "p_brand").where("col_no > 0").select("p_brand", "column", F.col("cell.i").alias("v"))


SQL["q_t4_unit_row"] = """
with p as (select p_brand, count(*) n, max(p_size) s from part group by 1)
select p_brand, 'rate (umol/g)' as "column", n::bigint v from p union all select p_brand, 'rate (nm)', s::bigint from p"""


def q_t5_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    row = F.concat(F.lit("| **"), "n_name", F.lit("** | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    pages = _joined(n, "n_regionkey", "n_nationkey", row, "\n").select(F.col("n_regionkey").alias("page"), F.concat(F.lit("Some text\n\n| nation | key |\n|:---|---:|\n"), "body", F.lit("\n\nmore")).alias("text"))
    found = tab.extract_tables(pages)
    c = _cells(found.select("page", "syntax", "flat"), "page", "syntax")
    name, key = c.where("col_no = 0").select("page", "syntax", "row_no", F.col("cell.s").alias("n_name")), c.where("col_no = 1").select("page", "row_no", F.col("cell.i").alias("n_nationkey"))
    return name.join(key, ["page", "row_no"]).select("page", "syntax", "n_name", "n_nationkey")


SQL["q_t5_markdown"] = "select n_regionkey as page, 'markdown' as syntax, replace(n_name, '_', '') as n_name, n_nationkey::bigint as n_nationkey from nation"


def q_t6_grid(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    odd = F.when(F.col("s_suppkey") % 3 == 0, None).otherwise(F.col("s_suppkey").cast("string"))
    grid = F.array(F.array(F.lit("name"), F.lit("key")), F.array(F.col("s_name"), odd), F.array(F.lit(None).cast("string"), F.lit("-")))
    flat = s.select("s_suppkey", tab.parse_grid(grid).alias("flat"))
    return _cells(flat, "s_suppkey").where("col_no = 1").select("s_suppkey", F.col("cell.kind").alias("kind"), F.col("cell.s").alias("s"))


SQL["q_t6_grid"] = "select s_suppkey, case when s_suppkey % 3 = 0 then 'm' else 'i' end as kind, case when s_suppkey % 3 = 0 then '-' else s_suppkey::varchar end as s from supplier"


def q_t7_syntax_choice(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    html, mark = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>", "\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.lit(html + mark)).when(k == 1, F.lit(mark)).when(k == 2, F.lit("no table")).otherwise(F.lit(html + html))
    found = tab.extract_tables(c.select("c_custkey", text.alias("text")))
    return found.groupBy("syntax").agg(F.count(F.lit(1)).alias("tables"), F.count_distinct("c_custkey").alias("pages"))


SQL["q_t7_syntax_choice"] = """
select syntax, sum(n)::bigint as tables, count(*) as pages from (select case c_custkey % 4 when 1 then 'markdown' else 'html' end as syntax, case c_custkey % 4 when 3 then 2 else 1 end as n
from customer where c_custkey % 4 <> 2) group by syntax"""


def q_t8_tei(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Results</head><p coords="3,1,1,1,1">See <ref type="table" target="#t1">Table 1</ref> for '), k,
        F.lit('.</p><figure type="table" xml:id="t1" coords="2,0,0,1,1"><label>1</label><figDesc>Balances</figDesc><table><row><cell cols="2">name</cell></row><row><cell>'), "c_name", F.lit("</cell><cell>"), k,
        F.lit("</cell></row></table></figure></div></body></text></TEI>"),
    )
    g = X.parse_tei(c.select(k.alias("document_id"), xml.alias("xml")))
    return g.select("document_id", "page", "caption", "table_label", "section_title", F.get(F.get("rows", F.lit(1)), F.lit(0)).alias("name"), F.get("mentions", F.lit(0))["text"].alias("mention"), F.get("mentions", F.lit(0))["page"].alias("mention_page"))


SQL["q_t8_tei"] = """
select c_custkey::varchar as document_id, 2::int as page, 'Balances' as caption, 'Table 1' as table_label, 'Results' as section_title, c_name as name,
'See Table 1 for ' || c_custkey || '.' as mention, 3::int as mention_page from customer"""


def q_t9_model_json(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    plain = F.concat(F.lit('{"tables":[{"table_label":"Table 1","caption":"Keys","grid":[["name","key"],["'), "s_name", F.lit('"]]},{"grid":[["x"]]}],"mentions_by_label":[{"table_label":"TABLE  1","mentions":[{"page":"4","text":"see '), k, F.lit('"}]}]}'))
    answer = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), plain, F.lit("\n```"))).otherwise(F.concat(F.lit("Answer "), plain))
    a = s.select(k.alias("document_id"), F.lit(1).alias("page"), answer.alias("answer"))
    g = X.attached_mentions(X.parse_page_answers(a), a)
    return g.select("document_id", "table_label", F.get(F.get("rows", F.lit(1)), F.lit(0)).alias("name"), F.get(F.get("rows", F.lit(1)), F.lit(1)).alias("padded"), F.get("mentions", F.lit(0))["text"].alias("mention"), F.get("mentions", F.lit(0))["page"].alias("mention_page"))


SQL["q_t9_model_json"] = "select s_suppkey::varchar as document_id, 'Table 1' as table_label, s_name as name, '' as padded, 'see ' || s_suppkey as mention, 4::int as mention_page from supplier"


def q_t10_predicted(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    head = F.concat(F.lit("Table "), F.col("s_suppkey").cast("string"), F.lit(" Supplier "), "s_name")
    rows = F.array(F.array(head, head), F.array(F.lit("name"), F.lit("key")), F.array(F.col("s_name"), F.col("s_suppkey").cast("string")))
    grids = s.select((F.col("s_suppkey") % 10).cast("string").alias("document_id"), F.col("s_suppkey").cast("int").alias("page"), F.lit(0).alias("pos"), rows.alias("rows"), F.lit("").alias("caption"), F.lit("").alias("table_label"), F.lit("").alias("section_title"))
    return X.predicted_documents(grids).select("document_id", "table_pos", "page", "caption", "table_label", F.array_join("columns", "|").alias("columns"))


SQL["q_t10_predicted"] = """
select (s_suppkey % 10)::varchar as document_id, row_number() over (partition by s_suppkey % 10 order by s_suppkey)::int as table_pos, s_suppkey::int as page,
'Table ' || s_suppkey || ' Supplier ' || s_name as caption, 'Table ' || s_suppkey as table_label, 'name|key' as columns from supplier"""


def q_t11_page_coordinates(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("x,1")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.col("s_suppkey").cast("string"), F.lit(",1,2,3;9,9,9,9")))
    return s.select("s_suppkey", T.page_of_coordinates(raw).alias("page"))


SQL["q_t11_page_coordinates"] = "select s_suppkey, case when s_suppkey % 3 = 1 then s_suppkey::int else 1 end as page from supplier"

QUERIES = [v for k, v in list(globals().items()) if k.startswith("q_")]
