"""Values of one quantity brought to its common unit.

A cell's quantity comes from its column header or, in tables that run the other way, from the
label of its row. Its unit is the one in the cell, else in the header, label or first row, else
one that the caption or a mention states for the quantity. The values under one written unit
are a source, and the sources are linked by the entities (sample names) they share. From the
common unit outwards each source is compared, entity by entity, with those solved before: the
median difference in order of magnitude, or for temperatures the quartiles, give its scale and
offset with their error. The estimate is snapped to the nearest known conversion and propagates.
What the notation says is evidence in the snapping: it decides between conversions that the
estimate can't tell apart and gives way where the values plainly contradict it.

Null tables, unlisted quantities, words and missing marks are no values; a value without a
stated unit keeps no conversion. Zeros, bounds and values with errors are values. Repeated
deliveries count once. Nothing is collected but the list of targets.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions.units import STARTS, conversion, known_conversions, quantity_of, tidy
from gridquill.session import settled

SPACE = r"[\s\u00a0\u2000-\u200b\u202f]*"
LEAD = rf"^{SPACE}(?:[<>≤≥~≈±=]|ca\.?|c\.|approx\.?|about)?{SPACE}"
NUMBER = r"([+\u2212-]?(?:[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?|[1-9]\d{0,2}(?:[\u00a0\u202f\u2009 ']\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?|[.,]\d+))"
POWER = rf"(?:{SPACE}[x×*·]{SPACE}10\^?([+\u2212-]?\d+|[\u207b\u207a]?[\u2070\u00b9\u00b2\u00b3\u2074-\u2079]+)|[eE]([+-]?\d+))?"
NOTE = r"(?:\^\(?[a-z]\)?|[*†‡§¶]+|[ᵃᵇᶜᵈ])?"
ERROR = rf"(?:{SPACE}(?:±|\+/-|\+-){SPACE}[\d.,]+(?:[eE][+-]?\d+)?)?(?:\(\d+\))?"
CELL = LEAD + NUMBER + POWER + NOTE + ERROR + NOTE + SPACE + "(.*)$"
STATED = (
    re.compile(r"\bunit of the (?P<name>[\w ]{1,40}?)\s*:\s*(?P<unit>.+)", re.I),
    re.compile(r"\b(?:all )?values of the (?P<name>[\w ]{1,40}?) are (?:given )?in (?P<unit>.+)", re.I),
    re.compile(r"\bthe (?P<name>[\w ]{1,40}?) (?:is|are) (?:given|expressed|reported|quoted|stated|listed) in (?P<unit>.+)", re.I),
    re.compile(r"(?:^|[.;:] )(?P<name>[\w ]{1,40}?) in (?P<unit>.+)"),
)
#: Sources that share fewer entities are compared as a population.
LEAST_SHARED = 3
#: Nats by which a conversion gains that the notation is read as; least error of an estimate, in orders of magnitude or widths.
READING, LEAST_ERROR = 8.0, 0.12
#: Up to so many sources (a row of some 60 bytes each) are broadcast.
BROADCAST_ROWS = 50_000
SNAPPED = "quantity string, unit string, scale double, offset double, how string, shared bigint, log_ratio double, estimated_scale double, estimated_offset double, margin double"


def statements(text: str | None, common: dict[str, str]) -> list[tuple[str, str]]:
    """(quantity, unit) pairs that a caption or mention states."""
    out = []
    if text:
        flat = re.sub(r"([a-z])[-¬­‐][ ]*\r?\n\s*([a-z])", r"\1\2", text)
        flat = re.sub(r"\s+", " ", flat)
        for form in STATED:
            for m in form.finditer(flat):
                named = quantity_of(m["name"].strip())
                if not named or named[2] or named[0] not in common:
                    continue
                ends = [e.start() for e in re.finditer(r"\.(?= |$)|;|$", m["unit"][:40])]
                for e in ends:
                    unit = m["unit"][:e].strip()
                    if unit and conversion(unit, common[named[0]]) is not None:
                        out.append((named[0], unit))
                        break
    return out


def _targets(targets: DataFrame) -> dict[str, str]:
    return {r[0]: r[1] for r in targets.select("quantity", "common_unit").where("quantity is not null and common_unit is not null").collect()}  # the fixed list


def contexts(tables: DataFrame, mentions: DataFrame, common: dict[str, str]) -> DataFrame:
    """table_no, heads array<struct<quantity,unit,fits>>, stated array<struct<quantity,unit>>: what a table says of its columns."""
    passages = mentions.where(r"text rlike '(?i)(?:expressed|given|reported|quoted|stated|listed)\\s+in\\s|unit\\s+of\\s+the|values\\s+of\\s+the'").select("table_no", "text")
    cited = passages.groupBy("table_no").agg(F.collect_set("text").alias("passages"))  # the passages that cite one table
    # deliveries of a table differ in their arrival time only, and its columns are merged by the aggregation below
    sheets = tables.where("table_no is not null").select("table_no", "caption", "col_headers").dropDuplicates(["table_no"]).join(cited, "table_no", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, stated = [], []
            for labels, caption, texts in zip(batch["col_headers"], batch["caption"], batch["passages"], strict=True):
                row = []
                for label in [] if labels is None else labels:
                    q = quantity_of(label) if label else None
                    fits = bool(q) and q[0] in common and conversion(q[2], common[q[0]]) is not None
                    row.append({"quantity": q[0], "unit": tidy(q[2]) if fits else q[2], "fits": fits} if q and q[0] in common else None)
                heads.append(row)
                said = statements(caption, common)
                for text in [] if texts is None else texts:
                    said += statements(text, common)
                stated.append([{"quantity": q, "unit": u} for q, u in dict(reversed(said)).items()])
            yield pd.DataFrame({"table_no": batch["table_no"], "heads": heads, "stated": stated})

    pair = "array<struct<quantity:string,unit:string>>"
    return sheets.mapInPandas(run, f"table_no bigint, heads array<struct<quantity:string,unit:string,fits:boolean>>, stated {pair}")


def first_rows(cells: DataFrame) -> DataFrame:
    """table_no, units map<int,string>: first rows that hold no number but in their label."""
    first = cells.where("row_no = 0 and table_no is not null and col_no is not null").groupBy("table_no", "col_no").agg(F.max(F.trim("cell.s")).alias("s"))
    worded = (F.col("col_no") > 0) & F.col("s").rlike(CELL) & ~F.col("s").rlike(r"^10\^?[-−⁻]")
    return (
        first.groupBy("table_no")  # the columns of one table
        .agg(F.max(F.coalesce(worded, F.lit(False))).alias("numbers"), F.map_from_entries(F.collect_list(F.struct("col_no", F.coalesce("s", F.lit(""))))).alias("units"))
        .where("not numbers")
        .select("table_no", "units")
    )


def _number(mantissa: Column, power: Column, exponent: Column) -> Column:
    text = F.translate(mantissa, "−   '", "-")
    grouped = text.rlike(r"^[+-]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    plain = F.when(grouped, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    raised = F.translate(F.coalesce(F.nullif(power, F.lit("")), F.nullif(exponent, F.lit("")), F.lit("0")), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−", "0123456789-+-")
    return plain.try_cast("double") * F.pow(F.lit(10.0), raised.try_cast("double"))


def resolved(cells: DataFrame, tables: DataFrame, mentions: DataFrame, targets: DataFrame) -> DataFrame:
    """cell_id, table_no, entity, quantity, unit, origin, value: every value of a listed quantity, with its stated unit or null."""
    common = _targets(targets)
    said = contexts(tables, mentions, common).join(first_rows(cells), "table_no", "left")
    s = F.col("cell.s")
    grid = cells.where("table_no is not null").select("cell_id", "table_no", "row_no", "col_no", s.alias("s"), "cell.kind", "cell.i", "cell.d")
    label = F.max(F.when(F.col("col_no") == 0, F.col("s"))).over(Window.partitionBy("table_no", "row_no"))  # a row of a printed table
    joined = grid.join(said, "table_no").withColumn("label", label)
    plain = F.coalesce("d", F.col("i").cast("double"))
    # one match for all groups of a text cell; numbers need none
    parts = F.when(F.col("kind") == "s", F.split(F.when(F.col("s").rlike(r"\d"), F.regexp_replace("s", CELL, "\u0001$1\u0001$2\u0001$3\u0001$4")), "\u0001"))
    head = F.get("heads", F.col("col_no"))
    measured = joined.where((F.col("col_no") > 0) & (F.col("kind") != "m") & ~((F.col("row_no") == 0) & F.col("units").isNotNull())).withColumn("head", head).where(F.col("head.quantity").isNotNull() | F.col("label").rlike(STARTS))
    read = measured.withColumn("plain", plain).withColumn("parts", parts).where((F.size("parts") == 5) | F.col("plain").isNotNull())
    tail = F.trim(F.coalesce(F.get("parts", F.lit(4)), F.lit("")))
    settled_by_head = F.coalesce(F.col("head.fits") & (tail == ""), F.lit(False))
    open_ = lambda c: F.when(~settled_by_head, F.coalesce(c, F.lit("")))
    judge = F.pandas_udf(_judge(common), "struct<quantity:string,unit:string,origin:string,entity:string>")
    asked = judge(
        open_(F.col("head.quantity")),
        open_(F.col("head.unit")),
        open_(F.col("label")),
        open_(F.when(F.col("row_no") > 0, F.col("units")[F.col("col_no")])),
        open_(tail),
        open_(F.to_json(F.when(F.size("stated") > 0, F.col("stated")))),
    )
    by_head = F.struct(F.col("head.quantity").alias("quantity"), F.col("head.unit").alias("unit"), F.lit("header").alias("origin"), F.col("label").alias("entity"))
    value = F.coalesce("plain", _number(F.get("parts", F.lit(1)), F.get("parts", F.lit(2)), F.get("parts", F.lit(3))))
    out = read.select("cell_id", "table_no", F.when(settled_by_head, by_head).otherwise(asked).alias("r"), value.alias("value"))
    return out.where("r.quantity is not null").select("cell_id", "table_no", "r.entity", "r.quantity", "r.unit", "r.origin", "value")


def _judge(common: dict[str, str]):
    known: dict[tuple[str, ...], tuple[str | None, str | None, str | None, str | None]] = {}

    def one(head: str, head_unit: str, label: str, row_unit: str, tail: str, stated: str):
        quantity, unit, entity = head or None, head_unit, label
        if quantity is None:
            named = quantity_of(label) if label else None
            if named is None or named[0] not in common:
                return None, None, None, None
            quantity, unit, entity = named[0], named[2], None
        target = common[quantity]
        tail = tail.strip()
        if tail:
            if conversion(tail, target) is not None:
                return quantity, tidy(tail), "cell", entity
            if not re.match(r"[([\-–/]|\^", tail):
                return None, None, None, None  # a name or another quantity's value
        if unit and conversion(unit, target) is not None:
            return quantity, tidy(unit), "header", entity
        if row_unit and conversion(row_unit, target) is not None:
            return quantity, tidy(row_unit), "row", entity
        if unit:
            return quantity, tidy(unit), "header", entity
        for x in json.loads(stated) if stated else ():
            if x["quantity"] == quantity:
                return quantity, tidy(x["unit"]), "text", entity
        return quantity, None, None, entity

    def judge(head: pd.Series, head_unit: pd.Series, label: pd.Series, row_unit: pd.Series, tail: pd.Series, stated: pd.Series) -> pd.DataFrame:
        out = []
        for key in zip(head, head_unit, label, row_unit, tail, stated, strict=True):
            if key[0] is None:  # settled by its header
                out.append((None, None, None, None))
                continue
            got = known.get(key)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[key] = one(*key)
            out.append(got)
        return pd.DataFrame(out, columns=["quantity", "unit", "origin", "entity"])

    return judge


def levels(values: DataFrame) -> DataFrame:
    """quantity, unit, entity, v, l: each source's mean value and mean order of magnitude per entity, null values and units apart."""
    magnitude = F.when(F.col("value") > 0, F.log10("value"))
    own = values.where("unit is not null and value is not null").groupBy("quantity", "unit", "entity")
    return own.agg(F.avg("value").alias("v"), F.avg(magnitude).alias("l"))


def _q(c: Column | str, p: float) -> Column:
    return F.percentile_approx(c, p, 200)


def compared(sources: DataFrame, reference: DataFrame) -> DataFrame:
    """quantity, unit, shared, ratio, spread, scale, offset, middle, width: robust scale and offset of each source against a reference.

    ``reference`` has quantity, entity, m (mean value) and lm (mean order of magnitude) in the
    common unit. The entities that both sides record are linked by an equi-join with one row per
    entity on the reference's side: sources are compared with what is solved already, never all
    with all. ``ratio`` is the median of the entities' differences in order of magnitude, ``spread``
    their deviation; ``scale`` and ``offset`` match the quartiles.
    """
    both = sources.where("entity is not null").join(reference, ["quantity", "entity"])
    d = F.col("lm") - F.col("l")
    out = both.groupBy("quantity", "unit").agg(
        F.count(F.lit(1)).alias("shared"), F.count(d).alias("positive"), _q(d, 0.5).alias("ratio"), F.stddev(d).alias("spread"),
        _q("v", 0.25).alias("v1"), _q("v", 0.5).alias("v2"), _q("v", 0.75).alias("v3"), _q("m", 0.25).alias("m1"), _q("m", 0.5).alias("m2"), _q("m", 0.75).alias("m3"),
    )
    return _matched(out).where(F.col("shared") >= LEAST_SHARED)


def populations(sources: DataFrame, reference: DataFrame) -> DataFrame:
    """As ``compared``, of sources that share no entities: their whole population against the reference's."""
    side = lambda df, v, l, tag: df.groupBy("quantity", *(["unit"] if tag == "v" else [])).agg(F.count(F.lit(1)).alias(f"{tag}n"), F.count(l).alias(f"{tag}p"), _q(l, 0.5).alias(f"{tag}l"), F.stddev(l).alias(f"{tag}s"), *[_q(v, k / 4).alias(f"{tag}{k}") for k in (1, 2, 3)])  # noqa: E731, E741
    both = side(sources, "v", "l", "v").join(side(reference, "m", "lm", "m"), "quantity")  # the reference's side has one row per quantity
    spread = F.sqrt(F.pow(F.coalesce("vs", "ms"), 2) + F.pow("ms", 2))
    out = both.select("quantity", "unit", F.col("vn").alias("shared"), F.col("vp").alias("positive"), (F.col("ml") - F.col("vl")).alias("ratio"), spread.alias("spread"), *[f"{t}{k}" for t in "vm" for k in (1, 2, 3)])
    return _matched(out)


def _matched(out: DataFrame) -> DataFrame:
    scale = F.try_divide(F.col("m3") - F.col("m1"), F.nullif(F.col("v3") - F.col("v1"), F.lit(0.0)))
    out = out.withColumn("scale", F.when(scale > 0, scale))
    return out.select("quantity", "unit", "shared", "positive", "ratio", "spread", "scale", (F.col("m2") - F.col("scale") * F.col("v2")).alias("offset"), F.col("v2").alias("middle"), F.col("m2").alias("wanted"), (F.col("m3") - F.col("m1")).alias("width"))


def snapped(estimate: dict, common: str, readable: bool = True) -> tuple[float, float, float] | None:
    """(scale, offset, margin in nats) of the known conversion nearest to an estimate; None where nothing is estimated.

    Every known conversion into ``common`` is scored by how far the estimate is from it in
    standard errors. What the notation is read as gains ``READING`` nats, so it settles what the
    estimate can't tell apart (bar and atm), and loses to values that plainly contradict it. With
    ``readable`` off notations are opaque and the estimate decides alone.
    """
    n, menu = estimate["positive"] or 0, known_conversions(common)
    reading = conversion(estimate["unit"], common) if readable else None
    choices = {*menu, reading} if reading else set(menu)
    shifted = any(o for _, o in choices)
    if shifted and (not estimate["shared"] or estimate["wanted"] is None) or not shifted and (not n or estimate["ratio"] is None):
        return None
    root = math.sqrt(max(estimate["shared"] if shifted else n, 1))
    scored = []
    for scale, offset in choices:
        if shifted:  # degrees: a ratio of values means nothing, so quartiles give scale and offset
            width = max(estimate["width"] or 0.0, 1.0)
            miss = ((scale * estimate["middle"] + offset - estimate["wanted"]) / (width * max(1.3 / root, LEAST_ERROR))) ** 2
            if estimate["scale"]:
                miss += (math.log10(scale / estimate["scale"]) / max(1.0 / root, LEAST_ERROR)) ** 2
        else:
            error = max(1.25 * (estimate["spread"] or 1.0) / root, LEAST_ERROR)
            miss = ((math.log10(scale) - estimate["ratio"]) / error) ** 2
        scored.append((-miss / 2 + READING * ((scale, offset) == reading), scale, offset))
    scored.sort(reverse=True)
    return scored[0][1], scored[0][2], scored[0][0] - scored[1][0] if len(scored) > 1 else math.inf


def _snap(estimates: DataFrame, common: dict[str, str], how: str, readable: bool) -> DataFrame:
    """The estimates with the known conversion they are snapped to; those that fit none are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for e in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                got = snapped(e, common[e["quantity"]], readable)
                if got is not None:
                    out.append((e["quantity"], e["unit"], got[0], got[1], how, e["shared"], e["ratio"], e["scale"], e["offset"], got[2]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SNAPPED.split(", ")])

    return estimates.mapInPandas(run, SNAPPED)


def graph(values: DataFrame, common: dict[str, str], readable: bool = True, estimated: bool = True) -> DataFrame:
    """quantity, unit, scale, offset, how, ...: the conversion of every source, from the common unit outwards.

    The common unit's own source is the start. In each round the sources that share entities with
    solved ones are estimated against these, snapped, and solved for the next round; what then
    still stands alone is compared as a population. ``how`` is ``common``, ``estimated``,
    ``population``, or ``read`` where a source has no value to compare (zeros only) but a readable
    notation. Without the common unit among the sources its most frequent readable one starts.
    Sources are rows of a relation throughout: their number has no bound here.
    """
    spark = values.sparkSession
    own = settled(levels(values))
    named = F.broadcast(spark.createDataFrame([(q, tidy(c)) for q, c in common.items()], "quantity string, unit string"))  # the fixed list of targets
    read = settled(_readings(own.groupBy("quantity", "unit").agg(F.count(F.lit(1)).alias("n")), common))
    n_sources = read.count()
    small = F.broadcast if n_sources <= BROADCAST_ROWS else lambda df: df  # beyond that the planner joins as it sees fit
    readings = read.where("scale is not null") if readable else read.limit(0)
    blank = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in SNAPPED.split(", ")[5:]}
    own_unit = read.join(named, ["quantity", "unit"], "left_semi").select("quantity", "unit", F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("common").alias("how"))
    seeds = readings.join(own_unit, "quantity", "left_anti").groupBy("quantity").agg(F.max_by(F.struct("unit", "scale", "offset"), F.struct("n", "unit")).alias("s"))
    solved = settled(own_unit.unionByName(seeds.select("quantity", "s.*", F.lit("read").alias("how"))).withColumns(blank))
    known, found = solved.count(), 1
    while estimated and known < n_sources and found:
        more = settled(_snap(compared(_apart(own, solved, small), _reference(own, solved, small)), common, "estimated", readable))
        found = more.count()
        known, solved = known + found, solved.unionByName(more)
    if estimated and known < n_sources:
        solved = solved.unionByName(settled(_snap(populations(_apart(own, solved, small), _reference(own, solved, small)), common, "population", readable)))
        rest = _apart(readings, solved, small).select("quantity", "unit", "scale", "offset", F.lit("read").alias("how"))
        solved = solved.unionByName(settled(rest.withColumns(blank)))
    return small(solved)


def _apart(sources: DataFrame, solved: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return sources.join(small(solved.select("quantity", "unit")), ["quantity", "unit"], "left_anti")


def _reference(own: DataFrame, solved: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """quantity, entity, m, lm: an entity's value in the common unit, over its solved sources."""
    value = F.col("v") * F.col("scale") + F.col("offset")
    magnitude = F.when(F.col("offset") == 0, F.col("l") + F.log10("scale"))
    return own.join(small(solved.select("quantity", "unit", "scale", "offset")), ["quantity", "unit"]).groupBy("quantity", "entity").agg(F.avg(value).alias("m"), F.avg(magnitude).alias("lm"))


def _readings(sources: DataFrame, common: dict[str, str]) -> DataFrame:
    """The sources with the conversion that their notation is read as."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [conversion(u, common[q]) or (None, None) for q, u in zip(batch["quantity"], batch["unit"], strict=True)]
            yield batch.assign(scale=[g[0] for g in got], offset=[g[1] for g in got])

    return sources.mapInPandas(run, "quantity string, unit string, n bigint, scale double, offset double")


def converted(cells: DataFrame, tables: DataFrame, mentions: DataFrame, targets: DataFrame, readable: bool = True, estimated: bool = True) -> DataFrame:
    """cell_id, table_no, quantity, value, unit, origin, common_unit, scale, offset, how, common_value.

    One row per value of a listed quantity; without a unit or conversion the last columns are null.
    ``readable`` and ``estimated`` switch the reading of notations and the estimation off, to
    measure what each does.
    """
    common = _targets(targets)
    values = settled(resolved(cells, tables, mentions, targets))
    found = graph(values, common, readable, estimated).select("quantity", "unit", "scale", "offset", "how")
    out = values.join(found, ["quantity", "unit"], "left")
    to = F.lit(None).cast("string") if not common else F.create_map(*[F.lit(x) for pair in sorted(common.items()) for x in pair])[F.col("quantity")]
    out = out.withColumn("common_unit", F.when(F.col("scale").isNotNull(), to))
    once = out.select("cell_id", "table_no", "quantity", "value", "unit", "origin", "common_unit", "scale", "offset", "how").dropDuplicates(["cell_id"])
    return once.withColumn("common_value", F.col("value") * F.col("scale") + F.col("offset"))


def sources(cells: DataFrame, tables: DataFrame, mentions: DataFrame, targets: DataFrame) -> DataFrame:
    """quantity, unit, scale, offset, how, shared, log_ratio, estimated_scale, estimated_offset, margin: the solved graph of sources."""
    return graph(settled(resolved(cells, tables, mentions, targets)), _targets(targets))


def found(cells: DataFrame, tables: DataFrame, mentions: DataFrame, targets: DataFrame) -> DataFrame:
    """cell_id of each value stated in a unit that isn't the common one nor equal to it."""
    got = converted(cells, tables, mentions, targets)
    return got.where("scale is not null and (abs(scale - 1) > 1e-6 or abs(offset) > 1e-6)").select("cell_id")
