"""Named queries of the core and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridquill.operators import records, units
from gridquill.plans import corpus_queries, text_queries
from gridquill.session import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return records.entries(read(spark, folder, "corpus_records"))


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    return records.documents(records.triples(read(spark, folder, "corpus_records")))


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    return records.tables(records.triples(read(spark, folder, "corpus_records")))


def p1_cells(spark: SparkSession, folder: str) -> DataFrame:
    return records.cells(records.triples(read(spark, folder, "corpus_records")))


def p1_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return records.mentions(records.triples(read(spark, folder, "corpus_records")))


def p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    return records.rows(records.triples(read(spark, folder, "corpus_records")))


def p1_children(spark: SparkSession, folder: str) -> DataFrame:
    return records.children(records.triples(read(spark, folder, "corpus_records")))


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return records.rejects(read(spark, folder, "corpus_records"))


def _measured(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return tuple(read(spark, folder, t) for t in ("gt_cells", "gt_tables", "gt_mentions", "unit_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.found(*_measured(spark, folder))


def p3_converted(spark: SparkSession, folder: str) -> DataFrame:
    return units.converted(*_measured(spark, folder))


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    return units.sources(*_measured(spark, folder))


PROBLEMS = (p1_found, p1_documents, p1_tables, p1_cells, p1_mentions, p1_rows, p1_children, p1_rejects, p3_found, p3_converted, p3_sources)


MODULES = (text_queries, corpus_queries)


def queries() -> dict[str, Query]:
    every = [*PROBLEMS, *(q for m in MODULES for q in m.QUERIES)]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
