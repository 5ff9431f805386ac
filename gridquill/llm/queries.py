"""The llm operators' queries: name -> (spark, folder) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquill.llm import canon, encoding, mixing, noise, tokens, truncation
from gridquill.session import read


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.found(*_scanned(spark, folder))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(*_scanned(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(read(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"), read(spark, folder, "source_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(read(spark, folder, "documents"), read(spark, folder, "source_targets"))


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read(spark, folder, "gt_tables"), read(spark, folder, "gt_mentions"), read(spark, folder, "ocr_pages")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return noise.found(*_scanned(spark, folder))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return noise.repaired(*_scanned(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    got = canon.assign(read(spark, folder, "gt_tables"), "table_no", "section_title", read(spark, folder, "section_list"))
    return got.select("table_no", F.col("entry_id").alias("section_id"))


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canon.unmatched(read(spark, folder, "gt_tables"), "table_no", "section_title", read(spark, folder, "section_list"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.found(read(spark, folder, "documents"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.restore(read(spark, folder, "documents"), affected_only=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_repaired, p4_found, p4_unmatched, p5_found, p5_rates, p6_ids, p7_mix, p7_shares, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    return {}
