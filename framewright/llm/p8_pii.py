"""Problem 8: personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.pii import detect, redact
from framewright.sources.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pii_type, start_pos) of each spot."""
    return detect(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) of every document with typed placeholders in place of its spots."""
    return redact(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
SQL: dict[str, str] = {}
