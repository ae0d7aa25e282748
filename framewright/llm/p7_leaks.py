"""Problem 7: documents that give away passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.leaks import leaked_items
from framewright.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id) of every item that a document quotes."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
