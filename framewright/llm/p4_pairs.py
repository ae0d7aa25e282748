"""Problem 4: defective requests of ``llm_cache``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.pairs import find_defects
from framewright.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, defect) of each defective request."""
    return find_defects(table(spark, d, "llm_cache"), "request_id", "prompt", "response", "params.max_tokens")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
