"""Problem 6: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.bpe import encode_texts
from framewright.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) by byte_bpe_50k, without special tokens; null and empty texts give an empty list."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
