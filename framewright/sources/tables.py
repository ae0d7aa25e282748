"""Named table access and the column assertion used before planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of ``folder`` (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """Return ``df`` or raise a ValueError that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
