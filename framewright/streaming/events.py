"""Streaming forms of the ordered operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.sources.artifacts import upsert


def sessions(stream: DataFrame, key: str, time: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): runs of events at most ``gap`` apart, closed by the watermark; later events are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(stream: DataFrame, by: str, time: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total): tumbling windows with a watermark for late rows."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), by, "n", "total")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so that a resumed feed does no work twice."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of an upserted table, oldest first; a version counts once its success mark is written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if re.fullmatch(r"v\d{12}", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of an upserted table."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path}: no version of the table yet")
    return spark.read.parquet(f"{path}/{found[-1]}")


def upsert_into(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keyed last-value merge of a stream into a table by batches; each batch merges into the newest complete version and writes the next.

    The versions in the folder say which is current, so a restarted stream goes on from the table it left. A batch that is repeated
    after a failure gives the same table, since the newest row of a key wins whatever the number of merges. The version before the
    current one stays for its readers, older ones are deleted. With mode ``update`` the stream is an aggregation whose changed rows are merged.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        found = versions(spark, path)
        old = spark.read.parquet(f"{path}/{found[-1]}") if found else batch.limit(0)
        following = int(found[-1][1:]) + 1 if found else 0
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{following:012d}")
        jvm = spark.sparkContext._jvm
        for name in found[:-1]:
            gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
