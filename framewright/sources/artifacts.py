"""Readers and writers of files beside Parquet: all-string CSV, JSON records, optional artifacts, vectors, pictures; safe sinks."""

from __future__ import annotations

import logging
import os
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from framewright.session import shared_folder
from framewright.sources.tables import require_columns

log = logging.getLogger("framewright")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; bad fields become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every column as text and blanks as the empty text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path).na.fill("")


def read_json_records(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A JSON array of records (or one record per line); ``required`` columns are checked by name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return require_columns(df, required or [], path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that may be missing or unreadable: then an empty one with the schema, and a warning."""
    try:
        if exists(spark, path):
            df = spark.read.schema(schema).format(kind).load(path)
            df.take(1)
            return df
    except Exception as e:  # noqa: BLE001 - whatever is wrong with the file, the default holds
        log.warning("%s can't be read: %s", path, str(e)[:200])
    return spark.createDataFrame([], schema)


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """(key, vector) of a vector table."""
    return spark.read.parquet(path).select(key, vector)


def picture_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height of a JPEG, PNG or GIF by its own headers; None for anything else and for files that break off."""
    b = content or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR" and len(b) >= 33 and b.rstrip(b"\0")[-12:-4][-4:] == b"IEND":
        return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:6] in (b"GIF87a", b"GIF89a") and b.rstrip(b"\0")[-1:] == b";":
        return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:2] == b"\xff\xd8" and b.rstrip(b"\0")[-2:] == b"\xff\xd9":
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            mark, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            at += 2 + size
    return None


def read_pictures(spark: SparkSession, path: str, pattern: str = "*", unreadable: str = "drop") -> DataFrame:
    """(path, length, width, height, content) of picture files; unreadable ones are dropped, or kept with a null size and content (``blank``)."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(content: pd.Series) -> pd.DataFrame:
        found = [picture_size(c) for c in content]
        return pd.DataFrame({"width": [f and f[0] for f in found], "height": [f and f[1] for f in found]}, dtype="Int32")

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("s", size("content"))
    ok = F.col("s.width") > 0
    if unreadable == "drop":
        files = files.where(ok)
    return files.select("path", "length", "s.width", "s.height", F.when(ok, F.col("content")).alias("content"))


def sample_stride(df: DataFrame, number: str, source_fps: float, target_fps: float) -> DataFrame:
    """Every n-th frame of a stream with its time: the stride is the rounded ratio of the rates, 1 at least."""
    stride = max(1, round(source_fps / target_fps))
    return df.where(F.col(number) % stride == 0).withColumn("timestamp_sec", F.round(F.col(number) / source_fps, 3))


def write_atomic(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside the target and swap; whatever fails, the old table or the new one stands at the path when this returns or raises.

    A file system that renames folders one by one has a moment without the table between the two renames. If the second one fails, the old
    table is put back; nothing is deleted before the new one stands.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.format(kind).save(str(new.toString()))
        moved = fs.exists(target)
        if moved and not fs.rename(target, old):
            raise OSError(f"{path}: the old table can't be moved away; it is unchanged")
        if not _renamed(fs, new, target):
            if moved and not fs.rename(old, target):
                raise OSError(f"{path}: the new table can't be moved in, and the old one stays at {old.toString()}")
            raise OSError(f"{path}: the new table can't be moved in; the old one is unchanged")
    finally:
        fs.delete(new, True)
    if moved:
        fs.delete(old, True)


def _renamed(fs, source, target) -> bool:
    """Whether a rename took place; some file systems raise where others return false."""
    try:
        return bool(fs.rename(source, target))
    except Py4JJavaError:
        return False


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``, rows of ``new`` before rows of ``old`` of the same."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def compute_missing(wanted: DataFrame, cached: DataFrame, key: list[str], compute) -> DataFrame:
    """Cached rows of wanted keys, and ``compute`` of the rows whose keys are not cached yet."""
    todo = wanted.join(cached.select(*key), key, "left_anti")
    return cached.join(wanted.select(*key), key, "left_semi").unionByName(compute(todo))


def keep_labels(fresh: DataFrame, labelled: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A rebuilt sheet that keeps what people filled in: labelled columns win over fresh ones, new rows stay blank."""
    kept = labelled.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    rest = [c for c in fresh.columns if c not in columns]
    return fresh.join(kept, key, "left").select(*rest, *[F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) for c in columns])


def local_path(spark: SparkSession, name: str) -> str:
    """A new folder name within the shared folder of the session."""
    return os.path.join(shared_folder(spark), "framewright", f"{name}-{uuid.uuid4().hex[:8]}")
