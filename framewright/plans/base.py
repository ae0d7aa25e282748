"""Tables as the queries read them, and the same as SQL.

``frames`` is frame_metadata with each frame once. ``detections`` and ``tracks`` stand for the face detections that the tables don't hold:
a line item is a detection in the frame of its order, a part is a track, and its identity is derived from its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.tables import table

FRAME_COLUMNS = ["frame_id", "video_id", "timestamp_sec", "filename", "face_ids", "ocr_text", "caption", "speech", "scene_index", "story_segment", "event_description"]


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each frame of frame_metadata once, with the named columns (all but ingested_at by default)."""
    wanted = list(columns) or FRAME_COLUMNS
    return table(spark, d, "frame_metadata").select("frame_id", *[c for c in wanted if c != "frame_id"]).dropDuplicates(["frame_id"])


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Each track of identities once."""
    return table(spark, d, "identities").drop("ingested_at").dropDuplicates(["track_id"])


def detections(spark: SparkSession, d: str) -> DataFrame:
    """(crop_id, frame_id, timestamp_sec, track_id, x1, y1, x2, y2, det_score, blur_var, nose_offset, gender, age, quality_ok)."""
    li = table(spark, d, "lineitem")
    x1, y1 = F.col("l_partkey") % 600, F.col("l_suppkey") * 7 % 400
    return li.select(
        F.format_string("f%06d_%02d", "l_orderkey", "l_linenumber").alias("crop_id"), F.col("l_orderkey").alias("frame_id"), F.col("l_orderkey").cast("double").alias("timestamp_sec"),
        F.concat(F.lit("t"), F.col("l_partkey")).alias("track_id"), x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity").cast("long")).alias("x2"), (y1 + 20 + F.col("l_linenumber") * 12).alias("y2"),
        F.round(0.4 + F.col("l_discount") * 5, 4).alias("det_score"), F.round(F.col("l_extendedprice") / 1000, 1).alias("blur_var"), F.round(F.col("l_tax") * 12, 3).alias("nose_offset"),
        F.when(F.col("l_returnflag") == "R", "F").otherwise("M").alias("gender"), (18 + F.col("l_suppkey") % 60).cast("int").alias("age"),
    ).withColumn("quality_ok", F.expr("cast(det_score >= 0.60 and blur_var >= 25 and nose_offset <= 0.75 as int)"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """(track_id, face_id, n): every part as a track; each seventh is unknown, and each fifth of the rest is missing."""
    p = table(spark, d, "part").where("p_partkey % 35 <> 5")
    face = F.when(F.col("p_partkey") % 7 == 0, "unknown").otherwise(F.format_string("Face_%03d", F.col("p_partkey") % 97))
    return p.select(F.concat(F.lit("t"), F.col("p_partkey")).alias("track_id"), face.alias("face_id"), (F.col("p_size") / 10.0).alias("duration_sec"))


FRAMES = "frames as (select distinct frame_id, video_id, timestamp_sec, filename, face_ids, ocr_text, caption, speech, scene_index, story_segment, event_description from frame_metadata)"
IDENTITIES = "ids as (select distinct on (track_id) track_id, face_id, video_id, cluster_label, n_faces, first_frame, last_frame, first_sec, last_sec, duration_sec from identities)"
DETECTIONS = """det as (select *, cast(det_score >= 0.60 and blur_var >= 25 and nose_offset <= 0.75 as int) quality_ok from (
  select printf('f%06d_%02d', l_orderkey, l_linenumber) crop_id, l_orderkey frame_id, cast(l_orderkey as double) timestamp_sec, 't' || l_partkey track_id,
    l_partkey % 600 x1, l_suppkey * 7 % 400 y1, l_partkey % 600 + 20 + cast(l_quantity as bigint) x2, l_suppkey * 7 % 400 + 20 + l_linenumber * 12 y2,
    round(0.4 + l_discount * 5, 4) det_score, round(l_extendedprice / 1000, 1) blur_var, round(l_tax * 12, 3) nose_offset,
    case when l_returnflag = 'R' then 'F' else 'M' end gender, cast(18 + l_suppkey % 60 as int) age from lineitem))"""
TRACKS = "trk as (select 't' || p_partkey track_id, case when p_partkey % 7 = 0 then 'unknown' else printf('Face_%03d', p_partkey % 97) end face_id, p_size / 10.0 duration_sec from part where p_partkey % 35 <> 5)"


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


class Registry:
    """Collects the queries of a module and their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
