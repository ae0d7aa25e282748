"""Streaming operators, driven to their end over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.base import Registry
from framewright.sources.artifacts import local_path
from framewright.streaming import events as E
from framewright.streaming.tracker import track_boxes, track_stream

register = Registry()
QUERIES, SQL = register.queries, register.sql


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(out: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    path = local_path(spark, "stream")
    if mode == "complete":
        # The whole result of each batch replaces the table; it never stands in the driver.
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/d")
        out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{path}/d")
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/d").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/d")


@register("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type: changed windows are merged into the result, and the watermark ends those that are past."""
    path = local_path(spark, "windows")
    g = E.windowed_counts(_stream(spark, d), "event_type", "ts", "value", "1 hour", "2 days")
    E.upsert_into(g, f"{path}/t", ["start", "event_type"], "n", f"{path}/c", mode="update").awaitTermination()
    return E.read_upserted(spark, f"{path}/t").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("select distinct event_id, user_id from events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each event once."""
    return _finish(E.deduplicated(_stream(spark, d), ["event_id"], "ts").select("event_id", "user_id"), spark, "append")


@register("with e as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute then 1 else 0 end b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts) s from e) select user_id, min(ts) as start, count(*) as n from s group by user_id, s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with a gap of 30 minutes, in one batch over the whole stream."""
    w = _stream(spark, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return _finish(w, spark, "complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register("select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, merged batch by batch."""
    path = local_path(spark, "upsert")
    E.upsert_into(_stream(spark, d).select("user_id", "ts", "event_id"), f"{path}/t", ["user_id"], "ts", f"{path}/c").awaitTermination()
    return E.read_upserted(spark, f"{path}/t").select("user_id", "event_id")


_BOX = ("x1", "y1", "x2", "y2")


def _boxes(li: DataFrame) -> DataFrame:
    """Boxes that drift to the right: a part is a person, five hundred orders a video."""
    person, frame = F.col("l_partkey") % 13, F.col("l_orderkey")
    x = person * 90 + frame % 500 * 2 + F.col("l_linenumber")
    crop = F.format_string("f%06d_%02d", "l_orderkey", "l_linenumber").alias("crop_id")
    return li.select(crop, F.floor(frame / 500).alias("video"), frame.alias("frame_id"), x.alias("x1"), (person * 40).alias("y1"), (x + 80).alias("x2"), (person * 40 + 70).alias("y2"), (F.lit(0.4) + F.col("l_discount") * 5).alias("score"))


@register()
def tracked_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of boxes by overlap from frame to frame; boxes without one yet have null."""
    return track_boxes(_boxes(spark.read.parquet(f"{d}/lineitem.parquet")), "video", "frame_id", "crop_id", _BOX, "score")


@register()
def stream_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream, with the tracker of each video as state."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    li = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    return _finish(track_stream(_boxes(li), "video", "frame_id", "crop_id", _BOX, "score"), spark, "append")
