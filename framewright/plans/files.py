"""Round trips through sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.base import FRAMES, Registry, frames, with_sql
from framewright.sources import artifacts as A
from framewright.sources.tables import require_columns, table

register = Registry()
QUERIES, SQL = register.queries, register.sql


@register("select o_orderkey as id, coalesce(o_orderstatus, '') as status, cast(o_custkey as varchar) as customer from orders")
def csv_strings(spark: SparkSession, d: str) -> DataFrame:
    """A CSV written and read with every column as text."""
    path = A.local_path(spark, "csv")
    table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as status", "o_custkey as customer").write.option("header", True).csv(path)
    return A.read_csv_strings(spark, path, ["id", "status", "customer"]).withColumn("id", F.col("id").cast("long"))


@register("select o_orderkey as id, o_totalprice as total from orders")
def csv_typed(spark: SparkSession, d: str) -> DataFrame:
    """A CSV read with a declared schema."""
    path = A.local_path(spark, "csv")
    table(spark, d, "orders").selectExpr("o_orderkey as id", "o_totalprice as total").write.option("header", True).csv(path)
    return A.read_csv(spark, path, "id long, total double")


@register(with_sql(FRAMES) + "select frame_id, timestamp_sec, face_ids from frames where face_ids is not null")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON records written and read with nested arrays, required columns checked."""
    path = A.local_path(spark, "json")
    frames(spark, d, "timestamp_sec", "face_ids").where("face_ids is not null").write.json(path)
    schema = "frame_id long, timestamp_sec double, face_ids array<string>"
    return require_columns(spark.read.schema(schema).json(path), ["frame_id", "timestamp_sec", "face_ids"], "frames")


@register("select cast(0 as bigint) as n")
def optional_artifact(spark: SparkSession, d: str) -> DataFrame:
    """A table that is not there reads as an empty one."""
    return A.read_optional(spark, f"{d}/no_such_table.parquet", "a int, b string").agg(F.count("*").alias("n"))


@register("select vec_id, len(embedding) as dim from embeddings")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """A vector table by key."""
    return A.read_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding").select("vec_id", F.size("embedding").alias("dim"))


@register("select event_id, round(event_id / 29.97, 3) as timestamp_sec from events where event_id % 15 = 0")
def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every n-th frame of a stream with its time."""
    return A.sample_stride(table(spark, d, "events").select("event_id"), "event_id", 29.97, 2.0)


@register("select distinct frame_ids as frame_id, model from image_index where frame_ids is not null and model is not null")
def atomic_write(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced by a swap and read again."""
    path = A.local_path(spark, "swap")
    rows = table(spark, d, "image_index").where("frame_ids is not null and model is not null").select(F.col("frame_ids").alias("frame_id"), "model").distinct()
    A.write_atomic(rows.limit(1), path)
    A.write_atomic(rows, path)
    return spark.read.parquet(path)


@register("with u as (select user_id, ts, value, event_id, row_number() over (partition by user_id order by ts desc, (event_id % 3 = 0)::int desc) r from events) select user_id, event_id, value from u where r = 1")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last write per key of an old and a new part."""
    e = table(spark, d, "events").select("user_id", "ts", "value", "event_id")
    return A.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id"], "ts").select("user_id", "event_id", "value")


@register(with_sql(FRAMES) + "select frame_id, case when frame_id % 3 = 0 then 'kept' else upper(coalesce(filename, '')) end as name from frames")
def resume_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an earlier run are kept, only the missing ones are computed."""
    f = frames(spark, d, "filename")
    cached = f.where("frame_id % 3 = 0").select("frame_id", F.lit("kept").alias("name"))
    return A.compute_missing(f, cached, ["frame_id"], lambda todo: todo.select("frame_id", F.upper(F.coalesce("filename", F.lit(""))).alias("name")))


@register("with r as (select distinct face_a, face_b from merge_candidates where face_a is not null and face_b is not null), l as (select face_a, face_b, max(verdict) v from merge_candidates where verdict <> '' group by 1, 2) select face_a, face_b, coalesce(v, '?') as verdict from r left join l using (face_a, face_b)")
def label_preserving_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A rebuilt review sheet keeps the verdicts given before."""
    m = table(spark, d, "merge_candidates").where("face_a is not null and face_b is not null")
    fresh = m.select("face_a", "face_b").distinct().withColumn("verdict", F.lit("?"))
    given = m.where("verdict <> ''").groupBy("face_a", "face_b").agg(F.max("verdict").alias("verdict"))
    return A.keep_labels(fresh, given, ["face_a", "face_b"], ["verdict"])


@register(with_sql(FRAMES) + "select frame_id, array_to_string(face_ids, '|') as face_ids from frames where face_ids is not null")
def delimited_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays as delimited text for flat files."""
    return frames(spark, d, "face_ids").where("face_ids is not null").select("frame_id", F.array_join("face_ids", "|").alias("face_ids"))
