"""Operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators.sequences import islands, scene_cuts, with_previous
from framewright.operators.tables import numbered
from framewright.plans.base import DETECTIONS, FRAMES, Registry, detections, frames, with_sql
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_VIDEO = ["video_id"]
_TIME = ["timestamp_sec", "frame_id"]


@register("select vec_id, round(list_dot_product(cast(embedding as double[]), cast(lag(embedding) over (partition by label order by vec_id) as double[])), 5) as sim from embeddings")
def lag_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to the one before it."""
    e = with_previous(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), ["label"], ["vec_id"], ["embedding"], 1000)
    return e.select("vec_id", F.round(N.dot("embedding", "prev.embedding"), 5).alias("sim"))


_CUTS = """l as (select vec_id, vec_id % 97 < 5 card, label, vec_id * 1.5 t, label % 3 video, embedding e from embeddings),
c as (select *, round(list_dot_product(cast(e as double[]), cast(lag(e) over w as double[])), 12) sim, lag(card) over w was, row_number() over w r from l window w as (partition by video order by vec_id)),
k as (select *, r = 1 or coalesce(sim < 0.05, false) or coalesce(card <> was, false) cut from c),
p as (select *, sum(cast(cut as int)) over (partition by video order by vec_id) part from k),
s as (select video, part, arg_min(t, vec_id) a, arg_max(t, vec_id) z, arg_min(card, vec_id) card, first(was order by vec_id) was from p group by 1, 2),
n as (select *, sum(cast(part = 1 or z - a >= 4.0 or card or coalesce(was, false) as int)) over (partition by video order by part) - 1 scene from s)"""


@register(with_sql(_CUTS) + "select vec_id, scene from p join n using (video, part)")
def scene_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by similarity and cards, short ones joined to the one before."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 97 < 5).alias("card"), (F.col("vec_id") * 1.5).alias("t"), (F.col("label") % 3).alias("video"), "embedding")
    return scene_cuts(e, "video", "vec_id", "t", "embedding", "card", threshold=0.05).select("vec_id", "scene")


@register(with_sql(_CUTS) + "select vec_id, cut from k")
def cut_points(spark: SparkSession, d: str) -> DataFrame:
    """Where scenes would open before short ones are joined."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 97 < 5).alias("card"), F.lit(0.0).alias("t"), (F.col("label") % 3).alias("video"), "embedding")
    out = scene_cuts(e, "video", "vec_id", "t", "embedding", "card", threshold=0.05, min_sec=0.0)
    return with_previous(out, ["video"], ["vec_id"], ["scene"], 1000).select("vec_id", (~F.col("scene").eqNullSafe(F.col("prev.scene"))).alias("cut"))


_SCENES = "sc as (select video_id, scene_index, min(frame_id) f, arg_min(story_segment, frame_id) seg from frames where scene_index is not null group by 1, 2), ca as (select *, scene_index % 4 = 0 card from sc)"


@register(with_sql(FRAMES, _SCENES) + "select video_id, scene_index, greatest(0, cast(sum(cast(card as int)) over w - 1 as int)) as chapter, coalesce(last_value(case when card then seg end ignore nulls) over w, 'Introduction') as label from ca window w as (partition by video_id order by scene_index)")
def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters: each card scene opens one, and its label holds until the next."""
    s = frames(spark, d, "video_id", "scene_index", "story_segment").where("scene_index is not null")
    s = s.groupBy("video_id", "scene_index").agg(F.min_by("story_segment", "frame_id").alias("seg")).withColumn("card", F.col("scene_index") % 4 == 0)
    w = Window.partitionBy("video_id").orderBy("scene_index").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("video_id", "scene_index", F.greatest(F.lit(0), F.sum(F.col("card").cast("int")).over(w) - 1).cast("int").alias("chapter"), F.coalesce(F.last(F.when(F.col("card"), F.col("seg")), ignorenulls=True).over(w), F.lit("Introduction")).alias("label"))


_RUNS = "h as (select * from frames where coalesce(ocr_text, '') <> ''), g as (select *, coalesce(ocr_text <> lag(ocr_text) over w or timestamp_sec - lag(timestamp_sec) over w > 2.5, true) brk from h window w as (partition by video_id order by timestamp_sec, frame_id)), r as (select *, sum(cast(brk as int)) over (partition by video_id order by timestamp_sec, frame_id) run from g)"


@register(with_sql(FRAMES, _RUNS) + "select video_id, min(timestamp_sec) as start_sec, max(timestamp_sec) as end_sec, count(*) as n, arg_min(ocr_text, (timestamp_sec, frame_id)) as snippet, arg_min(filename, (timestamp_sec, frame_id)) as filename from r group by video_id, run")
def group_consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the same text at most 2.5 s apart as one time range."""
    h = frames(spark, d, "video_id", "timestamp_sec", "ocr_text", "filename").where("coalesce(ocr_text, '') <> ''")
    g = islands(h, _VIDEO, _TIME, lambda p: (F.col("ocr_text") != p["ocr_text"]) | (F.col("timestamp_sec") - p["timestamp_sec"] > 2.5), ["ocr_text", "timestamp_sec"])
    first = F.struct("timestamp_sec", "frame_id")
    return g.groupBy("video_id", "island").agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"), F.count("*").alias("n"), F.min_by("ocr_text", first).alias("snippet"), F.min_by("filename", first).alias("filename")).drop("island")


@register(with_sql(DETECTIONS) + "select track_id, arg_min(crop_id, (frame_id, crop_id)) as first_crop, arg_max(crop_id, (frame_id, crop_id)) as last_crop from det group by 1")
def track_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """First and last detection of each track."""
    k = F.struct("frame_id", "crop_id")
    return detections(spark, d).groupBy("track_id").agg(F.min_by("crop_id", k).alias("first_crop"), F.max_by("crop_id", k).alias("last_crop"))


_Q = "round(det_score * blur_var / (1 + nose_offset), 6)"


@register(with_sql(DETECTIONS) + f"select track_id, arg_min(crop_id, (-q, crop_id)) as best_crop from (select *, {_Q} q from det) group by 1")
def best_crop(spark: SparkSession, d: str) -> DataFrame:
    """The best detection of each track, the first of equals."""
    return detections(spark, d).withColumn("q", F.expr(_Q)).groupBy("track_id").agg(F.min_by("crop_id", F.struct(-F.col("q"), "crop_id")).alias("best_crop"))


@register(with_sql(DETECTIONS) + f"select distinct track_id, crop_id, q from (select *, row_number() over (partition by track_id order by q desc, crop_id) r from (select *, {_Q} q from det)) where r <= 3")
def top_crops(spark: SparkSession, d: str) -> DataFrame:
    """The three best detections of each track."""
    w = Window.partitionBy("track_id").orderBy(F.desc("q"), "crop_id")
    return detections(spark, d).withColumn("q", F.expr(_Q)).withColumn("r", F.row_number().over(w)).where("r <= 3").select("track_id", "crop_id", "q").distinct()


@register("select doc_id, coalesce(round(len(list_filter(range(1, len(s)), lambda i: s[i] <= s[i + 1])) / nullif(greatest(0, len(s) - 1), 0), 6), 1.0) as chronology from (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\b(\\d{1,2}:[0-5]\\d)\\b', 1), lambda x: cast(split_part(x, ':', 1) as int) * 60 + cast(split_part(x, ':', 2) as int)) s from documents)")
def chronology(spark: SparkSession, d: str) -> DataFrame:
    """Share of neighbouring cited times in order; 1 with fewer than two."""
    s = table(spark, d, "documents").select("doc_id", X.cited_seconds("text").alias("s"))
    rising = F.expr("size(filter(sequence(1, greatest(1, size(s) - 1)), i -> size(s) > 1 and s[i - 1] <= s[i]))")
    return s.select("doc_id", F.coalesce(F.round(N.ratio(rising, F.expr("greatest(0, size(s) - 1)")), 6), F.lit(1.0)).alias("chronology"))


@register("select doc_id, case when len(w) < 3 then 0 else round(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) / (len(w) - 2), 6) end as distinct_3 from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') w from documents)")
def distinct_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Share of distinct three-word windows."""
    w = table(spark, d, "documents").select("doc_id", X.word_list("text").alias("w"))
    grams = F.expr("transform(sequence(0, size(w) - 3), i -> concat_ws(' ', slice(w, i + 1, 3)))")
    return w.select("doc_id", F.when(F.size("w") < 3, F.lit(0.0)).otherwise(F.round(F.size(F.array_distinct(grams)) / (F.size("w") - 2), 6)).alias("distinct_3"))


@register(with_sql("c as (select label, count(*) n from embeddings where label % 7 <> 0 group by 1)") + "select label, printf('Face_%02d', row_number() over (order by n desc, label)) as face_id from c")
def identity_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Names by size of the identities, the smaller label first of equals."""
    c = table(spark, d, "embeddings").where("label % 7 <> 0").groupBy("label").agg(F.count("*").alias("n"))
    return numbered(c, [F.desc("n"), F.col("label")]).select("label", F.format_string("Face_%02d", "rank").alias("face_id"))


_WORDS = r"""r as (select request_id, min(response) x from llm_cache where request_id is not null and response is not null group by 1),
d as (select request_id, case when request_id % 3 = 0 then x || ' so so So, so so. so' else x end x from r),
w as (select request_id, x, list_filter(string_split_regex(x, '[\s\p{Z}]+'), lambda t: t <> '') w from d),
p as (select *, list_transform(w, lambda t: trim(lower(t), '.,!?')) q from w),
f as (select *, list_filter(range(5, len(w) + 1), lambda i: len(list_distinct(q[i - 4:i])) = 1)[1] i from p),
h as (select *, array_to_string(w[1:i - 5], ' ') head from f)"""


@register(with_sql(_WORDS) + r"select request_id, case when i is null then x when regexp_matches(head, '[.!?]') then regexp_extract(head, '^(.*[.!?])', 1, 's') else head end as response from h")
def collapse_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Replies cut back where they fall into repeating one word; every third is given such an end."""
    r = table(spark, d, "llm_cache").where("request_id is not null and response is not null").groupBy("request_id").agg(F.min("response").alias("response"))
    r = r.withColumn("response", F.when(F.col("request_id") % 3 == 0, F.concat("response", F.lit(" so so So, so so. so"))).otherwise(F.col("response")))
    return r.select("request_id", X.without_repetition_python("response").alias("response"))


@register(with_sql(FRAMES) + "select pos, frame_id, filename from (select row_number() over (order by frame_id) - 1 pos, frame_id, filename from frames where coalesce(ocr_text, '') <> '') where pos between 100 and 119")
def frame_page(spark: SparkSession, d: str) -> DataFrame:
    """Rows 100 to 119 of a filtered view, by an ordered limit instead of numbering all rows."""
    f = frames(spark, d, "ocr_text", "filename").where("coalesce(ocr_text, '') <> ''").select("frame_id", "filename")
    page = f.orderBy("frame_id").limit(120).withColumn("pos", F.row_number().over(Window.orderBy("frame_id")) - 1)
    return page.where("pos >= 100").select("pos", "frame_id", "filename")


@register(with_sql(FRAMES, "m as (select video_id, cast(floor(max(timestamp_sec)) as bigint) d from frames group by 1)") + "select video_id, unnest(range(0, d + 1, greatest(1, d // 6))) as tick from m")
def timeline_ticks(spark: SparkSession, d: str) -> DataFrame:
    """About six ticks along each video."""
    m = frames(spark, d, "video_id", "timestamp_sec").groupBy("video_id").agg(F.floor(F.max("timestamp_sec")).alias("d"))
    return m.select("video_id", F.explode(F.expr("sequence(0L, d, greatest(1L, d div 6))")).alias("tick"))
