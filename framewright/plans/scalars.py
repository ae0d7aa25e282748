"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.plans.base import DETECTIONS, FRAMES, Registry, detections, frames, with_sql
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql


@register(with_sql(DETECTIONS) + "select crop_id, x1, round(greatest(0.0, least(x2, x2 + 5) - greatest(x1, x1 + 5)) * greatest(0.0, least(y2, y2 + 9) - greatest(y1, y1 + 9)) / (2.0 * (x2 - x1) * (y2 - y1) - greatest(0.0, least(x2, x2 + 5) - greatest(x1, x1 + 5)) * greatest(0.0, least(y2, y2 + 9) - greatest(y1, y1 + 9)) + 1e-9), 6) as iou from det")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each box with itself moved by a few pixels."""
    x = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    return detections(spark, d).select("crop_id", "x1", F.round(N.iou(("x1", "y1", "x2", "y2"), (x["x1"] + 5, x["y1"] + 9, x["x2"] + 5, x["y2"] + 9)), 6).alias("iou"))


@register(with_sql(DETECTIONS) + "select crop_id, x1, round(abs((x1 + 13 - (x1 + 5 + x2 - 5) / 2.0) / (abs(x2 - 5 - (x1 + 5)) + 1e-6)), 6) as turn, cast(greatest(0, x1 - (x2 - x1)) as int) as bx1, cast(least(480, y2) as int) as by1, cast(least(640, x2 + (x2 - x1)) as int) as bx2, cast(least(480, y2 + 3 * (y2 - y1)) as int) as by2 from det")
def face_geometry(spark: SparkSession, d: str) -> DataFrame:
    """How far a face is turned, and the box of the body below it."""
    box = N.body_box("x1", "y1", "x2", "y2", F.lit(640), F.lit(480))
    out = detections(spark, d).select("crop_id", "x1", F.round(N.nose_offset(F.expr("x1 + 13"), F.expr("x1 + 5"), F.expr("x2 - 5")), 6).alias("turn"), box.alias("b"))
    return out.select("crop_id", "x1", "turn", F.col("b.x1").alias("bx1"), F.col("b.y1").alias("by1"), F.col("b.x2").alias("bx2"), F.col("b.y2").alias("by2"))


@register("select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 5) as length, round(list_max(embedding), 5) as largest, round(1 - list_dot_product(cast(embedding as double[]), cast(list_reverse(embedding) as double[])), 5) as distance from embeddings")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    """Length, largest component and cosine distance to the reversed vector."""
    return table(spark, d, "embeddings").select("vec_id", F.round(N.norm("embedding"), 5).alias("length"), F.round(F.array_max("embedding").cast("double"), 5).alias("largest"), F.round(1 - N.dot(F.col("embedding"), F.reverse("embedding")), 5).alias("distance"))


@register("select doc_id, sha256(coalesce(text, '')) as sha, left(md5(coalesce(text, '')), 12) as fingerprint, left(sha256(coalesce(text, '')), 16) || '@80' as picture from documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digests by which replies, settings and pictures are known."""
    t = X.filled("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.substring(F.md5(t), 1, 12).alias("fingerprint"), F.concat(F.substring(F.sha2(t, 256), 1, 16), F.lit("@80")).alias("picture"))


@register(with_sql(FRAMES) + r"select frame_id, concat_ws('. ', nullif(regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(coalesce(ocr_text, ''), '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(coalesce(speech, ''), '^\s+|\s+$', '', 'g'), '')) as document from frames")
def frame_documents(spark: SparkSession, d: str) -> DataFrame:
    """Caption, text and speech of a frame as one document."""
    return frames(spark, d, "caption", "ocr_text", "speech").select("frame_id", X.joined_document("caption", "ocr_text", "speech").alias("document"))


@register("select doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) as n_tokens, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+')) as n_words, len(string_split_regex(coalesce(text, ''), '[.!?]\\s+')) as n_sentences from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens, words and sentences of each document."""
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens("text")).alias("n_tokens"), F.size(X.word_list("text")).alias("n_words"), F.size(X.split_sentences("text")).alias("n_sentences"))


@register(with_sql(FRAMES) + "select frame_id, list_sort(list_distinct(face_ids)) as faces, len(face_ids) as n, array_to_string(face_ids, '|') as joined, array_to_string(face_ids[1:2], '|') as first_two from frames where face_ids is not null")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """Arrays sorted, counted, cut and joined."""
    return frames(spark, d, "face_ids").where("face_ids is not null").select("frame_id", F.array_sort(F.array_distinct("face_ids")).alias("faces"), F.size("face_ids").alias("n"), F.array_join("face_ids", "|").alias("joined"), F.array_join(F.slice("face_ids", 1, 2), "|").alias("first_two"))


@register("select distinct request_id, coalesce(params.max_tokens, 512) as max_tokens, coalesce(params.temperature, 0.2) as temperature, coalesce(len(images), 0) as n_images from llm_cache")
def parameter_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a struct with defaults."""
    return table(spark, d, "llm_cache").selectExpr("request_id", "coalesce(params.max_tokens, 512) as max_tokens", "coalesce(params.temperature, 0.2D) as temperature", "coalesce(array_size(images), 0) as n_images").distinct()


@register("select event_id, cast(json_extract(props, '$.k') as int) as k, date_trunc('second', ts) as at, round(value, 1) as value from events")
def json_and_time(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON, a time cut to seconds, a rounded value."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"), F.round("value", 1).alias("value"))


_TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace({c}, '[ \t]+(\r?\n)', '\1', 'g'), '[ \t]+$', ''), '(\r?\n){{3,}}', chr(10) || chr(10), 'g'), e' \t\n\r\x0b\x0c')"""


@register("select doc_id, " + _TIDY.format(c="coalesce(text, '')") + r" as text, regexp_replace(trim(coalesce(text, ''), e' \t\n\r\x0b\x0c'), '(?i)^(?:subject:|re:|review note,)\s*', '') as body from documents")
def tidy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without runs of blank lines, and without the words that open a note."""
    return table(spark, d, "documents").select("doc_id", X.without_blank_lines("text").alias("text"), X.without_prefix("text", "Subject:", "Re:", "Review note,").alias("body"))


@register(r"""with r as (select request_id, min(response) r from llm_cache where contains(response, '[') and request_id is not null group by 1),
j as (select request_id, case when json_valid(regexp_extract(r, '\[.*\]', 0, 's')) then from_json(regexp_extract(r, '\[.*\]', 0, 's'), '["json"]') end a from r)
select request_id, len(a) as n_items, list_transform(a, lambda x: x ->> '$.description') as descriptions from j where a is not null""")
def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON array of each reply, fenced or within prose: its size and the descriptions of its items."""
    r = table(spark, d, "llm_cache").where("contains(response, '[') and request_id is not null").groupBy("request_id").agg(F.min("response").alias("response"))
    a = r.select("request_id", F.from_json(X.json_array_python("response"), "array<string>").alias("a")).where("a is not null")
    return a.select("request_id", F.size("a").alias("n_items"), F.transform("a", lambda x: F.get_json_object(x, "$.description")).alias("descriptions"))


@register("select 'x' || count(*) % 2 as k, printf('%.1f%%', 100.0 * count_if(value > 40) / count(*)) as share from events")
def formatted_share(spark: SparkSession, d: str) -> DataFrame:
    """A share as text with one decimal."""
    return table(spark, d, "events").agg(F.concat(F.lit("x"), (F.count("*") % 2).cast("string")).alias("k"), F.format_string("%.1f%%", F.lit(100.0) * F.count_if(F.col("value") > 40) / F.count("*")).alias("share"))
