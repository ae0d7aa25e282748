"""Problem 3: stretches of frames that show the same text and caption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.segments import collapse_runs
from framewright.sources.tables import table


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event of ``frame_metadata`` with its frame count and duration, single frames included."""
    return collapse_runs(table(spark, d, "frame_metadata"), "video_id", "frame_id", "timestamp_sec", "ocr_text", "caption").withColumnRenamed("entity", "video_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last frame of each run of two or more frames."""
    return p3_events(spark, d).where("n_events > 1").selectExpr("video_id", "first_key as first_frame_id", "last_key as last_frame_id")


QUERIES = {"p3_found": p3_found, "p3_events": p3_events}

_RUNS = """
with f as (select distinct video_id, frame_id, timestamp_sec t,
    regexp_replace(lower(coalesce(ocr_text, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') a, array_to_string(regexp_extract_all(coalesce(ocr_text, ''), '\\p{Nd}+'), ' ') na,
    regexp_replace(lower(coalesce(caption, '')), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') b, array_to_string(regexp_extract_all(coalesce(caption, ''), '\\p{Nd}+'), ' ') nb
  from frame_metadata where video_id is not null and frame_id is not null and timestamp_sec is not null),
l as (select *, lag(t) over w pt, lag(a) over w pa, lag(na) over w pna, lag(b) over w pb, lag(nb) over w pnb from f window w as (partition by video_id order by t, frame_id)),
c as (select *, case when pt is null or t - pt > 10 or a || b = '' or pa || pb = '' or na <> pna or nb <> pnb or (a = '') <> (pa = '') or (b = '') <> (pb = '')
    or levenshtein(a, pa) * 4 > greatest(length(a), length(pa)) or levenshtein(b, pb) * 4 > greatest(length(b), length(pb)) then 1 else 0 end cut from l),
r as (select *, sum(cut) over (partition by video_id order by t, frame_id) run from c),
g as (select video_id, arg_min(frame_id, (t, frame_id)) first_key, arg_max(frame_id, (t, frame_id)) last_key, count(*) n_events, min(t) from_sec, max(t) to_sec, max(t) - min(t) duration_sec
  from r where a || b <> '' group by video_id, run)
"""
SQL = {
    "p3_found": _RUNS + "select video_id, first_key as first_frame_id, last_key as last_frame_id from g where n_events > 1",
    "p3_events": _RUNS + "select * from g",
}
