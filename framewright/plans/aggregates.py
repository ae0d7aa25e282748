"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators.scenes import frequent_distinct
from framewright.operators.tables import one_row
from framewright.operators.vectors import mean_vector
from framewright.plans.base import DETECTIONS, FRAMES, IDENTITIES, TRACKS, Registry, detections, frames, identities, tracks, with_sql
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

#: Detections that count as good enough for the people in them, and frames that make an identity a featured one.
SURE_SCORE, FEATURED_FRAMES = 0.55, 5

_KNOWN = "kd as (select d.*, t.face_id from det d join trk t using (track_id) where t.face_id <> 'unknown')"
_STATS = """tr as (select face_id, count(*) appearances, round(sum(duration_sec), 1) screen_time from trk where face_id <> 'unknown' group by 1),
dt as (select face_id, count(*) frame_count, min(timestamp_sec) first_sec, max(timestamp_sec) last_sec, count_if(quality_ok = 1) n_hq, count_if(det_score >= 0.55) n_sure,
  count_if(quality_ok = 1 and gender = 'F') hf, count_if(quality_ok = 1 and gender = 'M') hm, count_if(det_score >= 0.55 and gender = 'F') sf, count_if(det_score >= 0.55 and gender = 'M') sm,
  median(age) filter (where quality_ok = 1) ha, median(age) filter (where det_score >= 0.55) sa from kd group by 1),
stats as (select face_id, appearances, frame_count, screen_time, first_sec, last_sec,
  case when n_hq > 0 then case when hf >= hm then 'F' else 'M' end when n_sure > 0 then case when sf >= sm then 'F' else 'M' end else '?' end gender,
  cast(trunc(case when n_hq > 0 then ha when n_sure > 0 then sa else 0 end) as int) age from tr join dt using (face_id))"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Per known identity: tracks, detections, screen time, first and last sight, sex and age by its best detections."""
    t = tracks(spark, d).where("face_id <> 'unknown'")
    tr = t.groupBy("face_id").agg(F.count("*").alias("appearances"), F.round(F.sum("duration_sec"), 1).alias("screen_time"))
    det = detections(spark, d).join(t.select("track_id", "face_id"), "track_id")
    hq, sure = F.col("quality_ok") == 1, F.col("det_score") >= SURE_SCORE
    n = lambda ok, sex: F.count_if(ok & (F.col("gender") == sex))
    dt = det.groupBy("face_id").agg(
        F.count("*").alias("frame_count"), F.min("timestamp_sec").alias("first_sec"), F.max("timestamp_sec").alias("last_sec"), F.count_if(hq).alias("n_hq"), F.count_if(sure).alias("n_sure"),
        n(hq, "F").alias("hf"), n(hq, "M").alias("hm"), n(sure, "F").alias("sf"), n(sure, "M").alias("sm"), F.median(F.when(hq, F.col("age"))).alias("ha"), F.median(F.when(sure, F.col("age"))).alias("sa"),
    )
    sex = F.expr("case when n_hq > 0 then if(hf >= hm, 'F', 'M') when n_sure > 0 then if(sf >= sm, 'F', 'M') else '?' end")
    age = F.expr("cast(case when n_hq > 0 then ha when n_sure > 0 then sa else 0 end as int)")
    return tr.join(dt, "face_id").select("face_id", "appearances", "frame_count", "screen_time", "first_sec", "last_sec", sex.alias("gender"), age.alias("age"))


@register(with_sql(DETECTIONS, TRACKS, _KNOWN, _STATS) + "select * from stats")
def occurrence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Occurrence statistics of every identity (mode and median of the subset that is good enough included)."""
    return stats(spark, d)


@register(with_sql(DETECTIONS, TRACKS, _KNOWN, _STATS) + "select count(*) as n_identities, count_if(frame_count >= 900) as featured, cast(sum(appearances) as bigint) as n_tracks, (select count(distinct track_id) from det) as seen_tracks, round(sum(screen_time), 1) as screen_time from stats")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a run; identities of many detections count as featured."""
    s = stats(spark, d).agg(F.count("*").alias("n_identities"), F.count_if(F.col("frame_count") >= 900).alias("featured"), F.sum("appearances").alias("n_tracks"), F.round(F.sum("screen_time"), 1).alias("screen_time"))
    seen = detections(spark, d).agg(F.countDistinct("track_id").alias("seen_tracks"))
    return one_row(s, seen)


@register(with_sql(DETECTIONS, TRACKS) + "select frame_id, list_sort(list(distinct face_id)) as face_ids from det join trk using (track_id) where face_id <> 'unknown' group by 1")
def faces_of_frame(spark: SparkSession, d: str) -> DataFrame:
    """The distinct known identities of each frame in order."""
    j = detections(spark, d).select("frame_id", "track_id").join(tracks(spark, d).where("face_id <> 'unknown'").select("track_id", "face_id"), "track_id")
    return j.groupBy("frame_id").agg(F.array_sort(F.collect_set("face_id")).alias("face_ids"))


_COMMON = "c as (select video_id, scene_index, trim(caption, e' \\t\\n\\r') t, count(*) n, min(frame_id) f from frames where scene_index is not null and trim(coalesce(caption, ''), e' \\t\\n\\r') <> '' group by 1, 2, 3)"


@register(with_sql(FRAMES, _COMMON) + "select video_id, scene_index, list(t order by n desc, f)[1:5] as texts from c group by 1, 2")
def frequent_captions(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent captions of each scene."""
    return frequent_distinct(frames(spark, d, "video_id", "scene_index", "caption").where("scene_index is not null"), ["video_id", "scene_index"], "caption", "frame_id", 5)


@register(with_sql(DETECTIONS) + "select track_id, count(*) as n_faces, min(frame_id) as first_frame, max(frame_id) as last_frame, max(timestamp_sec) - min(timestamp_sec) + 1.0 as duration_sec from det group by 1")
def track_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per track: detections, first and last frame, and the duration with one sampling interval added."""
    return detections(spark, d).groupBy("track_id").agg(F.count("*").alias("n_faces"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), (F.max("timestamp_sec") - F.min("timestamp_sec") + 1.0).alias("duration_sec"))


@register(with_sql(DETECTIONS, TRACKS) + "select face_id, count(*) as n from det join trk using (track_id) group by 1 having count(*) >= 2 or count_if(quality_ok = 1) >= 1 or count_if(det_score >= 0.55) >= 1")
def corroborated_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that two detections or one good one vouch for."""
    j = detections(spark, d).join(tracks(spark, d).select("track_id", "face_id"), "track_id")
    g = j.groupBy("face_id").agg(F.count("*").alias("n"), F.count_if(F.col("quality_ok") == 1).alias("hq"), F.count_if(F.col("det_score") >= SURE_SCORE).alias("sure"))
    return g.where("n >= 2 or hq >= 1 or sure >= 1").select("face_id", "n")


def robust_template(df: DataFrame, by: str, key: str, vector: str, weight: str, min_cosine: float = 0.40, min_rows: int = 3) -> DataFrame:
    """(by, mean): weighted mean per group; groups of ``min_rows`` drop members far from it, if two or more stay, and are averaged again."""
    first = mean_vector(df, by, vector, weight)
    near = df.join(first, by).withColumn("__near", N.dot(vector, "mean") >= min_cosine)
    counts = near.groupBy(by).agg(F.count("*").alias("__n"), F.count_if("__near").alias("__kept"))
    kept = near.join(counts, by).where(F.col("__near") | (F.col("__n") < min_rows) | (F.col("__kept") < 2))
    return mean_vector(kept.select(by, key, vector, weight), by, vector, weight)


_MEAN = "m as (select label, i, sum(w * e[i]) / sum(w) m from (select label, embedding e, 1.0 + vec_id % 5 w, unnest(range(1, 65)) i from embeddings) group by 1, 2), u as (select label, list(m order by i) m from m group by 1), v as (select label, list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-12)) m from u)"


@register(with_sql(_MEAN, """k as (select e.label, e.embedding, 1.0 + e.vec_id % 5 w, list_dot_product(cast(e.embedding as double[]), v.m) >= 0.15 near, count(*) over (partition by e.label) n, count_if(list_dot_product(cast(e.embedding as double[]), v.m) >= 0.15) over (partition by e.label) kept from embeddings e join v using (label)),
m2 as (select label, i, sum(w * embedding[i]) / sum(w) m from (select *, unnest(range(1, 65)) i from k where near or n < 3 or kept < 2) group by 1, 2), u2 as (select label, list(m order by i) m from m2 group by 1)""")
    + "select label, list_transform(m, lambda x: round(x / (sqrt(list_dot_product(m, m)) + 1e-12), 5)) as template from u2")
def track_templates(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed weighted mean vector of every label."""
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding", (1.0 + F.col("vec_id") % 5).alias("w"))
    return robust_template(e, "label", "vec_id", "embedding", "w", min_cosine=0.15).select("label", F.transform("mean", lambda x: F.round(x, 5)).alias("template"))


@register(with_sql(DETECTIONS) + "select crop_id, track_id from (select *, max(quality_ok) over (partition by track_id) best from det) where quality_ok = best")
def prefer_quality(spark: SparkSession, d: str) -> DataFrame:
    """The good detections of each track, or all where none is good."""
    det = detections(spark, d)
    best = det.groupBy("track_id").agg(F.max("quality_ok").alias("quality_ok"))
    return det.join(best, ["track_id", "quality_ok"]).select("crop_id", "track_id")


@register(with_sql(_MEAN.replace("1.0 + vec_id % 5", "1.0")) + "select label, list_transform(m, lambda x: round(x, 5)) as mean from v")
def mean_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Plain mean vector of every label, scaled to length one."""
    return mean_vector(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("mean", lambda x: F.round(x, 5)).alias("mean"))


@register(with_sql(_MEAN.replace("1.0 + vec_id % 5", "1.0")) + "select label, arg_max(vec_id, (s, -vec_id)) as medoid from (select e.label, vec_id, round(list_dot_product(cast(embedding as double[]), v.m), 6) s from embeddings e join v using (label)) group by 1")
def medoids(spark: SparkSession, d: str) -> DataFrame:
    """The vector nearest to each label's mean, the first of equals."""
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    s = e.join(mean_vector(e, "label", "embedding"), "label").withColumn("s", F.round(N.dot("embedding", "mean"), 6))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("medoid"))


@register(with_sql(DETECTIONS) + "select count(*) as n, round(min(det_score), 4) as lo, round(median(det_score), 4) as mid, round(max(det_score), 4) as hi, round(100 * avg(cast(det_score < 0.6 as int)), 1) as pct_low, round(100 * avg(quality_ok), 1) as pct_ok, count_if(least(x2 - x1, y2 - y1) < 60) as small from det")
def detection_audit(spark: SparkSession, d: str) -> DataFrame:
    """Quality of all detections in one row."""
    return detections(spark, d).agg(
        F.count("*").alias("n"), F.round(F.min("det_score"), 4).alias("lo"), F.round(F.median("det_score"), 4).alias("mid"), F.round(F.max("det_score"), 4).alias("hi"),
        F.round(100 * F.avg(F.expr("cast(det_score < 0.6 as int)")), 1).alias("pct_low"), F.round(100 * F.avg("quality_ok"), 1).alias("pct_ok"), F.count_if(F.expr("least(x2 - x1, y2 - y1) < 60")).alias("small"),
    )


@register(with_sql(DETECTIONS) + "select frame_id, count(*) as n from det group by 1 order by n desc, frame_id limit 8")
def busiest_frames(spark: SparkSession, d: str) -> DataFrame:
    """The eight frames with the most detections."""
    return detections(spark, d).groupBy("frame_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "frame_id").limit(8)


_JAC = "len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b)))"


@register(with_sql(FRAMES, "t as (select frame_id, list_distinct(regexp_extract_all(lower(coalesce(ocr_text, '')), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(coalesce(case when frame_id % 4 = 0 then ocr_text else caption end, '')), '[a-z0-9]+')) b from frames)")
    + f"""select tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1, round(fidelity, 6) as fidelity from (
  select count_if(len(a) > 0 and len(b) > 0) tp, count_if(len(a) > 0 and len(b) = 0) fp, count_if(len(a) = 0 and len(b) > 0) fn, count_if(len(a) = 0 and len(b) = 0) tn, avg({_JAC}) filter (where len(a) > 0 and len(b) > 0) fidelity from t)""")
def text_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Found text against labelled text: presence, precision, recall, F1 and the mean share of common words."""
    f = frames(spark, d, "ocr_text", "caption").select(X.tokens("ocr_text").alias("a"), X.tokens(F.when(F.col("frame_id") % 4 == 0, F.col("ocr_text")).otherwise(F.col("caption"))).alias("b"))
    a, b = F.size("a") > 0, F.size("b") > 0
    c = f.agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn"), F.avg(F.when(a & b, X.jaccard("a", "b", 1.0))).alias("fidelity"))
    r = lambda x, y: F.round(N.ratio(F.expr(x), F.expr(y)), 6)
    return c.select("tp", "fp", "fn", "tn", r("tp", "tp + fp").alias("precision"), r("tp", "tp + fn").alias("recall"), r("2 * tp", "2 * tp + fp + fn").alias("f1"), F.round("fidelity", 6).alias("fidelity"))


@register("select event_type, round(avg(1 + event_id % 5), 6) as mean, round(avg(cast(1 + event_id % 5 >= 4 as int)), 6) as share_good from events group by 1")
def likert(spark: SparkSession, d: str) -> DataFrame:
    """Mean of marks from 1 to 5 and the share of 4 and 5."""
    return table(spark, d, "events").withColumn("m", 1 + F.col("event_id") % 5).groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg(F.expr("cast(m >= 4 as int)")), 6).alias("share_good"))


_TIMES = "st as (select event_type stage, round(sum(value), 3) as seconds, event_type in ('error', 'purchase') network from events group by 1)"


@register(with_sql(_TIMES) + "select round(sum(seconds) filter (where not network), 3) as local_sec, round(sum(seconds) filter (where network), 3) as network_sec, round(sum(seconds) filter (where network) / sum(seconds), 6) as network_share, arg_max(stage, seconds) filter (where not network) as slowest from st")
def timing_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Local and network time of the stages, its share and the slowest local stage."""
    st = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 3).alias("seconds")).withColumn("network", F.col("stage").isin("error", "purchase"))
    net, own = F.when(F.col("network"), F.col("seconds")), F.when(~F.col("network"), F.col("seconds"))
    return st.agg(F.round(F.sum(own), 3).alias("local_sec"), F.round(F.sum(net), 3).alias("network_sec"), F.round(F.sum(net) / F.sum("seconds"), 6).alias("network_share"), F.max_by(F.when(~F.col("network"), F.col("stage")), own).alias("slowest"))


@register(with_sql(FRAMES) + "select count(*) as n_frames, count_if(len(face_ids) > 0) as with_faces, count_if(coalesce(ocr_text, '') <> '') as with_text, count_if(caption_echoes) as echoing, count_if(scene_index is not null) as in_scene, count_if(event_description is not null) as with_event from (select f.*, m.e caption_echoes from frames f join (select frame_id, bool_or(caption_echoes_text) e from frame_metadata group by 1) m using (frame_id))")
def coverage_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many frames have faces, text, an echoing caption, a scene and an event."""
    f = frames(spark, d, "face_ids", "ocr_text", "caption_echoes_text", "scene_index", "event_description")
    return f.agg(F.count("*").alias("n_frames"), F.count_if(F.size("face_ids") > 0).alias("with_faces"), F.count_if(F.coalesce("ocr_text", F.lit("")) != "").alias("with_text"), F.count_if("caption_echoes_text").alias("echoing"), F.count_if(F.col("scene_index").isNotNull()).alias("in_scene"), F.count_if(F.col("event_description").isNotNull()).alias("with_event"))
