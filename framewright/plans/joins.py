"""Equi, range, as-of and theta joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.operators.joins import adopt_tracks, as_of, range_join, within
from framewright.operators.search import rank_by_vector
from framewright.operators.tables import numbered
from framewright.operators.vectors import top_neighbors
from framewright.plans.base import DETECTIONS, FRAMES, IDENTITIES, TRACKS, Registry, detections, frames, identities, tracks, with_sql
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

#: Scenes as intervals of frames, from frame_metadata itself.
_SCENES = "scenes as (select video_id, scene_index, min(frame_id) start_frame, max(frame_id) end_frame, min(timestamp_sec) start_sec, max(timestamp_sec) end_sec from frames where scene_index is not null group by 1, 2)"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d, "video_id", "scene_index", "timestamp_sec").where("scene_index is not null")
    return f.groupBy("video_id", "scene_index").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"))


@register(with_sql(DETECTIONS, TRACKS) + "select crop_id, face_id from det left join trk using (track_id)")
def detection_identity(spark: SparkSession, d: str) -> DataFrame:
    """Detections with their track's identity, null where the track is missing."""
    return detections(spark, d).select("crop_id", "track_id").join(tracks(spark, d).select("track_id", "face_id"), "track_id", "left").select("crop_id", "face_id")


@register(with_sql(DETECTIONS) + "select crop_id, o_orderpriority as filename from det left join orders on frame_id = o_orderkey")
def detection_frame(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a field of their frame."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("filename"))
    return detections(spark, d).select("crop_id", "frame_id").join(o, "frame_id", "left").select("crop_id", "filename")


@register(with_sql(FRAMES) + """select f.frame_id, coalesce(o.ocr_text, '') as text, coalesce(c.caption, '') as caption from frames f
left join (select frame_id, ocr_text from frames where ocr_text <> '') o using (frame_id) left join (select frame_id, caption from frames where frame_id % 3 <> 0) c using (frame_id)""")
def frame_spine(spark: SparkSession, d: str) -> DataFrame:
    """All frames with their text and caption where there is one, else the empty text."""
    f = frames(spark, d, "ocr_text", "caption")
    spine, o, c = f.select("frame_id"), f.where("ocr_text <> ''").select("frame_id", "ocr_text"), f.where("frame_id % 3 <> 0").select("frame_id", "caption")
    return spine.join(o, "frame_id", "left").join(c, "frame_id", "left").select("frame_id", F.coalesce("ocr_text", F.lit("")).alias("text"), F.coalesce("caption", F.lit("")).alias("caption"))


@register(with_sql(FRAMES) + "select distinct i.frame_ids as frame_id, coalesce(f.caption, '(none)') as caption from image_index i left join frames f on i.frame_ids = f.frame_id and f.frame_id % 2 = 0 where i.frame_ids is not null")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A lookup with a default for missing keys."""
    f = frames(spark, d, "caption").where("frame_id % 2 = 0")
    i = table(spark, d, "image_index").where("frame_ids is not null").select(F.col("frame_ids").alias("frame_id")).distinct()
    return i.join(f, "frame_id", "left").select("frame_id", F.coalesce("caption", F.lit("(none)")).alias("caption"))


_INDEX = """i as (select frame_ids, max(embeddings) e from image_index where frame_ids is not null and len(embeddings) = 64 and not list_bool_or(list_transform(embeddings, lambda x: isnan(x))) group by 1),
q as (select e from i where e[1] <> 0 order by frame_ids limit 1),
top as (select frame_ids, row_number() over (order by round(list_dot_product(cast(i.e as double[]), cast(q.e as double[])), 5) desc, frame_ids) r from i, q)"""


@register(with_sql(FRAMES, _INDEX) + "select r as rank, frame_ids as frame_id, filename from top join frames on frame_ids = frame_id where r <= 200 and frame_id % 5 <> 0")
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The 200 index rows most similar to the first one, joined with their metadata afterwards; those without metadata drop out of the list."""
    i = table(spark, d, "image_index").where("frame_ids is not null and size(embeddings) = 64 and not exists(embeddings, x -> x is null or isnan(x))")
    i = i.groupBy(F.col("frame_ids").alias("frame_id")).agg(F.max("embeddings").alias("e"))
    first = i.where("e[0] <> 0").orderBy("frame_id").first()
    top = rank_by_vector(i, "frame_id", "e", first[1] if first else [], 200, -2.0, digits=5)
    return top.join(frames(spark, d, "filename").where("frame_id % 5 <> 0"), "frame_id").select("rank", "frame_id", "filename")


@register(with_sql(FRAMES) + "select count(*) as n_index, count(f.frame_id) as n_found, count(*) = count(f.frame_id) as complete from (select distinct frame_ids from image_index where frame_ids is not null) left join frames f on frame_ids = f.frame_id")
def index_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Whether every row of the index has metadata."""
    i = table(spark, d, "image_index").where("frame_ids is not null").select(F.col("frame_ids").alias("frame_id")).distinct()
    j = i.join(frames(spark, d).select("frame_id", F.lit(1).alias("found")), "frame_id", "left")
    return j.agg(F.count("*").alias("n_index"), F.count("found").alias("n_found"), (F.count("*") == F.count("found")).alias("complete"))


@register(with_sql(FRAMES, _SCENES) + "select f.frame_id, max(s.scene_index) as scene from frames f left join scenes s on f.video_id = s.video_id and f.frame_id between s.start_frame and s.end_frame group by 1")
def scene_of_frame(spark: SparkSession, d: str) -> DataFrame:
    """The scene whose closed interval of frames holds a frame, the later one where they overlap."""
    f, s = frames(spark, d, "video_id").select("frame_id", "video_id"), scenes(spark, d)
    hits = range_join(f, s, by="video_id", point="frame_id", start="start_frame", end="end_frame", width=64, closed=True)
    return f.select("frame_id").join(hits.groupBy("frame_id").agg(F.max("scene_index").alias("scene")), "frame_id", "left")


_SEGMENTS = "seg as (select video_id, first_sec a, last_sec b, track_id t from ids where first_sec < last_sec)"


@register(with_sql(FRAMES, IDENTITIES, _SEGMENTS) + "select frame_id, string_agg(t, ' ' order by a, t) as speech from frames f join seg s on f.video_id = s.video_id and timestamp_sec >= a and timestamp_sec < b group by 1")
def segments_of_frame(spark: SparkSession, d: str) -> DataFrame:
    """All half-open segments that hold a frame's time, joined in order of their starts."""
    f = frames(spark, d, "video_id", "timestamp_sec").select("frame_id", "video_id", "timestamp_sec")
    s = identities(spark, d).where("first_sec < last_sec").select("video_id", "first_sec", "last_sec", "track_id")
    hits = range_join(f, s, by="video_id", point="timestamp_sec", start="first_sec", end="last_sec", width=60, closed=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_sec", "track_id"))), lambda x: x["track_id"]), " ")
    return hits.groupBy("frame_id").agg(text.alias("speech"))


_TIMELINE = "tl as (select video_id, timestamp_sec t, frame_id k, event_description descr from frames where event_description is not null and timestamp_sec is not null)"


@register(with_sql(FRAMES, _TIMELINE) + """select frame_id, coalesce(descr, '') as event from (
  select f.frame_id, (select arg_max(descr, (t, k)) from tl where tl.video_id = f.video_id and tl.t <= f.timestamp_sec) descr from frames f where f.timestamp_sec is not null)""")
def event_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The latest event at or before each frame's time; the last one of equal times; empty before the first."""
    f = frames(spark, d, "video_id", "timestamp_sec", "event_description").where("timestamp_sec is not null")
    events = f.where("event_description is not null").select("video_id", "timestamp_sec", F.col("frame_id").alias("k"), F.col("event_description").alias("event"))
    out = as_of(f.select("frame_id", "video_id", "timestamp_sec"), events, by="video_id", time="timestamp_sec", tie="k", value="event", bucket=600.0)
    return out.select("frame_id", F.coalesce("event", F.lit("")).alias("event"))


@register(with_sql(FRAMES, _SCENES, _TIMELINE) + "select k as event_frame, (select max(scene_index) from (select scene_index, start_sec, rank() over (order by start_sec desc, scene_index desc) r from scenes s where s.video_id = tl.video_id and start_sec <= t + 1.05) where r = 1) as scene from tl")
def scene_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last scene that starts no later than 1.05 s after an event."""
    events = frames(spark, d, "video_id", "timestamp_sec", "event_description").where("event_description is not null and timestamp_sec is not null")
    events = events.select(F.col("frame_id").alias("event_frame"), "video_id", (F.col("timestamp_sec") + 1.05).alias("t"))
    s = scenes(spark, d).select("video_id", F.col("start_sec").alias("t"), F.col("scene_index").alias("k"), F.col("scene_index").alias("scene"))
    return as_of(events, s, by="video_id", time="t", tie="k", value="scene", bucket=600.0).select("event_frame", "scene")


@register(with_sql(FRAMES, _SCENES, _TIMELINE) + "select round(avg(case when exists (select 1 from scenes s where s.video_id = tl.video_id and t between start_sec - 1.05 and end_sec + 1.05) then 1.0 else 0.0 end), 6) as in_scene from tl")
def timeline_in_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Share of events that lie within some scene, give or take 1.05 s."""
    events = frames(spark, d, "video_id", "timestamp_sec", "event_description").where("event_description is not null and timestamp_sec is not null").select("frame_id", "video_id", "timestamp_sec")
    s = scenes(spark, d).select("video_id", (F.col("start_sec") - 1.05).alias("a"), (F.col("end_sec") + 1.05).alias("b"))
    inside = range_join(events, s, by="video_id", point="timestamp_sec", start="a", end="b", width=60, closed=True).select("frame_id").distinct().withColumn("hit", F.lit(1.0))
    return events.join(inside, "frame_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("in_scene"))


@register(with_sql(FRAMES, _SCENES, _TIMELINE) + "select video_id, scene_index, exists (select 1 from tl where tl.video_id = s.video_id and abs(t - start_sec) <= 2) as covered from scenes s")
def scene_start_covered(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event lies within 2 s of a scene's start."""
    events = frames(spark, d, "video_id", "timestamp_sec", "event_description").where("event_description is not null and timestamp_sec is not null").select("video_id", "timestamp_sec")
    s = scenes(spark, d).select("video_id", "scene_index", "start_sec")
    near = within(s, events, by="video_id", left="start_sec", right="timestamp_sec", distance=2.0).select("video_id", "scene_index").distinct().withColumn("hit", F.lit(True))
    return s.join(near, ["video_id", "scene_index"], "left").select("video_id", "scene_index", F.coalesce("hit", F.lit(False)).alias("covered"))


@register(with_sql(DETECTIONS) + "select a.frame_id, a.crop_id as crop_a, b.crop_id as crop_b from det a join det b on a.frame_id = b.frame_id and a.crop_id < b.crop_id where a.quality_ok = 1 and b.quality_ok = 1")
def same_frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of good detections of one frame; a frame holds few."""
    det = detections(spark, d).where("quality_ok = 1").select("frame_id", "crop_id")
    return det.select("frame_id", F.col("crop_id").alias("crop_a")).join(det.select("frame_id", F.col("crop_id").alias("crop_b")), "frame_id").where("crop_a < crop_b")


_ENDS = """e as (select track_id, min(frame_id) f0, max(frame_id) f1, arg_min((x1, y1, x2, y2), (frame_id, crop_id)) b0, arg_max((x1, y1, x2, y2), (frame_id, crop_id)) b1 from det group by 1),
b as (select track_id, f0, f1, b0[1] p1, b0[2] q1, b0[3] p2, b0[4] q2, b1[1] x1, b1[2] y1, b1[3] x2, b1[4] y2 from e)"""
_IOU = "greatest(0.0, least(a.x2, c.p2) - greatest(a.x1, c.p1)) * greatest(0.0, least(a.y2, c.q2) - greatest(a.y1, c.q1))"


@register(with_sql(DETECTIONS, _ENDS) + f"""select a.track_id as track_a, c.track_id as track_b, c.f0 - a.f1 as gap, round({_IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.p2 - c.p1) * (c.q2 - c.q1) - {_IOU} + 1e-9), 6) as iou
from b a join b c on c.f0 - a.f1 between 1 and 120 and a.track_id <> c.track_id where {_IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.p2 - c.p1) * (c.q2 - c.q1) - {_IOU} + 1e-9) >= 0.4""")
def track_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Tracks that begin at most 120 frames after another ends, in nearly the same place."""
    det = detections(spark, d)
    box = F.struct("x1", "y1", "x2", "y2")
    ends = det.groupBy("track_id").agg(F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1"), F.min_by(box, F.struct("frame_id", "crop_id")).alias("b0"), F.max_by(box, F.struct("frame_id", "crop_id")).alias("b1"))
    a = ends.select(F.col("track_id").alias("track_a"), (F.col("f1") + 1).alias("lo"), (F.col("f1") + 120).alias("hi"), "f1", F.col("b1"), F.lit(0).alias("g"))
    b = ends.select(F.col("track_id").alias("track_b"), F.col("f0"), F.col("b0"), F.lit(0).alias("g"))
    pairs = range_join(b, a, by="g", point="f0", start="lo", end="hi", width=120, closed=True).where("track_a <> track_b")
    overlap = N.iou(tuple(F.col(f"b1.{x}") for x in ("x1", "y1", "x2", "y2")), tuple(F.col(f"b0.{x}") for x in ("x1", "y1", "x2", "y2")))
    return pairs.withColumn("iou", overlap).where("iou >= 0.4").select("track_a", "track_b", F.expr("f0 - f1").alias("gap"), F.round("iou", 6).alias("iou"))


@register("""with p as (select distinct face_a, face_b, app_dist, face_dist from merge_candidates where face_a < face_b and app_dist <= 0.35 and face_dist <= 0.75),
s as (select distinct face_id, video_id, cast(floor(u) as bigint) sec from (select face_id, video_id, unnest(range(cast(floor(first_sec) as bigint), cast(floor(last_sec) as bigint) + 1)) u from identities where first_sec <= last_sec and face_id is not null))
select face_a, face_b, app_dist, face_dist from p where not exists (select 1 from s a join s b on a.video_id = b.video_id and a.sec = b.sec where a.face_id = p.face_a and b.face_id = p.face_b)""")
def disjoint_identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs under both distances whose identities never share a second."""
    p = table(spark, d, "merge_candidates").where("face_a < face_b and app_dist <= 0.35 and face_dist <= 0.75").select("face_a", "face_b", "app_dist", "face_dist").distinct()
    # Two spans of whole seconds meet if one of them begins within the other.
    spans = table(spark, d, "identities").where("first_sec <= last_sec and face_id is not null and video_id is not null").select("face_id", "video_id", F.floor("first_sec").alias("s"), F.floor("last_sec").alias("e")).distinct()
    of = lambda face: p.select("face_a", "face_b").join(spans.withColumnRenamed("face_id", face), face).select(F.struct("face_a", "face_b", "video_id").alias("both"), "s", "e")
    a, b = of("face_a"), of("face_b")
    met = [range_join(x.select("both", F.col("s").alias("at")), y, by="both", point="at", start="s", end="e", width=60) for x, y in ((a, b), (b, a))]
    both = met[0].select("both.face_a", "both.face_b").unionByName(met[1].select("both.face_a", "both.face_b")).distinct()
    return p.join(both, ["face_a", "face_b"], "left_anti")


_MOVED = "greatest(0.0, least(u.x2, o.x2) - greatest(u.x1, o.x1)) * greatest(0.0, least(u.y2, o.y2) - greatest(u.y1, o.y1))"
#: The tables' detections all have tracks; those of low score stand for ones that the tracker has not confirmed.
_TRACKED = "tr as (select *, case when det_score >= 0.5 then track_id end t from det)"


@register(with_sql(DETECTIONS, _TRACKED, f"m as (select u.crop_id, o.crop_id other, o.t, {_MOVED} / ((u.x2 - u.x1) * (u.y2 - u.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {_MOVED} + 1e-9) v from tr u join tr o on o.frame_id = u.frame_id + 1 where u.t is null and o.t is not null)", "a as (select crop_id, arg_max(t, (v, other)) t from m where v >= 0.5 group by 1)")
    + "select crop_id, t as track_id from tr where t is not null union all select crop_id, t from a union all select crop_id, 's' || (row_number() over (order by crop_id) - 1) from tr where t is null and crop_id not in (select crop_id from a)")
def next_frame_match(spark: SparkSession, d: str) -> DataFrame:
    """Every detection's track: its own, the one it adopts from the next frame, or a new one."""
    det = detections(spark, d).withColumn("track_id", F.when(F.col("det_score") >= 0.5, F.col("track_id")))
    return adopt_tracks(det, "crop_id", "frame_id", "track_id", ("x1", "y1", "x2", "y2"))


@register(with_sql(FRAMES) + "select row_number() over (order by frame_ids) - 1 as pos, frame_ids as frame_id, caption from (select distinct frame_ids from image_index where frame_ids is not null) join frames on frame_id = frame_ids")
def index_order(spark: SparkSession, d: str) -> DataFrame:
    """Metadata in the order of the index; an index row without metadata is an error."""
    i = table(spark, d, "image_index").where("frame_ids is not null").select(F.col("frame_ids").alias("frame_id")).distinct()
    place = numbered(i, [F.col("frame_id")], "pos")
    meta = frames(spark, d, "caption").select("frame_id", F.coalesce("caption", F.lit(None)).alias("caption"), F.lit(True).alias("__there"))
    found = F.when(F.col("__there"), F.col("pos") - 1).otherwise(F.raise_error(F.concat(F.lit("no metadata for index row of frame "), F.col("frame_id").cast("string"))).cast("int"))
    return place.join(meta, "frame_id", "left").select(found.cast("long").alias("pos"), "frame_id", "caption")


@register("""with v as (select vec_id, label, embedding e from embeddings), q as (select * from v where vec_id % 20 = 0),
p as (select q.vec_id qid, v.vec_id nid, v.label, round(list_dot_product(cast(q.e as double[]), cast(v.e as double[])), 5) s from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by qid order by s desc, nid) n from p)
select qid as vec_id, arg_min(label, n) as suggested from r where n <= 25 and label % 3 = 0 group by 1""")
def nearest_labelled(spark: SparkSession, d: str) -> DataFrame:
    """The first of a vector's 25 nearest that carries a label in use, for every twentieth vector."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = top_neighbors(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 25, digits=5)
    named = near.join(v.select(F.col("vec_id").alias("neighbor"), "label"), "neighbor").where("label % 3 = 0")
    return named.groupBy("vec_id").agg(F.min_by("label", "rank").alias("suggested"))


@register(with_sql(TRACKS) + "select p_partkey, coalesce(face_id, 'unknown') as face_id from part left join trk on track_id = 't' || p_partkey")
def live_identity(spark: SparkSession, d: str) -> DataFrame:
    """Labels joined with the identities of now, unknown where there is none."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey")).alias("track_id"))
    return p.join(tracks(spark, d).select("track_id", "face_id"), "track_id", "left").select("p_partkey", F.coalesce("face_id", F.lit("unknown")).alias("face_id"))


@register(with_sql(FRAMES) + "select frame_id from frames where frame_id not in (select frame_ids from image_index where frame_ids is not null)")
def rows_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Frames that are not in the index yet."""
    done = table(spark, d, "image_index").select(F.col("frame_ids").alias("frame_id"))
    return frames(spark, d).select("frame_id").join(done, "frame_id", "left_anti")
