"""Projections, filters and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.plans.base import DETECTIONS, FRAMES, IDENTITIES, TRACKS, Registry, detections, frames, identities, tracks, with_sql
from framewright.session import cut
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql


@register(with_sql(FRAMES) + "select frame_id, cast(floor(timestamp_sec) as bigint) // 60 || ':' || lpad(cast(cast(floor(timestamp_sec) as bigint) % 60 as varchar), 2, '0') as mmss from frames where timestamp_sec is not null")
def time_label(spark: SparkSession, d: str) -> DataFrame:
    """Frame times as m:ss."""
    return frames(spark, d, "timestamp_sec").where("timestamp_sec is not null").select("frame_id", N.minutes_seconds("timestamp_sec").alias("mmss"))


@register("""select doc_id, case when regexp_full_match(trim(split_part(text, ' ', 1), '[] '), '\\d{1,2}:[0-5]\\d') then cast(split_part(trim(split_part(text, ' ', 1), '[] '), ':', 1) as int) * 60 + cast(split_part(trim(split_part(text, ' ', 1), '[] '), ':', 2) as int) end as sec
from documents where text is not null and source = 'speech'""")
def parse_time_label(spark: SparkSession, d: str) -> DataFrame:
    """The time mark that opens a transcript, in seconds, null where there is none."""
    mark = F.regexp_replace(F.split("text", " ", 2)[0], r"^[\[\] ]+|[\[\] ]+$", "")
    return table(spark, d, "documents").where("text is not null and source = 'speech'").select("doc_id", N.parse_minutes_seconds(mark).alias("sec"))


@register(with_sql(DETECTIONS) + "select crop_id, x2 - x1 as w, y2 - y1 as h from det where x2 - x1 >= 36 and y2 - y1 >= 36")
def min_size_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections of at least 36 pixels either way."""
    return detections(spark, d).selectExpr("crop_id", "x2 - x1 as w", "y2 - y1 as h").where("w >= 36 and h >= 36")


@register(with_sql(DETECTIONS) + "select quality_ok, count(*) as n from det group by 1")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Detections by quality: sure, sharp and turned to the camera."""
    return detections(spark, d).groupBy("quality_ok").agg(F.count("*").alias("n"))


@register(with_sql(IDENTITIES) + "select track_id, face_id from ids where face_id is not null and face_id <> 'unknown'")
def known_identity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with a known identity."""
    return identities(spark, d).where("face_id is not null and face_id <> 'unknown'").select("track_id", "face_id")


_WORDS = "w as (select doc_id, unnest(string_split_regex(trim(text, e' \\t\\n\\r'), '\\s+')) w, unnest(range(1, 1 + len(string_split_regex(trim(text, e' \\t\\n\\r'), '\\s+')))) pos from documents where source = 'ocr' and text is not null and trim(text, e' \\t\\n\\r') <> '')"
_KEPT = _WORDS + ",\nk as (select doc_id, pos, w, 50 + (doc_id * 31 + pos * 17) % 50 conf from w)"


def _ocr_words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, w, conf): words of sign texts with a confidence derived from their place."""
    docs = table(spark, d, "documents").where("source = 'ocr' and text is not null").where(X.stripped("text") != "")
    words = docs.select("doc_id", F.posexplode(F.split(X.stripped("text"), r"\s+")).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)
    return words.withColumn("conf", 50 + (F.col("doc_id") * 31 + F.col("pos") * 17) % 50)


@register(with_sql(_KEPT) + "select doc_id, pos, w as word from k where conf >= 60 and length(w) >= 3 and regexp_matches(w, '\\p{L}')")
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that are confident, long enough and have a letter."""
    return _ocr_words(spark, d).where(X.keep_token("w", "conf")).select("doc_id", "pos", F.col("w").alias("word"))


@register(with_sql(_KEPT) + "select doc_id, string_agg(w, ' ' order by pos) as text, count(*) as n_tokens, round(avg(conf), 1) as mean_conf from k where conf >= 60 and length(w) >= 3 and regexp_matches(w, '\\p{L}') group by doc_id")
def filter_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Kept tokens joined in order, with their number and mean confidence."""
    kept = _ocr_words(spark, d).where(X.keep_token("w", "conf"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return kept.groupBy("doc_id").agg(text.alias("text"), F.count("*").alias("n_tokens"), F.round(F.avg("conf"), 1).alias("mean_conf"))


@register()
def lexicon_snap(spark: SparkSession, d: str) -> DataFrame:
    """Noisy sign words rewritten to frequent sign words: those met more often than the mean word, from a hundred-thousandth of all words on,
    which bounds their number; each distinct word is compared once."""
    words = _ocr_words(spark, d).where(r"w rlike '^[A-Za-z]{5,}$'").groupBy(F.lower("w").alias("lower")).agg(F.count("*").alias("n"), F.min("w").alias("w"))
    words = cut(words)
    least = words.agg(F.avg("n").alias("mean"), F.sum("n").alias("total")).first()
    lexicon = sorted(r.lower for r in words.where(F.col("n") >= max(least.mean or 1.0, (least.total or 0) * 1e-5)).select("lower").collect())
    return words.select("w", X.snap_to_lexicon_python(lexicon)("w").alias("snapped")).where("w <> snapped")


_CARD = r"(regexp_matches(trim(coalesce(ocr_text, ''), e' \t\n\r'), '^[A-Z][A-Za-z& ]{2,28}\s+Line\s*$') or contains(lower(coalesce(caption, '')), 'black background') or starts_with(lower(trim(coalesce(caption, ''), e' \t\n\r')), 'a title card that reads'))"


@register(with_sql(FRAMES) + f"select frame_id, {_CARD} as is_card from (select frame_id, case when frame_id % 9 = 0 then story_segment else ocr_text end ocr_text, caption from frames)")
def title_card(spark: SparkSession, d: str) -> DataFrame:
    """Whether a frame is a card that names a line; every ninth frame is given its segment as text."""
    f = frames(spark, d, "ocr_text", "caption", "story_segment").withColumn("ocr_text", F.when(F.col("frame_id") % 9 == 0, F.col("story_segment")).otherwise(F.col("ocr_text")))
    return f.select("frame_id", X.is_title_card("ocr_text", "caption").alias("is_card"))


@register(with_sql(FRAMES) + "select video_id, coalesce(arg_min(story_segment, frame_id) filter (where regexp_matches(story_segment, '^[A-Z][A-Za-z& ]{2,28}\\s+Line\\s*$')), 'Introduction') as label from frames group by 1")
def chapter_label(spark: SparkSession, d: str) -> DataFrame:
    """The first text of a group that names a line, else Introduction."""
    named = F.col("story_segment").rlike(X.TITLE_CARD)
    return frames(spark, d, "video_id", "story_segment").groupBy("video_id").agg(F.coalesce(F.min_by(F.when(named, F.col("story_segment")), F.when(named, F.col("frame_id"))), F.lit("Introduction")).alias("label"))


_SIGN = r"""w as (select distinct trim(ocr_text, e' \t\n\r') t from frames where ocr_text is not null),
s as (select t, string_split_regex(t, '\s+') ws, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) capitals from w)"""


@register(
    with_sql(FRAMES, _SIGN)
    + r"""select t as text, length(t) >= 4 and letters > 0
  and not list_bool_or(list_transform(ws, lambda w: lower(trim(w, '.,:;''"')) in ('experian','credit','score','free','forever','find','now','massage','massages','ticket','holders','only','awesome')))
  and ((capitals / letters >= 0.8 and list_bool_or(list_transform(ws, lambda w: length(w) >= 4))) or (len(ws) >= 2 and list_bool_and(list_transform(ws, lambda w: regexp_matches(w, '^[A-Za-z]{5,}$'))))) as is_signage
from s"""
)
def signage(spark: SparkSession, d: str) -> DataFrame:
    """Which sign texts read like signage."""
    texts = frames(spark, d, "ocr_text").where("ocr_text is not null").select(X.stripped("ocr_text").alias("text")).distinct()
    return texts.select("text", X.is_signage("text").alias("is_signage"))


_TOK = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


@register(with_sql(FRAMES) + f"select frame_id, len({_TOK('caption')}) > 0 and len({_TOK('ocr_text')}) > 0 and len(list_intersect({_TOK('caption')}, {_TOK('ocr_text')})) / len(list_distinct({_TOK('caption')} || {_TOK('ocr_text')})) >= 0.5 as echoes from frames")
def caption_echo(spark: SparkSession, d: str) -> DataFrame:
    """Captions that mostly repeat the text on the picture."""
    return frames(spark, d, "caption", "ocr_text").select("frame_id", X.caption_echoes_text("caption", "ocr_text").alias("echoes"))


@register(with_sql(FRAMES, "s as (select frame_id, trim(speech, e' \\t\\n\\r') t from frames where speech is not null and trim(speech, e' \\t\\n\\r') <> '' and lower(trim(speech, e' \\t\\n\\r')) not in ('you', 'thank you.', '.'))") + "select frame_id, t as text from (select *, count(*) over (partition by lower(t)) n from s) where n < 6")
def clean_segments(spark: SparkSession, d: str) -> DataFrame:
    """Speech without blanks, fillers and texts that repeat six times or more; counted before joining, so a hot text is combined early."""
    s = frames(spark, d, "speech").select("frame_id", X.stripped("speech").alias("text")).where("text <> '' and lower(text) not in ('you', 'thank you.', '.')").withColumn("plain", F.lower("text"))
    loops = s.groupBy("plain").agg(F.count("*").alias("n")).where("n >= 6")
    return s.join(loops, "plain", "left_anti").select("frame_id", "text")


@register("select doc_id, regexp_matches(lower(coalesce(text, '')), '\\b(tunnel|handrail|ticket barrier)\\b') as relevant from documents")
def term_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document has one of the query's terms as whole words."""
    terms = "|".join(as_literal(t) for t in ("tunnel", "handrail", "ticket barrier"))
    return table(spark, d, "documents").select("doc_id", F.lower(X.filled("text")).rlike(rf"\b({terms})\b").alias("relevant"))


def as_literal(term: str) -> str:
    """A term as a literal within a regular expression."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in term.lower())


@register(with_sql(DETECTIONS) + "select crop_id, cast(det_score < 0.55 and (case when y2 - y1 = 0 then 0 else (x2 - x1) / (y2 - y1) end < 0.5 or case when y2 - y1 = 0 then 0 else (x2 - x1) / (y2 - y1) end > 1.8) as int) as non_face, cast(least(x2 - x1, y2 - y1) < 60 as int) as small from det")
def face_flags(spark: SparkSession, d: str) -> DataFrame:
    """Likely non-faces (unsure and of odd aspect) and small faces."""
    aspect = N.ratio(F.expr("x2 - x1"), F.expr("y2 - y1"), 0.0)
    return detections(spark, d).select("crop_id", ((F.col("det_score") < 0.55) & ((aspect < 0.5) | (aspect > 1.8))).cast("int").alias("non_face"), F.expr("cast(least(x2 - x1, y2 - y1) < 60 as int)").alias("small"))


@register("select face_a, face_b, concat_ws(' ', case when face_dist >= 0.6 then 'merge?' end, case when app_dist < 0.2 then 'split?' end) as review from (select distinct face_a, face_b, app_dist, face_dist from merge_candidates)")
def review_flag(spark: SparkSession, d: str) -> DataFrame:
    """Hints for a reviewer, joined by a blank."""
    m = table(spark, d, "merge_candidates").select("face_a", "face_b", "app_dist", "face_dist").distinct()
    return m.select("face_a", "face_b", F.concat_ws(" ", F.when(F.col("face_dist") >= 0.6, "merge?"), F.when(F.col("app_dist") < 0.2, "split?")).alias("review"))


@register(with_sql(FRAMES) + "select frame_id from frames where coalesce(ocr_text, '') <> '' and len(face_ids) > 0 and (contains(lower(ocr_text), 'line') or contains(lower(coalesce(caption, '')), 'train'))")
def browse_filter(spark: SparkSession, d: str) -> DataFrame:
    """Frames with text and faces whose text or caption holds a word."""
    return frames(spark, d, "ocr_text", "caption", "face_ids").where("coalesce(ocr_text, '') <> '' and size(face_ids) > 0 and (contains(lower(ocr_text), 'line') or contains(lower(coalesce(caption, '')), 'train'))").select("frame_id")


@register(with_sql(FRAMES) + "select frame_id, timestamp_sec from frames where list_contains(face_ids, 'Face_00000161')")
def member_filter(spark: SparkSession, d: str) -> DataFrame:
    """Frames that show one identity."""
    return frames(spark, d, "timestamp_sec", "face_ids").where(F.array_contains("face_ids", "Face_00000161")).select("frame_id", "timestamp_sec")


@register(with_sql(TRACKS) + "select track_id, case when face_id in ('unknown', '') then 'unk_' || track_id else face_id end as cluster from trk")
def unknown_singletons(spark: SparkSession, d: str) -> DataFrame:
    """Every unknown track as a cluster of its own, named by its track, so no global numbering is needed."""
    return tracks(spark, d).select("track_id", F.when(F.col("face_id").isin("unknown", ""), F.concat(F.lit("unk_"), F.col("track_id"))).otherwise(F.col("face_id")).alias("cluster"))


@register("select event_type, count(*) as n from events where event_type not in ('', 'x', 'error') group by 1")
def label_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Labels but for the ones that stand for no label."""
    return table(spark, d, "events").where(~F.col("event_type").isin("", "x", "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("select event_id from events where value / 100 >= 0.010 and value is not null")
def text_likelihood_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate before text recognition: a share of edge pixels, here of the event's value."""
    return table(spark, d, "events").where("value / 100 >= 0.010").select("event_id")
