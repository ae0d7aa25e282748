"""Sorts, limits, set operations and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators.search import rank_by_vector, reciprocal_rank_fusion
from framewright.operators.search import search as search_rows
from framewright.operators.vectors import top_neighbors
from framewright.plans.base import FRAMES, IDENTITIES, Registry, frames, identities, with_sql
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql


def _query_vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    row = table(spark, d, "embeddings").where((F.col("vec_id") == vec_id) & F.col("embedding").isNotNull()).select("embedding").first()
    return row[0] if row else []


_TOP = "q as (select embedding e from embeddings where vec_id = {q}), s as (select vec_id, label, round(list_dot_product(cast(embedding as double[]), cast(q.e as double[])), 6) score from embeddings, q), t as (select *, row_number() over (order by score desc, vec_id) r from s)"


@register(with_sql(_TOP.format(q=17)) + "select vec_id, score, r as rank from t where r <= 10")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most similar to one."""
    return rank_by_vector(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d, 17), 10, min_score=-2.0)


@register("""with v as (select vec_id, embedding e from embeddings), q as (select * from v where vec_id % 20 = 0),
p as (select q.vec_id, v.vec_id neighbor, round(list_dot_product(cast(q.e as double[]), cast(v.e as double[])), 3) score from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by vec_id order by score desc, neighbor) r from p) select vec_id, neighbor, score, r as rank from r where r <= 25""")
def neighbors_per_row(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nearest of every twentieth vector, scores to three places."""
    e = table(spark, d, "embeddings")
    return top_neighbors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 25, digits=3)


@register(with_sql(FRAMES, "m as (select frame_id, timestamp_sec t, ocr_text x, caption c, lower(coalesce(ocr_text, '')) lx, lower(coalesce(caption, '')) lc from frames)")
    + """select frame_id, t as timestamp_sec, case when contains(lx, 'platform') then 'ocr_text' else 'caption' end as field,
  cast(case when contains(lx, 'platform') then (length(lx) - length(replace(lx, 'platform', ''))) / 8 else (length(lc) - length(replace(lc, 'platform', ''))) / 8 end as int) as score from m where contains(lx, 'platform') or contains(lc, 'platform')""")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """Literal search in sign texts and captions, the first field that matches and its hits."""
    return search_rows(frames(spark, d, "timestamp_sec", "ocr_text", "caption"), "platform", ("ocr_text", "caption")).select("frame_id", "timestamp_sec", "field", "score").orderBy("timestamp_sec", "frame_id")


@register(with_sql(FRAMES) + "select frame_id, len(regexp_extract_all(lower(ocr_text), 'platform ?[0-9]')) as score from frames where regexp_matches(lower(coalesce(ocr_text, '')), 'platform ?[0-9]')")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    """Pattern search without case."""
    return search_rows(frames(spark, d, "ocr_text"), "platform ?[0-9]", regex=True).select("frame_id", "score")


@register()
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    """Literal search that also finds misread words."""
    return search_rows(frames(spark, d, "timestamp_sec", "ocr_text"), "emergency", fuzzy=True).select("frame_id", "score", "snippet")


_SNIP = "m as (select frame_id, caption c, instr(lower(caption), 'platform') - 1 p0 from frames where contains(lower(coalesce(caption, '')), 'platform')), b as (select *, greatest(0, p0 - 20) a, least(length(c), p0 + 38) z from m)"


@register(with_sql(FRAMES, _SNIP) + "select frame_id, (case when a > 0 then '…' else '' end) || trim(substring(c, cast(a + 1 as bigint), cast(z - a as bigint))) || (case when z < length(c) then '…' else '' end) as snippet from b")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The window around the first hit."""
    f = frames(spark, d, "caption").where("contains(lower(coalesce(caption, '')), 'platform')")
    return f.select("frame_id", X.snippet("caption", "platform").alias("snippet"))


@register(with_sql(_TOP.format(q=3)) + "select t.vec_id, score, left(text, 80) || case when length(text) > 80 then '…' else '' end as snippet from t join (select doc_id, coalesce(text, '') as text from documents) on doc_id = t.vec_id where r <= 20 and score >= 0.2")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 by vector, then the least score, then the texts; rows without a text drop out."""
    hits = rank_by_vector(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d, 3), 20, min_score=0.2)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), X.shortened("text").alias("snippet"))
    return hits.join(docs, "vec_id").select("vec_id", "score", "snippet")


_VIS = "q as (select any_value(embeddings) e from image_index where frame_ids = (select min(frame_ids) from image_index where len(embeddings) = 64 and not list_bool_or(list_transform(embeddings, lambda x: isnan(x))) and embeddings[1] <> 0)), s as (select distinct frame_ids, round(list_dot_product(cast(embeddings as double[]), cast(q.e as double[])), 5) score from image_index, q where len(embeddings) = 64 and not list_bool_or(list_transform(embeddings, lambda x: isnan(x))) and frame_ids is not null), t as (select *, row_number() over (order by score desc, frame_ids) r from s)"


@register(with_sql(FRAMES, _VIS) + "select frame_id, score, filename from t join frames on frame_id = frame_ids where r <= 20 and score >= 0.2")
def visual_search(spark: SparkSession, d: str) -> DataFrame:
    """The same operator over the picture index."""
    i = table(spark, d, "image_index").where("frame_ids is not null and size(embeddings) = 64 and not exists(embeddings, x -> isnan(x))").select(F.col("frame_ids").alias("frame_id"), "embeddings").dropDuplicates(["frame_id"])
    first = i.where("embeddings[0] <> 0").orderBy("frame_id").first()
    return rank_by_vector(i, "frame_id", "embeddings", first[1] if first else [], 20, 0.2, digits=5).join(frames(spark, d, "filename"), "frame_id").select("frame_id", "score", "filename")


_FUSE = "a as (select vec_id, row_number() over (order by round(list_dot_product(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 5) as double[])), 6) desc, vec_id) r from embeddings), b as (select vec_id, row_number() over (order by round(list_dot_product(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 9) as double[])), 6) desc, vec_id) r from embeddings), u as (select * from a where r <= 50 union all select * from b where r <= 50), f as (select vec_id, sum(1.0 / (60 + r)) s from u group by 1)"


@register(with_sql(_FUSE) + "select vec_id, round(s, 6) as score from f")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings fused by their reciprocal ranks."""
    e = table(spark, d, "embeddings")
    ranks = [rank_by_vector(e, "vec_id", "embedding", _query_vector(spark, d, q), 50, -2.0) for q in (5, 9)]
    return reciprocal_rank_fusion(ranks, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@register(with_sql(_FUSE) + "select t.vec_id, round(s, 4) as score, coalesce(source, '') as source from (select * from f order by round(s, 9) desc, vec_id limit 20) t join documents on doc_id = t.vec_id")
def fused_search(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two pools of 50, cut to 20 before the metadata join."""
    e = table(spark, d, "embeddings")
    ranks = [rank_by_vector(e, "vec_id", "embedding", _query_vector(spark, d, q), 50, -2.0) for q in (5, 9)]
    top = reciprocal_rank_fusion(ranks, "vec_id").orderBy(F.desc(F.round("score", 9)), "vec_id").limit(20)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("source", F.lit("")).alias("source"))
    return top.join(docs, "vec_id").select("vec_id", F.round("score", 4).alias("score"), "source")


@register("select q as query, case when count(*) = 0 then 0.0 else round(avg(cast(regexp_matches(lower(coalesce(text, '')), '\\b(' || t || ')\\b') as int)), 6) end as precision from (select * from (values ('tunnel', 'tunnel|shaft'), ('bench', 'bench|seat')) v(q, t), (select doc_id, text, row_number() over (order by doc_id) r from documents where contains(lower(coalesce(text, '')), 'the')) where r <= 5) group by 1")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of relevant texts among the first five returned, per query."""
    docs = table(spark, d, "documents").where(F.lower(X.filled("text")).contains("the")).orderBy("doc_id").limit(5)
    q = F.array(*[F.struct(F.lit(n).alias("query"), F.lit(rf"\b({t})\b").alias("terms")) for n, t in (("tunnel", "tunnel|shaft"), ("bench", "bench|seat"))])
    return docs.select("text", F.inline(q)).groupBy("query").agg(F.round(F.avg(F.expr("cast(lower(coalesce(text, '')) rlike terms as int)")), 6).alias("precision"))


@register(with_sql(IDENTITIES) + "select face_id, round(sum(duration_sec), 3) as screen_time from ids where face_id is not null group by 1 order by 2 desc, 1 limit 30")
def longest_on_screen(spark: SparkSession, d: str) -> DataFrame:
    """The thirty identities longest on screen."""
    return identities(spark, d).where("face_id is not null").groupBy("face_id").agg(F.round(F.sum("duration_sec"), 3).alias("screen_time")).orderBy(F.desc("screen_time"), "face_id").limit(30)


@register(with_sql(FRAMES) + "select frame_id, timestamp_sec from frames where contains(lower(coalesce(ocr_text, '')), 'platform') and timestamp_sec is not null order by timestamp_sec, frame_id")
def hits_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Hits in order of time, as the search command lists them; a sort by ranges, not in one task."""
    f = frames(spark, d, "timestamp_sec", "ocr_text").where("timestamp_sec is not null")
    return search_rows(f, "platform", ("ocr_text",)).select("frame_id", "timestamp_sec").orderBy("timestamp_sec", "frame_id")


@register(with_sql(FRAMES) + "select frame_id from frames order by frame_id limit 25")
def head_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 frames."""
    return frames(spark, d).select("frame_id").orderBy("frame_id").limit(25)


@register(with_sql(FRAMES, "g as (select frame_id, case when coalesce(ocr_text, '') <> '' then 'text' when len(face_ids) > 0 then 'faces' else 'rest' end stratum, md5(cast(frame_id as varchar) || '-7') h from frames), r as (select *, row_number() over (partition by stratum order by h) n from g)") + "select frame_id, stratum from r where n <= case stratum when 'text' then 40 when 'faces' then 20 else 40 end")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample by strata, drawn by a seeded hash so that it can be repeated."""
    f = frames(spark, d, "ocr_text", "face_ids").select("frame_id", F.expr("case when coalesce(ocr_text, '') <> '' then 'text' when size(face_ids) > 0 then 'faces' else 'rest' end").alias("stratum"), F.md5(F.concat(F.col("frame_id").cast("string"), F.lit("-7"))).alias("h"))
    parts = [f.where(F.col("stratum") == s).orderBy("h").limit(n) for s, n in (("text", 40), ("faces", 20), ("rest", 40))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("frame_id", "stratum")


@register(with_sql(FRAMES, "u as (select frame_id, 1 s from frames where len(face_ids) > 0 union all select frame_id, 2 from frames where coalesce(ocr_text, '') <> '' union all select frame_id, 3 from frames)") + "select frame_id, min(s) as stratum from u group by 1")
def union_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Union of strata, each frame once with its first stratum."""
    f = frames(spark, d, "face_ids", "ocr_text")
    s = lambda cond, n: f.where(cond).select("frame_id", F.lit(n).alias("s"))
    u = s("size(face_ids) > 0", 1).unionByName(s("coalesce(ocr_text, '') <> ''", 2)).unionByName(s("true", 3))
    return u.groupBy("frame_id").agg(F.min("s").alias("stratum"))


@register(with_sql(FRAMES, "t as (select frame_id, list_distinct(regexp_extract_all(lower(coalesce(caption, '')), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(coalesce(speech, '')), '[a-z0-9]+')) b from frames)") + "select frame_id, len(list_intersect(a, b)) as n_common, len(list_distinct(a || b)) as n_all, case when len(list_distinct(a || b)) = 0 then 1.0 else round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) end as jaccard, len(list_filter(a, lambda x: not list_contains(b, x))) as n_missing from t")
def set_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Common, all and missing words of caption and speech; two empty ones are alike."""
    t = frames(spark, d, "caption", "speech").select("frame_id", X.tokens("caption").alias("a"), X.tokens("speech").alias("b"))
    return t.select("frame_id", F.size(F.array_intersect("a", "b")).alias("n_common"), F.size(F.array_union("a", "b")).alias("n_all"), F.round(X.jaccard("a", "b", 1.0), 6).alias("jaccard"), F.size(F.array_except("a", "b")).alias("n_missing"))


@register("select event_type, count(*) - count(distinct date_trunc('minute', ts)) as repeated from events group by 1")
def repeated_times(spark: SparkSession, d: str) -> DataFrame:
    """Events beyond the first of each minute, per type."""
    return table(spark, d, "events").groupBy("event_type").agg((F.count("*") - F.countDistinct(F.date_trunc("minute", "ts"))).alias("repeated"))
