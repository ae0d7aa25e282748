"""Closed-form evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators.joins import range_join
from framewright.operators.tables import one_row
from framewright.operators.vectors import cluster_distances, farthest_within
from framewright.plans.aggregates import SQL as AGG_SQL
from framewright.plans.aggregates import likert, text_confusion
from framewright.plans.base import DETECTIONS, FRAMES, TRACKS, Registry, detections, frames, tracks, with_sql
from framewright.plans.retrieval import SQL as RET_SQL
from framewright.plans.retrieval import precision_at_k
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

@register(with_sql(DETECTIONS, TRACKS, "k as (select frame_id, face_id from det join trk using (track_id) where face_id <> 'unknown')", "f as (select frame_id, count(*) n from k group by 1)", "s as (select frame_id, face_id, count(*) n from k group by 1, 2)")
    + "select cast(p as bigint) as n_pairs, cast(v as bigint) as violations, case when p = 0 then 1.0 else round(1 - v / p, 4) end as precision from (select (select sum(n * (n - 1) / 2) from f) p, (select sum(n * (n - 1) / 2) from s) v)")
def cannot_link_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of same-frame pairs with different identities, from counts per frame instead of pairs."""
    k = detections(spark, d).select("frame_id", "track_id").join(tracks(spark, d).where("face_id <> 'unknown'").select("track_id", "face_id"), "track_id")
    s = k.groupBy("frame_id", "face_id").agg(F.count("*").alias("n"))
    f = s.groupBy("frame_id").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    t = f.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n_pairs"), F.sum("same").alias("violations"))
    return t.select("n_pairs", "violations", F.coalesce(F.round(1 - N.ratio("violations", "n_pairs"), 4), F.lit(1.0)).alias("precision"))


_LAB = "lab as (select event_type t, user_id % 7 p from events)"
_CONT = "n as (select t, p, count(*) n from lab group by 1, 2), a as (select t, sum(n) n from n group by 1), b as (select p, sum(n) n from n group by 1), z as (select cast(sum(n) as double) nn, sum(n * (n - 1) / 2) tp from n), ab as (select (select sum(n * (n - 1) / 2) from a) ta, (select sum(n * (n - 1) / 2) from b) tb)"


def contingency(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row of the sums that all pair and entropy measures need; only the contingency table is ever built."""
    n = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) / 2"))
    ent = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    z = n.agg(F.sum("n").cast("double").alias("nn"), pairs("n").alias("tp"), ent("n").alias("hn"))
    a = n.groupBy("t").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ta"), ent("n").alias("ha"))
    b = n.groupBy("p").agg(F.sum("n").alias("n")).agg(pairs("n").alias("tb"), ent("n").alias("hb"))
    return one_row(z, a, b)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("t"), (F.col("user_id") % 7).alias("p"))


@register(with_sql(_LAB, _CONT) + "select cast(tp as bigint) as tp, cast(tb - tp as bigint) as fp, cast(ta - tp as bigint) as fn, cast(nn * (nn - 1) / 2 - ta - tb + tp as bigint) as tn, round(tp / tb, 6) as precision, round(tp / ta, 6) as recall, round(2 * tp / (ta + tb), 6) as f1 from z, ab")
def pairwise_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering."""
    return contingency(_labels(spark, d), "t", "p").selectExpr("cast(tp as bigint) as tp", "cast(tb - tp as bigint) as fp", "cast(ta - tp as bigint) as fn", "cast(nn * (nn - 1) / 2 - ta - tb + tp as bigint) as tn", "round(tp / tb, 6) as precision", "round(tp / ta, 6) as recall", "round(2 * tp / (ta + tb), 6) as f1")


@register(with_sql(_LAB, _CONT, "e as (select (select sum(n * ln(n)) from n) hn, (select sum(n * ln(n)) from a) ha, (select sum(n * ln(n)) from b) hb)", "h as (select (hb - hn) / nn htp, (ha - hn) / nn hpt, ln(nn) - ha / nn ht, ln(nn) - hb / nn hp, nn, tp, ta, tb from z, ab, e)")
    + "select round((tp - ta * tb / (nn * (nn - 1) / 2)) / ((ta + tb) / 2 - ta * tb / (nn * (nn - 1) / 2)), 6) as ari, round(1 - htp / ht, 6) as homogeneity, round(1 - hpt / hp, 6) as completeness, round(2 * (1 - htp / ht) * (1 - hpt / hp) / ((1 - htp / ht) + (1 - hpt / hp)), 6) as v_measure from h")
def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index, homogeneity, completeness and V measure from the contingency table."""
    c = contingency(_labels(spark, d), "t", "p").selectExpr("*", "(hb - hn) / nn as htp", "(ha - hn) / nn as hpt", "ln(nn) - ha / nn as ht", "ln(nn) - hb / nn as hp", "ta * tb / (nn * (nn - 1) / 2) as ex")
    c = c.selectExpr("*", "1 - htp / ht as hom", "1 - hpt / hp as com")
    return c.selectExpr("round((tp - ex) / ((ta + tb) / 2 - ex), 6) as ari", "round(hom, 6) as homogeneity", "round(com, 6) as completeness", "round(2 * hom * com / (hom + com), 6) as v_measure")


@register("with f as (select event_type t, count(distinct user_id % 13) n from events group by 1) select round(avg(n), 6) as mean, max(n) as most, arg_min(t, (-n, t)) as worst from f")
def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    """Clusters per true identity: mean, most, and the first identity with the most."""
    f = table(spark, d, "events").groupBy(F.col("event_type").alias("t")).agg(F.countDistinct(F.col("user_id") % 13).alias("n"))
    return f.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.min_by("t", F.struct(-F.col("n"), "t")).alias("worst"))


@register("select coalesce(round(min(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[]))), 5), 1.0) as worst_cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def worst_within_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The least similar pair that shares a label."""
    return farthest_within(table(spark, d, "embeddings"), "label", "embedding").agg(F.coalesce(F.round(F.min("cosine"), 5), F.lit(1.0)).alias("worst_cosine"))


_SIL = """v as (select vec_id, label % 4 c, cast(embedding as double[]) e from embeddings), s as (select c, i, sum(e[i]) m from (select c, e, unnest(range(1, 65)) i from v) group by 1, 2), g as (select c, list(m order by i) m, (select count(*) from v where v.c = s.c) n from s group by 1),
d as (select v.vec_id, v.c own, g.c, case when v.c = g.c then (g.n - list_dot_product(v.e, g.m)) / nullif(g.n - 1, 0) else (g.n - list_dot_product(v.e, g.m)) / g.n end dist from v, g),
w as (select vec_id, max(dist) filter (where own = c) a, min(dist) filter (where own <> c) b from d group by 1)"""


@register(with_sql(_SIL) + "select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 5) as silhouette from w")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine silhouette; the mean distance to a cluster of unit vectors follows from its vector sum, so no pairs are built."""
    v = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("own"), "embedding")
    dims = v.select("own", F.posexplode("embedding").alias("i", "x")).groupBy("own", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    g = dims.groupBy(F.col("own").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("m"), F.max("n").alias("n"))
    w = cluster_distances(v, g, "vec_id", "own", "embedding")
    return w.agg(F.round(F.avg(F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), 5).alias("silhouette"))


@register(with_sql(DETECTIONS, TRACKS, "e as (select track_id, min(frame_id) f0, max(frame_id) f1 from det group by 1)")
    + "select count(*) as n_pairs, round(coalesce(avg(cast(x.face_id = y.face_id and x.face_id <> 'unknown' as int)), 1.0), 6) as recall from e a join e b on b.f0 - a.f1 between 1 and 60 and a.track_id <> b.track_id join trk x on x.track_id = a.track_id join trk y on y.track_id = b.track_id")
def continuity_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of tracks that follow each other within 60 frames and bear the same known identity."""
    e = detections(spark, d).groupBy("track_id").agg(F.min("frame_id").alias("f0"), F.max("frame_id").alias("f1")).join(tracks(spark, d).select("track_id", "face_id"), "track_id")
    a = e.select(F.lit(0).alias("g"), F.col("track_id").alias("ta"), F.col("face_id").alias("fa"), (F.col("f1") + 1).alias("lo"), (F.col("f1") + 60).alias("hi"))
    b = e.select(F.lit(0).alias("g"), F.col("track_id").alias("tb"), F.col("face_id").alias("fb"), "f0")
    p = range_join(b, a, by="g", point="f0", start="lo", end="hi", width=60).where("ta <> tb")
    return p.agg(F.count("*").alias("n_pairs"), F.round(F.coalesce(F.avg(F.expr("cast(fa = fb and fa <> 'unknown' as int)")), F.lit(1.0)), 6).alias("recall"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_CW = lambda c, n=4: f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]+')), lambda w: length(w) >= {n} and w not in ({_STOP}))"


def grounding(text, reference):
    """Share of a text's content words that the reference has; 0 without any."""
    w, r = X.content_words(text), X.content_words(reference, 1)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(w, r)) / F.size(w))


@register(with_sql("r as (select request_id, any_value(prompt) p, any_value(response) r from llm_cache group by 1)", f"t as (select request_id, r, {_CW('r')} w, {_CW('p', 1)} q from r)")
    + "select request_id, len(regexp_extract_all(coalesce(r, ''), '\\S+')) as n_words, case when len(w) = 0 then 0 else round(len(list_intersect(w, q)) / len(w), 6) end as grounding, len(regexp_extract_all(coalesce(r, ''), '\\b\\d{1,2}:[0-5]\\d\\b')) as n_times from t")
def story_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words, cited times and grounding of every reply in its prompt."""
    r = table(spark, d, "llm_cache").select("request_id", "prompt", "response").dropDuplicates(["request_id"])
    return r.select("request_id", F.regexp_count(X.filled("response"), F.lit(r"\S+")).alias("n_words"), F.round(grounding("response", "prompt"), 6).alias("grounding"), F.size(X.cited_seconds("response")).alias("n_times"))


@register(with_sql("l as (select distinct story_segment s from frame_metadata where story_segment is not null)") + "select doc_id, round(avg(cast(contains(lower(coalesce(text, '')), lower(s)) as int)), 6) as coverage from (select * from documents where source = 'story'), l group by 1")
def scene_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the chapter labels that a story names; labels are a handful and travel as one array."""
    labels = table(spark, d, "frame_metadata").where("story_segment is not null").agg(F.collect_set(F.lower("story_segment")).alias("labels"))
    docs = table(spark, d, "documents").where("source = 'story'").select("doc_id", F.lower(X.filled("text")).alias("t"))
    hits = F.size(F.filter("labels", lambda s: F.contains(F.col("t"), s)))
    return docs.crossJoin(F.broadcast(labels)).select("doc_id", F.round(hits / F.size("labels"), 6).alias("coverage"))


@register(with_sql(FRAMES, f"t as (select {_CW('caption')} c, {_CW('speech')} s from frames where coalesce(speech, '') <> '')", "a as (select case when len(s) = 0 then 0 else len(list_intersect(c, s)) / len(s) end a from t)") + "select round(avg(a), 6) as adequacy, round(avg(cast(a < 0.25 as int)), 6) as share_low from a")
def caption_adequacy(spark: SparkSession, d: str) -> DataFrame:
    """How much of a description's content captions have, on average, and how many fall short."""
    a = _adequacy(frames(spark, d, "caption", "speech").where("coalesce(speech, '') <> ''"))
    return a.agg(F.round(F.avg("a"), 6).alias("adequacy"), F.round(F.avg(F.expr("cast(a < 0.25 as int)")), 6).alias("share_low"))


def _adequacy(df: DataFrame) -> DataFrame:
    c, s = X.content_words("caption"), X.content_words("speech")
    return df.select(F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c, s)) / F.size(s)).alias("a"))


@register("""with g as (select event_type k, count_if(value > 50) s, count(*) n from events group by 1) select k as event_type,
round(greatest(0.0, (s / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) as lo,
round(least(1.0, (s / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) as hi from g""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    """Confidence interval of a share."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("s"), F.count("*").alias("n")).withColumn("w", N.wilson("s", "n"))
    return g.select("event_type", F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


_METRICS = ("clusters_per_person", "pair_precision", "pair_recall", "apart_precision", "face_px", "text_precision", "text_recall", "text_f1", "captions_good", "precision_at_k", "grounding", "network_share", "slowest_share")
_SHARES = "st as (select event_type stage, round(sum(value), 3) as seconds, event_type in ('error', 'purchase') network from events group by 1)"
_QUALITY = f"""m1 as ({SQL['fragmentation']}), m2 as ({SQL['pairwise_scores']}), m3 as ({SQL['cannot_link_precision']}), m4 as ({AGG_SQL['text_confusion']}), m5 as ({AGG_SQL['likert']}), m6 as ({RET_SQL['precision_at_k']}), m7 as ({SQL['story_scores']}), {_SHARES}, {DETECTIONS},
metrics as (select 'clusters_per_person' metric, mean v from m1 union all select 'pair_precision', precision from m2 union all select 'pair_recall', recall from m2 union all select 'apart_precision', precision from m3
 union all select 'face_px', cast(median(least(x2 - x1, y2 - y1)) as double) from det union all select 'text_precision', precision from m4 union all select 'text_recall', recall from m4 union all select 'text_f1', f1 from m4
 union all select 'captions_good', round(avg(share_good), 6) from m5 union all select 'precision_at_k', round(avg(precision), 6) from m6 union all select 'grounding', round(avg(grounding), 6) from m7
 union all select 'network_share', round(sum(seconds) filter (where network) / sum(seconds), 6) from st union all select 'slowest_share', round(max(seconds) filter (where not network) / sum(seconds) filter (where not network), 6) from st)"""


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(metric, value): the figures of every evaluation in one long table, one row each; each comes from its own query."""
    det = detections(spark, d).agg(F.median(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("face_px"))
    st = table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("seconds")).withColumn("network", F.col("event_type").isin("error", "purchase"))
    net, own = F.when(F.col("network"), F.col("seconds")), F.when(~F.col("network"), F.col("seconds"))
    rows = one_row(
        fragmentation(spark, d).select(F.col("mean").alias("clusters_per_person")),
        pairwise_scores(spark, d).select(F.col("precision").alias("pair_precision"), F.col("recall").alias("pair_recall")),
        cannot_link_precision(spark, d).select(F.col("precision").alias("apart_precision")), det,
        text_confusion(spark, d).select(F.col("precision").alias("text_precision"), F.col("recall").alias("text_recall"), F.col("f1").alias("text_f1")),
        likert(spark, d).agg(F.round(F.avg("share_good"), 6).alias("captions_good")), precision_at_k(spark, d).agg(F.round(F.avg("precision"), 6).alias("precision_at_k")),
        story_scores(spark, d).agg(F.round(F.avg("grounding"), 6).alias("grounding")),
        st.agg(F.round(F.sum(net) / F.sum("seconds"), 6).alias("network_share"), F.round(F.max(own) / F.sum(own), 6).alias("slowest_share")),
    )
    return rows.select(*[F.col(m).cast("double") for m in _METRICS]).unpivot([], list(_METRICS), "metric", "value")


@register(with_sql(_QUALITY) + "select metric, round(v, 6) as value from metrics")
def system_report(spark: SparkSession, d: str) -> DataFrame:
    """All figures of quality and cost by name."""
    return quality_metrics(spark, d).select("metric", F.round("value", 6).alias("value"))


#: Which figure, beyond which bound, is a finding of which area and weight. A bound of none holds for every figure that exists.
_RULES = [
    ("clusters_per_person", ">", 1.5, "identity grouping", "high"), ("face_px", "<", 64.0, "source resolution", "medium"), ("text_recall", "<", 0.95, "text recognition", "medium"), ("captions_good", "<", 0.8, "captioning", "medium"),
    ("precision_at_k", "<", 0.9, "semantic search", "medium"), ("precision_at_k", ">=", 0.9, "semantic search", "info"), ("grounding", "<", 0.6, "narration grounding", "high"), ("network_share", ">", 0.2, "cost profile", "medium"), ("slowest_share", ">", 0.0, "local compute", "info"),
]
#: Findings that no figure decides.
_STANDING = [("scope", "info"), ("generalization", "info")]
_FIRES = " or ".join(f"(metric = '{m}' and v {o} {t} and area = '{a}' and severity = '{w}')" for m, o, t, a, w in _RULES)
_RULE_ROWS = ", ".join(f"('{m}', '{a}', '{w}')" for m, _, _, a, w in _RULES)


@register(with_sql(_QUALITY) + f"select area, severity, metric, round(v, 6) as value from metrics join (values {_RULE_ROWS}) r(metric, area, severity) using (metric) where {_FIRES} union all select 'grouping precision', 'info', 'apart_precision', round(c.v, 6) from metrics c, metrics p where c.metric = 'apart_precision' and c.v >= 0.98 and p.metric = 'pair_precision' and p.v > 0 and p.v < 0.9 union all select area, severity, null, null from (values ('scope', 'info'), ('generalization', 'info')) s(area, severity)")
def derived_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings: every figure against a table of rules, one rule on two figures, and the standing limits.

    The two-figure rule is met where people seen together are kept apart (here from 98 %) although pairs are wrong otherwise.
    """
    m = quality_metrics(spark, d)
    rules = spark.createDataFrame(_RULES, "metric string, op string, bound double, area string, severity string")
    fires = F.expr("(op = '>' and value > bound) or (op = '<' and value < bound) or (op = '>=' and value >= bound)")
    found = m.join(F.broadcast(rules), "metric").where(fires).select("area", "severity", "metric", F.round("value", 6).alias("value"))
    two = m.where("metric in ('apart_precision', 'pair_precision')").groupBy().pivot("metric", ["apart_precision", "pair_precision"]).agg(F.max("value"))
    two = two.where("apart_precision >= 0.98 and pair_precision > 0 and pair_precision < 0.9").select(F.lit("grouping precision").alias("area"), F.lit("info").alias("severity"), F.lit("apart_precision").alias("metric"), F.round("apart_precision", 6).alias("value"))
    standing = spark.createDataFrame(_STANDING, "area string, severity string").select("area", "severity", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
    return found.unionByName(two).unionByName(standing)


#: Which sources each report is made from.
_SOURCES = {"ocr": ("caption", "note"), "scene": ("caption", "ocr", "speech"), "story": ("scene", "timeline"), "timeline": ("scene",)}
_MADE = ", ".join(f"('{r}', '{x}')" for r, xs in _SOURCES.items() for x in xs)


@register(f"with t as (select source, max(created_at) tm from documents group by 1), m as (select * from (values {_MADE}) v(report, source)) select m.report, list(m.source order by m.source) as newer from m join t r on r.source = m.report join t s on s.source = m.source where s.tm > r.tm + interval 1 second group by 1")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Reports that are older than something they are made from by more than a second, with what is newer."""
    made = spark.createDataFrame([(r, x) for r, xs in _SOURCES.items() for x in xs], "report string, source string")
    return stale_reports(table(spark, d, "documents").groupBy("source").agg(F.max("created_at").alias("at")), made)


def stale_reports(times: DataFrame, made: DataFrame) -> DataFrame:
    """(report, newer ARRAY<STRING>): times: (source, at) of reports and sources, made: (report, source). What has no time is left out."""
    of = lambda name, at: F.broadcast(times.select(F.col("source").alias(name), F.col("at").alias(at)))
    late = made.join(of("report", "__r"), "report").join(of("source", "__s"), "source").where("__s > __r + interval 1 second")
    return late.groupBy("report").agg(F.array_sort(F.collect_set("source")).alias("newer"))


_GRAMS = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"


@register(with_sql("l as (select distinct lower(story_segment) s from frame_metadata where story_segment is not null)", f"t as (select doc_id, coalesce(text, '') x, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') w, list_transform(regexp_extract_all(coalesce(text, ''), '\\b(\\d{{1,2}}:[0-5]\\d)\\b', 1), lambda x: cast(split_part(x, ':', 1) as int) * 60 + cast(split_part(x, ':', 2) as int)) s, {_CW('text')} c from documents where source in ('story', 'timeline'))", "r as (select video_id, string_agg(coalesce(caption, ''), ' ' order by frame_id) ref from (select distinct on (frame_id) frame_id, video_id, caption from frame_metadata where frame_id is not null order by frame_id, caption) where video_id is not null group by 1)", f"q as (select video_id, list_distinct(regexp_extract_all(lower(ref), '[a-z]+')) q from r)")
    + f"""select doc_id, len(regexp_extract_all(x, '\\S+')) as words, len(s) as times, coalesce(round(len(list_filter(range(1, len(s)), lambda i: s[i] <= s[i + 1])) / nullif(greatest(0, len(s) - 1), 0), 6), 1.0) as chronology,
  round((select avg(cast(contains(lower(x), l.s) as int)) from l), 6) as coverage, case when len(w) < 3 then 0 else round(len(list_distinct({_GRAMS})) / (len(w) - 2), 6) end as distinct_3, case when len(c) = 0 then 0 else round(len(list_intersect(c, q)) / len(c), 6) end as grounding
from t join (select doc_id, video_id from documents) using (doc_id) join q using (video_id)""")
def story_report(spark: SparkSession, d: str) -> DataFrame:
    """All figures of a story in one row: words, cited times, their order, chapters named, distinct three-word windows, grounding in its video's captions."""
    labels = table(spark, d, "frame_metadata").where("story_segment is not null").agg(F.collect_set(F.lower("story_segment")).alias("labels"))
    ref = frames(spark, d, "video_id", "caption").where("video_id is not null").select("video_id", F.explode(X.content_words("caption", 1)).alias("w")).groupBy("video_id").agg(F.collect_set("w").alias("q"))
    t = table(spark, d, "documents").where("source in ('story', 'timeline')").select("doc_id", "video_id", X.filled("text").alias("x")).join(ref, "video_id").crossJoin(F.broadcast(labels))
    t = t.withColumn("w", X.word_list("x")).withColumn("s", X.cited_seconds("x")).withColumn("c", X.content_words("x"))
    rising = F.expr("size(filter(sequence(1, greatest(1, size(s) - 1)), i -> size(s) > 1 and s[i - 1] <= s[i]))")
    grams = F.expr("transform(sequence(0, size(w) - 3), i -> concat_ws(' ', slice(w, i + 1, 3)))")
    return t.select(
        "doc_id", F.regexp_count("x", F.lit(r"\S+")).alias("words"), F.size("s").alias("times"), F.coalesce(F.round(N.ratio(rising, F.expr("greatest(0, size(s) - 1)")), 6), F.lit(1.0)).alias("chronology"),
        F.round(F.size(F.filter("labels", lambda n: F.contains(F.lower("x"), n))) / F.size("labels"), 6).alias("coverage"), F.when(F.size("w") < 3, F.lit(0.0)).otherwise(F.round(F.size(F.array_distinct(grams)) / (F.size("w") - 2), 6)).alias("distinct_3"),
        F.when(F.size("c") == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect("c", "q")) / F.size("c"), 6)).alias("grounding"),
    )
