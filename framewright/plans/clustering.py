"""Clustering of identities and the graphs behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.operators.clustering import best_shots, complete_linkage, gated_linkage, label_components, shot_linkage
from framewright.operators.clustering import merge_proposals as proposals
from framewright.operators.joins import within
from framewright.operators.tables import numbered, one_row
from framewright.operators.vectors import farthest_within, mean_vector, pairs_within
from framewright.plans.base import DETECTIONS, TRACKS, Registry, detections, tracks, with_sql
from framewright.session import cut
from framewright.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

#: The embeddings are nearly orthogonal, so the limits here are looser than the defaults for faces.
LINK_LIMIT, SHOT_LIMIT, APPEARANCE_LIMIT, FACE_GATE = 0.72, 0.74, 0.70, 0.80
#: Best shots of a cluster that are compared.
SHOTS = 3


@register(with_sql(DETECTIONS) + "select distinct a.track_id as a, b.track_id as b from det a join det b on a.frame_id = b.frame_id and a.track_id < b.track_id")
def cannot_link(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tracks that share a frame."""
    det = detections(spark, d).select("frame_id", "track_id").distinct()
    return det.select("frame_id", F.col("track_id").alias("a")).join(det.select("frame_id", F.col("track_id").alias("b")), "frame_id").where("a < b").select("a", "b").distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", N.unit("embedding").alias("v"))


def _cannot(spark: SparkSession, d: str) -> DataFrame:
    """Constraints: neighbouring ids that share a label never merge."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = within(e.select("label", F.col("vec_id").alias("a")), e.select("label", F.col("vec_id").alias("b")), by="label", left="a", right="b", distance=40.0)
    return near.where("a < b").select("a", "b")


def linked(spark: SparkSession, d: str, limit: float) -> DataFrame:
    nodes = _nodes(spark, d)
    return complete_linkage(nodes, _cannot(spark, d), "vec_id", "v", pairs_within(nodes, "vec_id", "v", limit).select("a", "b"), limit)


#: Rounds of the SQL, in each of which all pairs that are each other's nearest merge; pairs left after them show as a row without a cluster.
_ROUNDS = 26
_NODES = """v as materialized (select vec_id k, list_transform(embedding, lambda x: cast(x as double) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) + 1e-9)) e from embeddings),
dist as materialized (select p.k a, q.k b, round(1 - list_dot_product(p.e, q.e), 9) d from v p join v q on p.k < q.k),
barred as materialized (select p.vec_id a, q.vec_id b from embeddings p join embeddings q on p.label = q.label and p.vec_id < q.vec_id and q.vec_id - p.vec_id <= 40)"""


def _merge_sql(name: str, pairs: str, nodes: str, rounds: int = _ROUNDS) -> str:
    """CTEs that end in {name}(k, c): complete linkage of ``nodes`` (k) over ``pairs`` (a, b, d)."""
    out = [f"{name}_p0 as materialized ({pairs})", f"{name}_l0 as materialized (select k, k c from ({nodes}))"]
    for i in range(rounds):
        p, n = f"{name}_p{i}", f"{name}_{i}"
        out += [
            f"{n}_best as materialized (select u, min((d, a, b)) m from (select a u, d, a, b from {p} union all select b, d, a, b from {p}) group by u)",
            f"{n}_join as materialized (select x.b o, x.a n from {p} x join {n}_best s on s.u = x.a and s.m = (x.d, x.a, x.b) join {n}_best t on t.u = x.b and t.m = (x.d, x.a, x.b))",
            f"{n}_move as materialized (select o, n from {n}_join union all select n, n from {n}_join)",
            f"{name}_p{i + 1} as materialized (select least(ca, cb) a, greatest(ca, cb) b, max(d) d from (select coalesce(s.n, a) ca, coalesce(t.n, b) cb, d, (case when s.n is null then 1 else 2 end) * (case when t.n is null then 1 else 2 end) w from {p} left join {n}_move s on s.o = a left join {n}_move t on t.o = b) where ca <> cb group by 1, 2 having count(*) = max(w))",
            f"{name}_l{i + 1} as materialized (select k, coalesce(n, c) c from {name}_l{i} left join {n}_join on o = c)",
        ]
    return ",\n".join([*out, f"{name} as materialized (select k, c from {name}_l{rounds} union all select null, null from {name}_p{rounds})"])


def _link_sql(name: str, limit: float) -> str:
    return _merge_sql(name, f"select a, b, d from dist where d <= {limit} and (a, b) not in (select (a, b) from barred)", "select k from v")


@register(with_sql(_NODES, _link_sql("c", LINK_LIMIT)) + "select k as vec_id, c as cluster from c")
def linkage(spark: SparkSession, d: str) -> DataFrame:
    """Constrained complete linkage of all vectors."""
    return linked(spark, d, LINK_LIMIT)


def _shots(spark: SparkSession, d: str, first: DataFrame) -> DataFrame:
    """The best shots of each cluster: quality and its gate are derived from the ids."""
    crops = _nodes(spark, d).join(first, "vec_id").withColumn("q", F.col("vec_id") * 7919 % 1000).withColumn("good", F.col("vec_id") % 3 != 0)
    return best_shots(crops, "cluster", "vec_id", "v", "q", "good", SHOTS)


def _apart(spark: SparkSession, d: str, first: DataFrame) -> DataFrame:
    """Constraints between clusters: those of any of their members."""
    of = lambda s: first.select(F.col("vec_id").alias(s), F.col("cluster").alias(f"c{s}"))
    pairs = _cannot(spark, d).join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
    return pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


_SHOT_SQL = f"""shots as materialized (select c, k from (select c, k, row_number() over (partition by c order by k * 7919 % 1000 desc, k) r from (select c, k, k % 3 <> 0 good, bool_or(k % 3 <> 0) over (partition by c) has_good from c) where good or not has_good) where r <= {SHOTS}),
sizes as materialized (select c, count(*) n from shots group by c),
apart as materialized (select distinct least(x.c, y.c) a, greatest(x.c, y.c) b from barred join c x on x.k = a join c y on y.k = b where x.c <> y.c)"""
_FAR_SQL = """select a, b, d from (select least(x.c, y.c) a, greatest(x.c, y.c) b, max(d) d, count(*) n from dist join shots x on x.k = a join shots y on y.k = b where x.c <> y.c and d <= {limit} group by 1, 2) t
  join sizes p on p.c = a join sizes q on q.c = b where t.n = p.n * q.n and (a, b) not in (select (a, b) from apart)"""


@register(with_sql(_NODES, _link_sql("c", LINK_LIMIT), _SHOT_SQL, _merge_sql("m", _FAR_SQL.format(limit=SHOT_LIMIT), "select distinct c k from c")) + "select c.k as vec_id, m.c as merged from c join m on m.k = c.c")
def best_shot_linkage(spark: SparkSession, d: str) -> DataFrame:
    """A second pass over the clusters' best shots, which joins clusters that single members keep apart."""
    first = cut(linked(spark, d, LINK_LIMIT))
    again = shot_linkage(_shots(spark, d, first), first.select("cluster").distinct(), _apart(spark, d, first), SHOT_LIMIT)
    return first.join(again, "cluster").select("vec_id", "merged")


def _appearance(spark: SparkSession, d: str, first: DataFrame) -> DataFrame:
    """Mean vector of each cluster; the tables have no vectors of bodies, so those of the crops stand for them."""
    e = table(spark, d, "embeddings").join(first, "vec_id")
    return mean_vector(e, "cluster", "embedding").select("cluster", F.col("mean").alias("vector"))


@register()
def appearance_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Clusters joined by the distance of their means, if their farthest best shots stay under the gate."""
    first = cut(linked(spark, d, LINK_LIMIT))
    merged = gated_linkage(_appearance(spark, d, first), _shots(spark, d, first), _apart(spark, d, first), APPEARANCE_LIMIT, FACE_GATE)
    return first.join(merged, "cluster").select("vec_id", "merged")


_MEANS_SQL = "dims as (select c, i, avg(cast(e[i] as double)) m from (select c, embedding e, unnest(range(1, 65)) i from c join embeddings on vec_id = k) group by 1, 2), means as materialized (select c, list_transform(list(m order by i), lambda x: x / (sqrt(list_dot_product(list(m order by i), list(m order by i))) + 1e-12)) m from dims group by c)"


@register(with_sql(_NODES, _link_sql("c", LINK_LIMIT), _SHOT_SQL, _MEANS_SQL, f"far as materialized ({_FAR_SQL.format(limit=FACE_GATE)})")
    + f"select a as face_a, b as face_b, round(round(1 - list_dot_product(x.m, y.m), 9), 3) as app_dist, round(d, 3) as face_dist from far join means x on x.c = a join means y on y.c = b where round(1 - list_dot_product(x.m, y.m), 9) <= {APPEARANCE_LIMIT}")
def merge_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clusters proposed for review: alike by means and by farthest best shots, and free of constraints."""
    first = cut(linked(spark, d, LINK_LIMIT))
    found = proposals(_appearance(spark, d, first), _shots(spark, d, first), _apart(spark, d, first), APPEARANCE_LIMIT, FACE_GATE)
    return found.select(F.col("a").alias("face_a"), F.col("b").alias("face_b"), "app_dist", "face_dist")


@register(with_sql(_NODES, _link_sql("c", LINK_LIMIT), "named as (select c, printf('Face_%02d', row_number() over (order by count(*) desc, c)) face_id from c group by c having count(*) >= 2)") + "select k as vec_id, coalesce(face_id, 'unknown') as face_id from c left join named using (c)")
def named_identities(spark: SparkSession, d: str) -> DataFrame:
    """From vectors to names: linkage, corroboration by two members, ranking by size, the rest unknown."""
    c = cut(linked(spark, d, LINK_LIMIT))
    sizes = c.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")
    named = numbered(sizes, [F.desc("n"), F.col("cluster")]).select("cluster", F.format_string("Face_%02d", "rank").alias("face_id"))
    return c.join(named, "cluster", "left").select("vec_id", F.coalesce("face_id", F.lit("unknown")).alias("face_id"))


_SWEEP = (0.60, 0.66, 0.72)


@register(with_sql(_NODES, *[_link_sql(f"s{i}", x) for i, x in enumerate(_SWEEP)]) + " union all ".join(
    f'select cast({x} as double) as "limit", (select count(distinct c) from s{i}) as n_clusters, (select coalesce(round(1 - max(d), 6), 1.0) from dist join s{i} x on x.k = a join s{i} y on y.k = b and x.c = y.c) as worst_cosine' for i, x in enumerate(_SWEEP)))
def link_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and the worst pair within one for several limits; the pairs are found once, for the widest."""
    nodes = cut(_nodes(spark, d))
    pairs = cut(pairs_within(nodes, "vec_id", "v", max(_SWEEP)))
    cannot, out = cut(_cannot(spark, d)), None
    for limit in _SWEEP:
        c = cut(complete_linkage(nodes, cannot, "vec_id", "v", pairs.where(F.col("distance") <= limit).select("a", "b"), limit))
        worst = farthest_within(nodes.join(c, "vec_id"), "cluster", "v").agg(F.coalesce(F.min("cosine"), F.lit(1.0)).alias("worst_cosine"))
        row = one_row(c.agg(F.lit(limit).alias("limit"), F.countDistinct("cluster").alias("n_clusters")), worst)
        out = row if out is None else out.unionByName(row)
    return out


@register(with_sql("""m as (select distinct lower(trim(face_a, e' \\t\\n\\r')) a, lower(trim(face_b, e' \\t\\n\\r')) b from merge_candidates where lower(trim(verdict, e' \\t\\n\\r')) in ('same', 'y', 'yes', '1', 'true') and face_a is not null and face_b is not null)""").replace("with ", "with recursive ")
    + """, g as (select a, b from m union select b, a from m), r as (select a n, a l from g union select g.b, r.l from r join g on g.a = r.n),
ids as (select distinct on (track_id) track_id, face_id from identities)
select track_id, coalesce((select min(l) from r where n = lower(face_id)), lower(face_id)) as merged from ids where face_id is not null""")
def apply_merges(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with their identity after all confirmed merges; a group takes its smallest id (unlike p2, unknown is an id like others)."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    m = table(spark, d, "merge_candidates").where(plain(F.col("verdict")).isin("same", "y", "yes", "1", "true")).where("face_a is not null and face_b is not null").select(plain(F.col("face_a")).alias("a"), plain(F.col("face_b")).alias("b")).distinct()
    nodes = m.select(F.col("a").alias("k")).union(m.select("b")).distinct()
    comp = label_components(m, nodes, "a", "b", "k")
    t = table(spark, d, "identities").where("face_id is not null").select("track_id", F.lower("face_id").alias("k")).dropDuplicates(["track_id"])
    return t.join(comp, "k", "left").select("track_id", F.coalesce("component", "k").alias("merged"))


@register(with_sql(DETECTIONS, TRACKS, "j as (select distinct frame_id, face_id from det join trk using (track_id) where face_id <> 'unknown')") + "select a.face_id as face_a, b.face_id as face_b, count(*) as n_frames from j a join j b on a.frame_id = b.frame_id and a.face_id < b.face_id group by 1, 2")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """In how many frames two identities appear together."""
    j = detections(spark, d).select("frame_id", "track_id").join(tracks(spark, d).where("face_id <> 'unknown'").select("track_id", "face_id"), "track_id").select("frame_id", "face_id").distinct()
    return j.select("frame_id", F.col("face_id").alias("face_a")).join(j.select("frame_id", F.col("face_id").alias("face_b")), "frame_id").where("face_a < face_b").groupBy("face_a", "face_b").agg(F.count("*").alias("n_frames"))
