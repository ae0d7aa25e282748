"""Queries over presence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.intervals import periods_and_gaps
from framewright.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of every known face of ``identities``; ``unknown`` is compared without case and blanks."""
    known = table(spark, d, "identities").where("face_id is not null and lower(trim(face_id)) not in ('unknown', '')")
    return periods_and_gaps(known, "face_id", "first_sec", "last_sec").withColumnRenamed("entity", "face_id")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
with s as (
  select face_id, cast(round(first_sec * 1000) as bigint) a, cast(round(last_sec * 1000) as bigint) b
  from identities where face_id is not null and lower(trim(face_id)) not in ('unknown', '')
    and first_sec is not null and last_sec is not null and not isnan(first_sec) and not isnan(last_sec)),
v as (select distinct * from s where a <= b),
m as (select *, max(b) over (partition by face_id order by a, b rows between unbounded preceding and 1 preceding) m from v),
i as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by face_id order by a, b) k from m),
p as (select face_id, k, min(a) f, max(b) t from i group by face_id, k)
select face_id, 'period' as kind, f as from_ms, t as to_ms from p
union all
select face_id, 'gap', t, n from (select face_id, t, lead(f) over (partition by face_id order by f) n from p) where n is not null
""",
}
