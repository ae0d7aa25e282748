"""Problem 2: reviewed pairs of ``merge_candidates`` become groups of faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.components import components
from framewright.sources.tables import table

#: The verdicts that confirm a pair, after trimming and lower-casing.
CONFIRMING = ("same", "y", "yes", "1", "true")
#: White space at the ends of hand-typed values.
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _plain(column: str) -> F.Column:
    return F.lower(F.regexp_replace(F.col(column), _ENDS, ""))


def confirmed_groups(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """(group_id, face_id) of every face that a confirming verdict links to another, as spelt in ``identities``.

    Null, blank and ``unknown`` faces link nothing. A face that ``identities`` doesn't have keeps its trimmed spelling
    with the case of its smallest form in the pairs. Empty tables give no rows.
    """
    pairs = candidates.where(_plain("verdict").isin(*CONFIRMING)).select(_plain("face_a").alias("a"), _plain("face_b").alias("b"), "face_a", "face_b")
    for side in ("a", "b"):
        pairs = pairs.where(f"{side} is not null and {side} not in ('', 'unknown')")
    found = components(pairs.select("a", "b"), "a", "b")
    typed = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("member"), F.col("face_a").alias("w")), F.struct(F.col("b").alias("member"), F.col("face_b").alias("w")))))
    typed = typed.groupBy("member").agg(F.min(F.regexp_replace("w", _ENDS, "")).alias("typed"))
    spelt = identities.where("face_id is not null").groupBy(_plain("face_id").alias("member")).agg(F.min("face_id").alias("spelt"))
    named = found.join(spelt, "member", "left").join(typed, "member", "left").select("group_id", F.coalesce("spelt", "typed").alias("face_id"))
    least = named.groupBy("group_id").agg(F.min("face_id").alias("least"))
    return named.join(least, "group_id").select(F.col("least").alias("group_id"), "face_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two or more faces that confirmed pairs connect."""
    return confirmed_groups(table(spark, d, "merge_candidates"), table(spark, d, "identities"))


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
with recursive i as (select lower(trim(face_id, e' \\t\\n\\r')) k, min(face_id) face_id from identities where face_id is not null group by 1),
c as (select lower(trim(face_a, e' \\t\\n\\r')) a, lower(trim(face_b, e' \\t\\n\\r')) b from merge_candidates
      where lower(trim(verdict, e' \\t\\n\\r')) in ('same', 'y', 'yes', '1', 'true')),
e as (select x.face_id a, y.face_id b from c join i x on x.k = c.a join i y on y.k = c.b
      where c.a <> c.b and c.a <> 'unknown' and c.b <> 'unknown'),
g as (select a, b from e union select b, a from e),
r as (select a as face_id, a as label from g union select g.b, r.label from r join g on g.a = r.face_id)
select min(label) as group_id, face_id from r group by face_id
""",
}
