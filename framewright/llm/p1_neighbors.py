"""Problem 1: the frames most similar to every frame of ``image_index``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.neighbors import nearest_neighbors
from framewright.sources.tables import table

DIM = 64


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs frame_a < frame_b of cosine 0.9 or more, one of them being among the ten most similar frames of the other."""
    near = nearest_neighbors(table(spark, d, "image_index"), "frame_ids", "embeddings", DIM, k=10, min_cosine=0.9)
    return near.select(F.least("id", "neighbor").alias("frame_a"), F.greatest("id", "neighbor").alias("frame_b")).distinct()


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
with u as (select frame_ids id, max(embeddings) e from image_index
  where frame_ids is not null and len(embeddings) = 64 and list_bool_and(list_transform(embeddings, lambda x: x is not null and not isnan(x) and not isinf(x)))
    and list_bool_or(list_transform(embeddings, lambda x: x <> 0)) group by 1),
v as (select id, cast(e as double[64]) e from u),
p as (select x.id a, y.id b, array_cosine_similarity(x.e, y.e) c from v x join v y on x.id <> y.id),
r as (select a, b, row_number() over (partition by a order by c desc, b) n from p where c >= 0.9)
select distinct least(a, b) as frame_a, greatest(a, b) as frame_b from r where n <= 10
""",
}
