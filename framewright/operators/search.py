"""Lexical, vector and fused search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X


def search(df: DataFrame, query: str | None, fields: tuple[str, ...] = ("ocr_text",), regex: bool = False, fuzzy: bool = False, cutoff: float = 0.8) -> DataFrame:
    """Rows of ``df`` that match, with (field, score, snippet): the first field that matches, its hits, a window around the first.

    A literal without case by default; ``regex`` replaces that, ``fuzzy`` adds a hit of score 1 where a token is close to a word of the
    query. A blank query gives no rows; null texts never match.
    """
    q = (query or "").strip()
    if not q:
        return df.withColumns({"field": F.lit(""), "score": F.lit(0), "snippet": F.lit("")}).where("1 = 0")
    near = X.fuzzy_match_python(q, cutoff) if fuzzy and not regex else None
    options = []
    for f in fields:
        hits = F.regexp_count(X.filled(f), F.lit("(?i)" + q)) if regex else X.occurrences(f, q)
        score = hits if near is None else F.when(hits > 0, hits).when(near(X.filled(f)), F.lit(1)).otherwise(F.lit(0))
        options.append(F.when(score > 0, F.struct(F.lit(f).alias("field"), score.cast("int").alias("score"), X.snippet(f, q).alias("snippet"))))
    return df.withColumn("__hit", F.coalesce(*options)).where("__hit is not null").select(*df.columns, "__hit.*")


def rank_by_vector(index: DataFrame, key: str, vector: str, query: list[float], top_k: int = 20, min_score: float = 0.2, digits: int = 6) -> DataFrame:
    """(key, score, rank): the top_k rows by inner product with the query, those under ``min_score`` dropped afterwards.

    Rows with a null key or vector, or a vector of another length than the query's, don't rank; an empty query ranks none.
    """
    if not query:
        return index.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("1 = 0")
    q = F.array(*[F.lit(float(x)) for x in query])
    s = index.where(F.col(key).isNotNull() & (F.size(vector) == len(query))).select(key, F.round(N.dot(F.col(vector), q), digits).alias("score"))
    top = s.orderBy(F.desc("score"), key).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).where(F.col("score") >= min_score)


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): sum of 1 / (k + rank) over rankings (key, rank), ranks from 1."""
    both = reduce(DataFrame.unionByName, [r.select(key, "rank") for r in rankings])
    return both.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
