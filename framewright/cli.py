"""Search from the command line: python -m framewright.cli QUERY --folder DIR [--captions] [--regex] [--fuzzy] [--semantic | --visual | --fused] [--top-k N] [--no-group]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.functions.numeric import minutes_seconds, unit
from framewright.operators.encoder import encode_texts, fit_encoder, query_vector
from framewright.operators.reports import html_table, markdown_table
from framewright.operators.search import rank_by_vector, reciprocal_rank_fusion, search
from framewright.operators.sequences import islands
from framewright.plans.base import frames
from framewright.session import cut, get_spark
from framewright.sources.tables import table

#: Frames found by text whose pictures' mean is the query of a visual search.
EXAMPLES = 5


def by_meaning(spark: SparkSession, folder: str, query: str, top_k: int) -> DataFrame:
    """(frame_id, score, rank): frames whose caption and text mean most nearly what the query does."""
    f = frames(spark, folder, "caption", "ocr_text").select("frame_id", X.joined_document("caption", "ocr_text").alias("document"))
    encoder = fit_encoder(f, "document")
    return rank_by_vector(encode_texts(f, "frame_id", "document", encoder), "frame_id", "vector", query_vector(encoder, query), top_k, 0.2)


def by_picture(spark: SparkSession, folder: str, examples: DataFrame, top_k: int) -> DataFrame:
    """(frame_id, score, rank): frames whose pictures are most like the mean of the examples'."""
    i = table(spark, folder, "image_index").where("frame_ids is not null and size(embeddings) = 64 and not exists(embeddings, x -> x is null or isnan(x)) and exists(embeddings, x -> x <> 0)")
    i = cut(i.groupBy(F.col("frame_ids").alias("frame_id")).agg(unit(F.max("embeddings")).alias("v")))
    rows = i.join(examples, "frame_id").orderBy("rank").limit(EXAMPLES).collect()
    mean = [sum(x) / len(rows) for x in zip(*(r.v for r in rows))] if rows else []
    return rank_by_vector(i, "frame_id", "v", mean, top_k, 0.2)


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    p.add_argument("--folder", required=True)
    p.add_argument("--captions", action="store_true", help="search captions too")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--semantic", action="store_true", help="rank frames by meaning, with an encoder trained on their texts")
    p.add_argument("--visual", action="store_true", help="rank frames by picture, like those that the text finds")
    p.add_argument("--fused", action="store_true", help="both rankings in one")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--no-group", action="store_true", help="one row per frame instead of time ranges")
    p.add_argument("--html", action="store_true", help="a table for browsers instead of Markdown")
    a = p.parse_args(args)
    spark = get_spark()
    show = html_table if a.html else markdown_table
    rows = frames(spark, a.folder, "video_id", "timestamp_sec", "filename", "ocr_text", "caption", "face_ids")
    faces = F.when(F.size("face_ids") > 0, F.array_join("face_ids", ", ")).otherwise(F.lit("-")).alias("faces")
    if a.semantic or a.visual or a.fused:
        many = a.top_k if a.semantic and not a.fused else max(50, a.top_k)
        found = cut(by_meaning(spark, a.folder, a.query, many))
        if a.visual or a.fused:
            pictures = by_picture(spark, a.folder, found, many)
            found = reciprocal_rank_fusion([found, pictures], "frame_id") if a.fused else pictures
        best = found.orderBy(F.desc("score"), "frame_id").limit(a.top_k).select("frame_id", F.round("score", 3).alias("score"))
        hits = best.join(rows, "frame_id").orderBy(F.desc("score"), "frame_id")
        return show(hits.select("video_id", minutes_seconds("timestamp_sec").alias("time"), "score", "filename", faces, X.shortened(X.joined_document("caption", "ocr_text")).alias("snippet")), a.top_k)
    hits = search(rows, a.query, ("ocr_text", "caption") if a.captions else ("ocr_text",), regex=a.regex, fuzzy=a.fuzzy)
    by, order = ["video_id"], ["timestamp_sec", "frame_id"]
    if a.no_group:
        out = hits.select("video_id", "timestamp_sec", minutes_seconds("timestamp_sec").alias("time"), "filename", faces, "field", "snippet")
    else:
        g = islands(hits, by, order, lambda p: (F.col("snippet") != p["snippet"]) | (F.col("field") != p["field"]) | (F.col("timestamp_sec") - p["timestamp_sec"] > 2.5), ["snippet", "field", "timestamp_sec"])
        first = F.struct(*order)
        seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("face_ids"))))
        g = g.groupBy("video_id", "island").agg(F.min("timestamp_sec").alias("timestamp_sec"), F.max("timestamp_sec").alias("end_sec"), F.count("*").alias("frames"), F.min_by("field", first).alias("field"), F.min_by("snippet", first).alias("snippet"), seen.alias("face_ids"))
        out = g.select("video_id", "timestamp_sec", minutes_seconds("timestamp_sec").alias("start"), minutes_seconds("end_sec").alias("end"), "frames", faces, "field", "snippet")
    return show(out.orderBy("video_id", "timestamp_sec"), a.top_k)


if __name__ == "__main__":
    print(main())
