"""The places where models enter: what each gets, what it must give, and what is done with it. Models are passed in as loaders.

A loader runs once per Python worker and task and returns a function from a batch of rows to a batch of rows; recorded results of a former
run take the place of the model wherever they are.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import text as X
from framewright.operators.models import apply_model

Loader = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def detect_faces(frames: DataFrame, load: Loader, min_px: int = 36, min_score: float = 0.60, min_blur: float = 25.0, max_turn: float = 0.75) -> DataFrame:
    """(crop_id, frame_id, x1, y1, x2, y2, det_score, blur_var, nose_offset, quality_ok): the model's boxes that are large enough, numbered within
    their frame in the model's order, with the quality gate.

    The model gets (frame_id, ...) and gives (frame_id, pos, x1, y1, x2, y2, det_score, blur_var, nose_offset), one row per face.
    """
    d = apply_model(frames, load, "frame_id long, pos int, x1 int, y1 int, x2 int, y2 int, det_score double, blur_var double, nose_offset double")
    d = d.where((F.col("x2") - F.col("x1") >= min_px) & (F.col("y2") - F.col("y1") >= min_px))
    good = (F.col("det_score") >= min_score) & (F.col("blur_var") >= min_blur) & (F.col("nose_offset") <= max_turn)
    return d.select(F.format_string("f%06d_%02d", "frame_id", "pos").alias("crop_id"), "frame_id", "x1", "y1", "x2", "y2", "det_score", "blur_var", "nose_offset", good.cast("int").alias("quality_ok"))


def enlarge_small(crops: DataFrame, load: Loader, below_px: int = 64) -> DataFrame:
    """(crop_id, vector): vectors of super-resolved crops where a side is under ``below_px``, for these only; others keep theirs.

    crops: (crop_id, width, height, vector, ...); the model gets the small ones and gives (crop_id, vector).
    """
    small = F.least("width", "height") < below_px
    fresh = apply_model(crops.where(small), load, "crop_id string, vector array<double>")
    return crops.where(~small).select("crop_id", F.col("vector").cast("array<double>").alias("vector")).unionByName(fresh)


def read_text(frames: DataFrame, load: Loader, min_confidence: float = 60.0) -> DataFrame:
    """(frame_id, text, n_tokens, mean_conf): kept tokens of each frame in order; a frame without any has the empty text.

    The model gets (frame_id, ...) and gives (frame_id, pos, word, confidence), one row per token.
    """
    w = apply_model(frames, load, "frame_id long, pos int, word string, confidence double").where(X.keep_token("word", "confidence", min_confidence))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    kept = w.groupBy("frame_id").agg(text.alias("text"), F.count("*").alias("n_tokens"), F.round(F.avg("confidence"), 1).alias("mean_conf"))
    return frames.select("frame_id").distinct().join(kept, "frame_id", "left").select("frame_id", X.filled("text").alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("mean_conf", F.lit(0.0)).alias("mean_conf"))


def caption_frames(frames: DataFrame, load: Loader) -> DataFrame:
    """(frame_id, caption): a caption per frame, the empty text where the model gives none. The model gives (frame_id, caption)."""
    c = apply_model(frames, load, "frame_id long, caption string")
    return frames.select("frame_id").distinct().join(c, "frame_id", "left").select("frame_id", X.stripped("caption").alias("caption"))


def embed(rows: DataFrame, key: str, load: Loader) -> DataFrame:
    """(key, vector of length one): one vector per row that the model can read. The model gives (key, vector)."""
    kind = rows.schema[key].dataType.simpleString()
    v = apply_model(rows, load, f"`{key}` {kind}, vector array<double>").where("vector is not null")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return v.select(key, F.transform("vector", lambda x: x / length).alias("vector"))


def transcribe(audio: DataFrame, load: Loader, most_repeats: int = 6, fillers: tuple[str, ...] = ("you", "thank you.", ".")) -> DataFrame:
    """(video_id, start, end, text): speech without blanks, fillers and texts that repeat ``most_repeats`` times or more in a video.

    The model gives (video_id, start, end, text), one row per segment.
    """
    s = apply_model(audio, load, "video_id string, start double, end double, text string").withColumn("text", X.stripped("text"))
    s = s.where((F.col("text") != "") & ~F.lower("text").isin(*fillers)).withColumn("__plain", F.lower("text"))
    loops = s.groupBy("video_id", "__plain").agg(F.count("*").alias("__n")).where(F.col("__n") >= most_repeats)
    return s.join(loops, ["video_id", "__plain"], "left_anti").select("video_id", "start", "end", "text")
