"""The seams to models, with stand-ins for the models that SQL can repeat; stages and their records."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import seams as M
from framewright.operators.models import memoised
from framewright.operators.stages import Stages, fingerprint, guarded
from framewright.plans.base import FRAMES, Registry, frames, with_sql
from framewright.sources.artifacts import local_path
from framewright.sources.tables import require_columns, table

register = Registry()
QUERIES, SQL = register.queries, register.sql


def _faces():
    def run(b: pd.DataFrame) -> pd.DataFrame:
        n = b.face_ids.map(lambda x: 0 if x is None else len(x)).to_numpy()
        at = np.repeat(b.frame_id.to_numpy(), n)
        pos = np.concatenate([np.arange(k) for k in n]) if len(n) else np.empty(0, int)
        side = 20 + (at * 7 + pos * 13) % 60
        return pd.DataFrame({"frame_id": at, "pos": pos, "x1": 0, "y1": 0, "x2": side, "y2": side + 5, "det_score": (at % 10) / 10, "blur_var": (at % 50).astype(float), "nose_offset": (pos % 4) / 4}).astype({"pos": "int32", "x1": "int32", "y1": "int32", "x2": "int32", "y2": "int32"})

    return run


@register(with_sql(FRAMES, "p as (select frame_id, unnest(range(len(face_ids))) pos from frames where face_ids is not null)", "s as (select *, 20 + (frame_id * 7 + pos * 13) % 60 side from p)")
    + "select printf('f%06d_%02d', frame_id, pos) as crop_id, frame_id, side as x2, side + 5 as y2, cast(frame_id % 10 / 10 >= 0.6 and frame_id % 50 >= 25 and pos % 4 / 4 <= 0.75 as int) as quality_ok from s where side >= 36")
def face_seam(spark: SparkSession, d: str) -> DataFrame:
    """Faces through the detection seam: small ones dropped, crops named, the quality gate set."""
    f = frames(spark, d, "face_ids").select("frame_id", "face_ids")
    return M.detect_faces(f, _faces).select("crop_id", "frame_id", F.col("x2").cast("long").alias("x2"), F.col("y2").cast("long").alias("y2"), "quality_ok")


def _sharper():
    return lambda b: pd.DataFrame({"crop_id": b.crop_id, "vector": [None if v is None else [2.0 * x for x in v] for v in b.vector]})


@register("select 'c' || vec_id as crop_id, round(cast(embedding[1] as double) * case when least(20 + vec_id % 90, 30 + vec_id % 70) < 64 then 2 else 1 end, 6) as first from embeddings")
def enlarged_seam(spark: SparkSession, d: str) -> DataFrame:
    """Small crops are embedded again after super-resolution, others keep their vectors."""
    c = table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("crop_id"), (20 + F.col("vec_id") % 90).alias("width"), (30 + F.col("vec_id") % 70).alias("height"), F.col("embedding").cast("array<double>").alias("vector"))
    return M.enlarge_small(c, _sharper).select("crop_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def _reader():
    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, i, w, float((k * 31 + i * 17) % 101)) for k, t in zip(b.frame_id, b.ocr_text) for i, w in enumerate((t or "").split(" "))]
        return pd.DataFrame(rows, columns=["frame_id", "pos", "word", "confidence"]).astype({"frame_id": "int64", "pos": "int32"})

    return run


@register(with_sql(FRAMES, "w as (select frame_id, unnest(range(len(string_split(coalesce(ocr_text, ''), ' ')))) pos, unnest(string_split(coalesce(ocr_text, ''), ' ')) word from frames)", "k as (select *, cast((frame_id * 31 + pos * 17) % 101 as double) c from w)", "g as (select frame_id, string_agg(word, ' ' order by pos) t, count(*) n, round(avg(c), 1) m from k where c >= 60 and length(word) >= 3 and regexp_matches(word, '\\p{L}') group by 1)")
    + "select frame_id, coalesce(t, '') as text, coalesce(n, 0) as n_tokens, coalesce(m, 0.0) as mean_conf from (select distinct frame_id from frames) left join g using (frame_id)")
def text_seam(spark: SparkSession, d: str) -> DataFrame:
    """Tokens through the reading seam: gated, joined in order, the empty text where none is kept."""
    return M.read_text(frames(spark, d, "ocr_text").select("frame_id", "ocr_text"), _reader)


def _captioner():
    return lambda b: pd.DataFrame({"frame_id": b.frame_id, "caption": [None if k % 5 == 0 else f" frame {k} of {v} " for k, v in zip(b.frame_id, b.video_id)]})


@register(with_sql(FRAMES) + "select frame_id, case when frame_id % 5 = 0 then '' else 'frame ' || frame_id || ' of ' || coalesce(video_id, 'None') end as caption from frames")
def caption_seam(spark: SparkSession, d: str) -> DataFrame:
    """Captions through the seam; a frame that gives none has the empty text."""
    return M.caption_frames(frames(spark, d, "video_id").select("frame_id", "video_id"), _captioner)


def _embedder():
    return lambda b: pd.DataFrame({"doc_id": b.doc_id, "vector": [None if not t else [float(len(t)), float(t.count("a")), 1.0] for t in b.text]})


@register("with v as (select doc_id, cast(length(text) as double) n, cast(length(text) - length(replace(text, 'a', '')) as double) a from documents where coalesce(text, '') <> '') select doc_id, round(n / (sqrt(n * n + a * a + 1) + 1e-9), 6) as x, round(a / (sqrt(n * n + a * a + 1) + 1e-9), 6) as y from v")
def embedding_seam(spark: SparkSession, d: str) -> DataFrame:
    """Texts through the embedding seam: vectors of length one, none for what can't be read."""
    return M.embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", _embedder).select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


def _listener():
    return lambda b: pd.DataFrame({"video_id": b.video_id, "start": b.timestamp_sec, "end": b.timestamp_sec + 1.0, "text": b.speech})


@register(with_sql(FRAMES, "s as (select video_id, timestamp_sec, trim(coalesce(speech, ''), e' \\t\\n\\r') t from frames)", "k as (select *, count(*) over (partition by video_id, lower(t)) n from s where t <> '' and lower(t) not in ('you', 'thank you.', '.'))") + 'select video_id, timestamp_sec as "start", t as text from k where n < 6')
def speech_seam(spark: SparkSession, d: str) -> DataFrame:
    """Segments through the speech seam, without blanks, fillers and loops."""
    return M.transcribe(frames(spark, d, "video_id", "timestamp_sec", "speech").select("video_id", "timestamp_sec", "speech"), _listener).select("video_id", "start", "text")


@register("with q as (select cache_key k, min(prompt) p from llm_cache where cache_key is not null group by 1), c as (select cache_key k, max(response) r from llm_cache where request_id % 2 = 0 and cache_key is not null group by 1) select k as cache_key, case when c.k is not null then r else 'echo ' || coalesce(length(p), 0) end as response from q left join c using (k)")
def language_seam(spark: SparkSession, d: str) -> DataFrame:
    """Recorded replies by key; the rest, each once, through the language model's seam."""
    llm = table(spark, d, "llm_cache")
    return memoised(llm.select("cache_key", "prompt"), llm.where("request_id % 2 = 0").select("cache_key", "response"), "cache_key", "prompt", "response", lambda: lambda p: f"echo {len(p or '')}")


_NEEDED = {"documents": ["doc_id", "text", "author"], "identities": ["track_id", "face_id"], "llm_cache": ["request_id", "prompt", "seed"]}
_NEEDS = ", ".join(f"('{t}', '{c}')" for t, cs in _NEEDED.items() for c in cs)


@register(f"select t as \"table\", list(c order by c) as missing from (values {_NEEDS}) n(t, c) where not exists (select 1 from duckdb_columns() where table_name = t and column_name = c) group by 1")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tables that lack a column that a stage needs, by the check that stages make before they plan anything."""
    rows = []
    for name, columns in _NEEDED.items():
        df, lacking = table(spark, d, name), []
        for c in sorted(columns):
            try:
                require_columns(df, [c], name)
            except ValueError:
                lacking.append(c)
        if lacking:
            rows.append((name, lacking))
    return spark.createDataFrame(rows, "table string, missing array<string>")


@register("select * from (values ('first', 'detect', true), ('again', 'detect', false), ('other settings', 'detect', true), ('output gone', 'detect', true), ('forced', 'detect', true), ('after detect', 'cluster', true)) v(\"case\", stage, runs)")
def stage_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Which stages of a pipeline run again, and why: by their outputs, settings, force, or a stage before them."""
    rows = []
    # The record is the driver's own; it lies in the shared folder beside the tables.
    folder = Path(local_path(spark, "stages").removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True)
    out, s = folder / "faces.csv", Stages(folder / "stages.json")
    size = {"det_size": 640}
    rows.append(("first", "detect", s.stale("detect", [out], size)))
    with s.run("detect", size):
        out.write_text("crop_id\n")
    rows.append(("again", "detect", s.stale("detect", [out], size)))
    rows.append(("other settings", "detect", s.stale("detect", [out], size | {"det_size": 1024})))
    rows.append(("forced", "detect", s.stale("detect", [out], size, force=True)))
    rows.append(("after detect", "cluster", s.stale("cluster", [out], {}, upstream=True)))
    out.unlink()
    rows.append(("output gone", "detect", s.stale("detect", [out], size)))
    return spark.createDataFrame(rows, "case string, stage string, runs boolean")


@register("select * from (values ('frames', true), ('broken', false), ('documents', true)) v(job, done)")
def guarded_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations of which one fails: the others still give their results."""
    found = guarded({"frames": lambda: frames(spark, d).limit(1).count(), "broken": lambda: require_columns(table(spark, d, "nation"), ["nothing"]), "documents": lambda: table(spark, d, "documents").limit(1).count()})
    return spark.createDataFrame([(k, v is not None) for k, v in found.items()], "job string, done boolean")


@register("select request_id, substr(md5(format('{{\"max_tokens\": {}, \"temperature\": {}}}', coalesce(cast(m as varchar), 'null'), coalesce(printf('%.1f', t), 'null'))), 1, 12) as fingerprint from (select distinct request_id, params.max_tokens m, params.temperature t from llm_cache where request_id is not null)")
def settings_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the settings of each request, the same whatever the order of the settings."""
    @F.pandas_udf("string")
    def digest(m: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([fingerprint({"temperature": None if pd.isna(b) else float(b), "max_tokens": None if pd.isna(a) else int(a)}) for a, b in zip(m, t)], dtype=object)

    return table(spark, d, "llm_cache").where("request_id is not null").selectExpr("request_id", "params.max_tokens as m", "params.temperature as t").distinct().select("request_id", digest("m", "t").alias("fingerprint"))
