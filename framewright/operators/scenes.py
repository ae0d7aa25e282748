"""Scenes out of frames: cuts, chapters, keyframes, what is seen and read in them, and their digest as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators.sequences import scene_cuts
from framewright.operators.vectors import mean_vector
from framewright.session import cut


def frequent_distinct(df: DataFrame, by: list[str], text: str, order: str, limit: int) -> DataFrame:
    """(by, texts): distinct stripped non-empty texts of a group, the most frequent first, of equals the one met first."""
    c = df.select(*by, X.stripped(text).alias("t"), F.col(order).alias("o")).where("t <> ''").groupBy(*by, "t").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o", "t")))
    return c.groupBy(*by).agg(F.transform(F.slice(best, 1, limit), lambda x: x["t"]).alias("texts"))


def build_scenes(frames: DataFrame, by: str, order: str, time: str, vector: str, ocr: str, caption: str, faces: str, threshold: float = 0.70, min_sec: float = 4.0, width: float = 600.0, texts: int = 5) -> DataFrame:
    """One row per scene: (by, scene, chapter_index, chapter_label, is_card, start_sec, end_sec, n_frames, start_frame, end_frame, keyframe, face_ids, ocr_texts, caption, captions).

    Frames are cut where vectors change or title cards begin and end (see ``scene_cuts``). A card scene opens a chapter that bears the first
    text of it that names a line; before the first card it is Introduction. The keyframe is the one nearest to the scene's mean vector, the
    first of equals. A card scene's only text is its label, other scenes keep the most frequent texts that read like signage. Rows with
    a null ``by`` or ``order`` count for nothing; orders are unique within ``by``.
    """
    f = frames.select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(time).alias("t"), F.col(vector).alias("v"), F.col(ocr).alias("ocr"), F.col(caption).alias("caption"), F.col(faces).alias("faces"))
    f = f.where("g is not null and o is not null").withColumn("card", X.is_title_card("ocr", "caption"))
    f = cut(scene_cuts(f, "g", "o", "t", "v", "card", threshold, min_sec, width))
    key = ["g", "scene"]
    named = F.when(F.col("ocr").rlike(X.TITLE_CARD), X.stripped("ocr"))
    base = f.groupBy(*key).agg(
        F.min_by("card", "o").alias("is_card"), F.min_by(named, F.when(named.isNotNull(), F.col("o"))).alias("named"), F.min_by("t", "o").alias("start_sec"), F.max_by("t", "o").alias("end_sec"),
        F.count("*").alias("n_frames"), F.min("o").alias("start_frame"), F.max("o").alias("end_frame"),
    )
    w = Window.partitionBy("g").orderBy("scene").rowsBetween(Window.unboundedPreceding, 0)  # over one row per scene
    label = F.last(F.when(F.col("is_card"), F.coalesce("named", F.lit("Introduction"))), ignorenulls=True).over(w)
    base = base.withColumn("chapter_index", F.greatest(F.lit(0), F.sum(F.col("is_card").cast("int")).over(w) - 1).cast("int")).withColumn("chapter_label", F.coalesce(label, F.lit("Introduction"))).drop("named")
    whole = f.withColumn("s", F.struct("g", "scene"))
    mean = mean_vector(whole, "s", "v")
    near = whole.join(mean, "s").withColumn("near", F.round(N.dot("v", "mean"), 9))
    keyframe = near.groupBy("s").agg(F.max_by("o", F.struct("near", -F.col("o"))).alias("keyframe")).select("s.*", "keyframe")
    people = f.select(*key, F.explode("faces").alias("p")).groupBy(*key).agg(F.array_sort(F.collect_set("p")).alias("face_ids"))
    signs = frequent_distinct(f.where(X.is_signage("ocr")), key, "ocr", "o", texts).withColumnRenamed("texts", "signs")
    captions = frequent_distinct(f, key, "caption", "o", texts).withColumnRenamed("texts", "captions")
    out = base
    for part in (keyframe, people, signs, captions):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("g").alias(by), "scene", "chapter_index", "chapter_label", "is_card", "start_sec", "end_sec", "n_frames", "start_frame", "end_frame", "keyframe", F.coalesce("face_ids", none).alias("face_ids"),
        F.when(F.col("is_card"), F.array("chapter_label")).otherwise(F.coalesce("signs", none)).alias("ocr_texts"), F.coalesce(F.get("captions", F.lit(0)), F.lit("")).alias("caption"), F.coalesce("captions", none).alias("captions"),
    )


def digest_entry(description: Column | None = None) -> Column:
    """A scene as text: one line for a card, else its span, chapter and size, what is seen, what is read if anything, and who is there.

    The layout is a fixed value that prompts and their replies rely on. description: replaces the caption where it isn't null.
    """
    span = F.concat(F.lit("["), N.minutes_seconds("start_sec"), F.lit("-"), N.minutes_seconds("end_sec"), F.lit("]"))
    card = F.concat(span, F.lit(' TITLE CARD: "'), F.col("chapter_label"), F.lit('"'))
    seen = F.col("caption") if description is None else F.coalesce(description, F.col("caption"))
    head = F.concat(span, F.lit(" scene "), F.col("scene").cast("string"), F.lit(" ("), F.col("chapter_label"), F.lit(", "), F.col("n_frames").cast("string"), F.lit("s)"))
    read = F.when(F.size("ocr_texts") > 0, F.concat(F.lit("  on-screen text: "), F.array_join("ocr_texts", "; ")))
    faces = F.concat(F.lit("  recurring faces present: "), F.when(F.size("face_ids") > 0, F.array_join("face_ids", ", ")).otherwise(F.lit("none")))
    return F.when(F.col("is_card"), card).otherwise(F.concat_ws("\n", head, F.concat(F.lit("  visual: "), seen), read, faces))


def digests(scenes: DataFrame, by: str, descriptions: DataFrame | None = None) -> DataFrame:
    """(by, digest, n_scenes): the entries of each video's scenes in order; descriptions: (by, scene, description), one per scene."""
    s = scenes if descriptions is None else scenes.join(descriptions.select(by, "scene", "description"), [by, "scene"], "left")
    line = s.select(by, "scene", digest_entry(None if descriptions is None else F.col("description")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene", "line"))), lambda x: x["line"]), "\n")
    return line.groupBy(by).agg(text.alias("digest"), F.count("*").alias("n_scenes"))


_SECTIONS = "Give every title card a section of its own, in the order of the cards, under a heading of the form '## ' and the card's label. Cite at least one time of each section as m:ss."
_LEAD = "What follows lists the scenes of a video from first to last.\n\n"
#: Ways of asking for a story from a digest, each with the same demand for sections.
STRATEGIES = {
    "zero_shot": (_LEAD, f"\n\nTell the whole video as one connected story. {_SECTIONS}"),
    "few_shot": (
        _LEAD,
        '\n\nTwo examples show how much detail is wanted.\n\n[2:00-2:03] TITLE CARD: "Harbour Line"\n[2:04-2:20] scene 7 (Harbour Line, 17s)\n  visual: a tram stops at a kerb\n  recurring faces present: none\n\nbecomes\n\n## Harbour Line\nAt 2:00 the Harbour Line is announced, and from 2:04 a tram stands at the kerb.'
        '\n\n[9:30-9:41] scene 12 (Harbour Line, 12s)\n  visual: people wait under a roof\n  on-screen text: PIER GATE\n  recurring faces present: Face_03\n\nbecomes\n\nAt 9:30 people wait under the roof of Pier Gate, Face_03 among them.'
        f"\n\nNow tell the whole video. {_SECTIONS}",
    ),
    "chain_of_thought": (_LEAD, f"\n\nReason first, between <thinking> and </thinking>: which cards there are, what happens between them, what holds the video together. Only what comes after </thinking> is used; put the finished story there. {_SECTIONS}"),
    "structured_role": (
        "You write the narration of a documentary. " + _LEAD,
        f"\n\nNarrate the video in the order of its times.\n- Never tell a later moment before an earlier one.\n- Claim nothing that the list doesn't say.\n- Name a station only where its name is read on screen.\n- Don't build every sentence alike.\n- {_SECTIONS}\n- Begin with the first heading and add nothing after the last section.",
    ),
}
SUMMARY = (_LEAD, "\n\nSum up the video in 150 to 200 words of prose without headings or lists: the main events, the most telling scenes, and what the video is a record of.")
TIMELINE = (_LEAD, '\n\nAnswer with a JSON array and nothing else. Each element is an object with the keys "timestamp", a time of the list as m:ss, and "description", at most 12 words. Give two or three events per line, cards included, in rising order of time, none after the end at ')


def prompts(digest: DataFrame, by: str, end_sec: str | None = None) -> DataFrame:
    """(by, kind, prompt): a prompt per strategy and one for the summary; with ``end_sec`` also one for the timeline."""
    kinds = {**STRATEGIES, "summary": SUMMARY}
    made = [F.struct(F.lit(k).alias("kind"), F.concat(F.lit(a), F.col("digest"), F.lit(b)).alias("prompt")) for k, (a, b) in kinds.items()]
    if end_sec:
        made.append(F.struct(F.lit("timeline").alias("kind"), F.concat(F.lit(TIMELINE[0]), F.col("digest"), F.lit(TIMELINE[1]), N.minutes_seconds(end_sec), F.lit(".")).alias("prompt")))
    return digest.select(by, F.explode(F.array(*made)).alias("x")).select(by, "x.kind", "x.prompt")
