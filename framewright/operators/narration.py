"""Assembly and checks of texts: scenes, digests, sections, timelines, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X


def without_reasoning(c) -> Column:
    """A reply without what comes before the last closing tag of its reasoning."""
    return F.regexp_replace(F.regexp_replace(X.filled(c), r"(?is)^.*</thinking>", ""), r"^\s+|\s+$", "")


def sections(df: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """(key, label, body): the parts of a text under headings of level 1 to 3 that are in ``labels``; text before the first is Introduction."""
    lines = df.select(key, F.posexplode(F.split(X.filled(text), r"\r?\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^\s*#{1,3}\s+(.*?)\s*$", 1)
    lines = lines.withColumn("opens", F.when(head.isin(*labels), head))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("label", F.coalesce(F.last("opens", ignorenulls=True).over(w), F.lit("Introduction"))).where("opens is null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "label").agg(F.regexp_replace(body, r"^\s+|\s+$", "").alias("body")).where("body <> ''")


def _items(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, pos, item): the elements of the first JSON array of each reply, as text."""
    a = df.select(key, F.from_json(X.json_array_python(F.col(reply)), "array<string>").alias("a")).where("a is not null")
    return a.select(key, F.posexplode("a").alias("pos", "item"))


def _field(item: str, name: str):
    return F.regexp_replace(X.filled(F.get_json_object(item, f"$.{name}")), r"^\s+|\s+$", "")


def timeline_checked(df: DataFrame, key: str, reply: str, max_sec) -> DataFrame:
    """(key, events ARRAY<STRUCT<sec, timestamp, description>>, problems ARRAY<STRING>): a timeline reply made usable, one row per key with an array.

    An element counts if it is an object with a time m:ss within 0 and ``max_sec`` (a number or column) and a description; others give a
    problem each, in order. Events out of order are sorted, elements of the same time staying in order, which gives a problem
    too. Keys are unique; a reply without a JSON array gives no row.
    """
    top = F.lit(max_sec) if isinstance(max_sec, (int, float)) else F.col(max_sec)
    kept = [] if isinstance(max_sec, (int, float)) else [max_sec]
    items = _items(df, key, reply)
    if kept:
        items = items.join(df.select(key, *kept), key)
    e = items.withColumn("__object", X.filled("item").startswith("{")).withColumn("__at", F.get_json_object("item", "$.timestamp")).withColumn("__sec", N.parse_minutes_seconds("__at")).withColumn("__text", _field("item", "description"))
    at = X.filled("__at")
    problem = (
        F.when(~F.col("__object"), F.concat(F.lit("not an object: "), X.filled("item"))).when(F.col("__sec").isNull(), F.concat(F.lit("unparseable timestamp: "), at))
        .when(F.col("__sec") > top, F.concat(F.lit("timestamp out of range: "), at)).when(F.col("__text") == "", F.concat(F.lit("empty description at "), at))
    )
    e = e.withColumn("__problem", problem)
    good = F.when(F.col("__problem").isNull(), F.struct("pos", "__sec", "__text"))
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(good)).alias("__good"), F.array_sort(F.collect_list(F.when(F.col("__problem").isNotNull(), F.struct("pos", "__problem")))).alias("__bad"))
    secs = F.transform("__good", lambda x: x["__sec"])
    ordered = secs == F.array_sort(secs)
    # The place in the reply decides between equal times.
    events = F.array_sort(F.transform("__good", lambda x: F.struct(x["__sec"].alias("sec"), x["pos"].alias("pos"), N.minutes_seconds(x["__sec"]).alias("timestamp"), x["__text"].alias("description"))))
    events = F.transform(events, lambda x: F.struct(x["sec"], x["timestamp"], x["description"]))
    late = F.when(~ordered, F.array(F.lit("events were not in order of time (sorted)"))).otherwise(F.array().cast("array<string>"))
    return g.select(key, events.alias("events"), F.concat(F.transform("__bad", lambda x: x["__problem"]), late).alias("problems"))


def batch_items(df: DataFrame, key: str, reply: str, expected: DataFrame | Column, index: str = "scene_index", text: str = "description") -> DataFrame:
    """(key, index INT, description): the items of a batch reply, bare, fenced or within prose, whose index was asked for.

    expected: (key, index), each once, or a condition on the two where a rule says what was asked for. Items that are no objects, whose
    index is missing or no whole number (of 32 bits), or whose text is blank count for nothing; of several with one index the last counts.
    """
    e = _items(df, key, reply).where(F.col("item").startswith("{")).select(key, "pos", F.get_json_object("item", f"$.{index}").alias("__i"), _field("item", text).alias("__text"))
    # A number with a fraction is cut to a whole one, as text it must be a whole number.
    e = e.withColumn("__index", F.when(F.trim("__i").rlike(r"^[+-]?\d+$"), F.trim("__i").try_cast("int")).when(F.col("__i").rlike(r"^-?\d+\.\d+$"), F.col("__i").cast("double").try_cast("int"))).where("__index is not null and __text <> ''")
    last = e.groupBy(key, F.col("__index").alias(index)).agg(F.max_by("__text", "pos").alias("description"))
    if isinstance(expected, Column):
        return last.where(expected)
    # Spark does not foresee how many rows lists of indices give, and would broadcast any number.
    return last.join(expected.select(key, index).hint("merge"), [key, index], "left_semi")


def timeline_events(df: DataFrame, key: str, reply: str, max_sec: float) -> DataFrame:
    """(key, timestamp, sec, description): usable events of a JSON reply in order: a time of the form m:ss within range and a description."""
    kind = "array<struct<timestamp:string,description:string>>"
    e = df.select(key, F.from_json(X.json_array_python(F.col(reply)), kind).alias("a")).where("a is not null")
    e = e.select(key, F.posexplode("a").alias("pos", "x")).select(key, "pos", "x.timestamp", F.regexp_replace(X.filled("x.description"), r"^\s+|\s+$", "").alias("description"))
    return e.withColumn("sec", N.parse_minutes_seconds("timestamp")).where((F.col("sec") <= max_sec) & (F.col("description") != "")).select(key, "timestamp", "sec", "description")


def grounded_text(df: DataFrame, key: str, text: str, reference: str, least: float = 0.20, min_words: int = 4) -> DataFrame:
    """(key, text, dropped): the text without sentences of ``min_words`` content words or more that the reference hardly has.

    Lines stay lines; blank lines and headings stay as they are, and a line all of whose sentences are dropped goes. Keys are unique.
    """
    lines = df.select(key, F.col(reference).alias("ref"), F.posexplode(F.split(X.filled(text), r"\r?\n")).alias("pos", "line"))
    plain = F.regexp_replace("line", r"^\s+|\s+$", "")
    whole = (plain == "") | F.startswith(plain, F.lit("#"))
    s = lines.withColumn("__whole", whole).select(key, "ref", "pos", "__whole", F.posexplode(F.when(F.col("__whole"), F.array("line")).otherwise(F.split("line", r"(?<=[.!?])\s+"))).alias("at", "s"))
    w, r = X.content_words("s"), X.content_words("ref", 1)
    keep = F.col("__whole") | (F.size(w) < min_words) | (F.size(F.array_intersect(w, r)) / F.size(w) >= least)
    s = s.withColumn("__keep", keep)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__keep"), F.struct("at", "s")))), lambda x: x["s"]), " ")
    per = s.groupBy(key, "pos").agg(kept.alias("line"), F.count_if("__keep").alias("n"), F.count_if(~F.col("__keep")).alias("lost"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return per.groupBy(key).agg(body.alias("text"), F.sum("lost").alias("dropped"))
