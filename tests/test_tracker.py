"""The tracker on stated cases, and the stream against the table."""

import os
import random

import numpy as np

from framewright.operators.joins import adopt_tracks
from framewright.streaming.tracker import Tracker, track_boxes, track_stream

BOX = ("x1", "y1", "x2", "y2")
SCHEMA = "crop string, video string, frame long, x1 double, y1 double, x2 double, y2 double, score double"


def at(x, y=0.0, size=10.0):
    return np.array([[x, y, x + size, y + size]], float)


def test_steps():
    t = Tracker(max_gap=3)
    one = np.ones(1)
    assert t.step(0, at(0), one) == [None] and t.step(1, at(2), one) == [0]  # named from its second box on
    assert t.step(2, at(4), one * 0.2) == [0]  # a weak box goes on with a track
    assert t.step(3, at(100), one * 0.2) == [None] and len(t.name) == 1  # but opens none
    assert t.step(5, at(10), one) == [0]  # predicted over missing frames
    assert t.step(4, at(10), one) == [None]  # a frame that is past
    assert t.step(9, at(18), one) == [None] and t.name.tolist() == [1]  # the gap is too long
    two = np.vstack([at(20), at(60)])
    assert t.step(10, two, np.ones(2)) == [1, None] and t.step(11, two[::-1], np.ones(2)) == [2, 1]
    assert t.step(12, np.empty((0, 4)), np.empty(0)) == []


def _rows(videos=3):
    rng = random.Random(6)
    rows = []
    for v in range(videos):
        for p in range(4):
            x = rng.uniform(0, 50)
            for f in range(0, 60):
                x += 1.5
                if rng.random() < 0.85 and not 30 < f < 30 + 9 * (p == 0):
                    rows.append((f"v{v}f{f:02d}p{p}", f"v{v}", f, x, 100.0 * p, x + 20, 100.0 * p + 20, rng.choice([0.9, 0.8, 0.3])))
    return rows


def test_stream_tracks_as_the_table_does(spark, tmp_path):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = {r.crop: r.track_id for r in track_boxes(df, "video", "frame", "crop", BOX, "score", max_gap=5).collect()}
    assert len(whole) == len(rows)
    # A track keeps to one person, and hardly anyone has more than a few.
    people = {}
    for c, t in whole.items():
        if t:
            people.setdefault(t, set()).add(c[0:2] + c[-1])
    assert all(len(p) == 1 for p in people.values()) and len(people) < 30
    src = str(tmp_path / "src")
    os.mkdir(src)
    stream = track_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), "video", "frame", "crop", BOX, "score", max_gap=5)
    for lo, hi in ((0, 20), (20, 21), (21, 60)):
        spark.createDataFrame([r for r in rows if lo <= r[2] < hi], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    streamed = {r.crop: r.track_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    same = lambda names: {c: min(x for x, n in names.items() if n == t) if t else None for c, t in names.items()}
    assert same(streamed) == same(whole)


def test_every_box_has_a_track_after_adoption(spark):
    df = spark.createDataFrame(_rows(1), SCHEMA)
    named = df.join(track_boxes(df, "video", "frame", "crop", BOX, "score"), "crop")
    out = {r.crop: r.track_id for r in adopt_tracks(named, "crop", "frame", "track_id", BOX).collect()}
    assert len(out) == df.count() and all(out.values())


def test_adoption_cases(spark):
    schema = "k string, f long, t string, x1 double, y1 double, x2 double, y2 double"
    rows = [("a", 0, None, 0.0, 0.0, 10.0, 10.0), ("b", 1, "t5", 1.0, 0.0, 11.0, 10.0), ("c", 0, None, 50.0, 0.0, 60.0, 10.0), ("d", 5, None, 0.0, 0.0, 1.0, 1.0), ("e", 1, None, 50.0, 0.0, 60.0, 10.0), ("f", None, None, 0.0, 0.0, 1.0, 1.0), (None, 1, "t9", 0.0, 0.0, 10.0, 10.0), ("g", 1, "t6", 1.0, 0.0, 11.0, 10.0)]
    df = spark.createDataFrame(rows, schema)
    got = dict(adopt_tracks(df, "k", "f", "t", ("x1", "y1", "x2", "y2")).collect())
    assert got == {"a": "t6", "b": "t5", "c": "s0", "d": "s1", "e": "s2", "f": "s3", "g": "t6"}
    assert adopt_tracks(df.where("1 = 0"), "k", "f", "t", ("x1", "y1", "x2", "y2")).count() == 0
