"""Online association of boxes to tracks: one step per frame, the same for tables and for streams.

A track predicts its box by its last movement. The boxes of a frame are matched in two rounds, those of high confidence first, then the
rest against the tracks that are left; in each round the pairs with the largest overlap come first. A box of high confidence
that finds no track opens one, which bears its name from its second box on; the first one has none yet (see ``adopt_tracks``). A
track that finds no box for more than ``max_gap`` frames ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators.sequences import islands


@dataclass
class Tracker:
    """The state of one video: open tracks as rows of arrays."""

    max_gap: int = 30
    least_overlap: float = 0.3
    high: float = 0.5
    opens: float = 0.5
    following: int = 0
    last_frame: int | None = None
    name: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    box: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    speed: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    seen: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> list[int | None]:
        """The track of each box of a frame; frames must rise, a box of a frame that is past gets none."""
        out: list[int | None] = [None] * len(boxes)
        if self.last_frame is not None and frame <= self.last_frame:
            return out
        self.last_frame = frame
        keep = frame - self.seen <= self.max_gap
        self.name, self.box, self.speed, self.seen = self.name[keep], self.box[keep], self.speed[keep], self.seen[keep]
        predicted = self.box + self.speed * (frame - self.seen)[:, None]
        free = np.ones(len(self.name), bool)
        sure = scores >= self.high
        for wanted in (np.flatnonzero(sure), np.flatnonzero(~sure)):
            for i, t in self._match(boxes[wanted], predicted, free):
                b = wanted[i]
                out[b] = int(self.name[t])
                self.speed[t] = (boxes[b] - self.box[t]) / (frame - self.seen[t])
                self.box[t], self.seen[t] = boxes[b], frame
        born = [b for b in np.flatnonzero(sure & (scores >= self.opens)) if out[b] is None]
        if born:
            self.name = np.append(self.name, np.arange(self.following, self.following + len(born)))
            self.following += len(born)
            self.box = np.vstack([self.box, boxes[born]])
            self.speed = np.vstack([self.speed, np.zeros((len(born), 4))])
            self.seen = np.append(self.seen, np.full(len(born), frame))
        return out

    def _match(self, boxes: np.ndarray, predicted: np.ndarray, free: np.ndarray) -> Iterator[tuple[int, int]]:
        if not len(boxes) or not free.any():
            return
        w = np.clip(np.minimum(boxes[:, None, 2], predicted[None, :, 2]) - np.maximum(boxes[:, None, 0], predicted[None, :, 0]), 0, None)
        h = np.clip(np.minimum(boxes[:, None, 3], predicted[None, :, 3]) - np.maximum(boxes[:, None, 1], predicted[None, :, 1]), 0, None)
        area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        both = w * h
        overlap = np.where(free[None, :], both / (area(boxes)[:, None] + area(predicted)[None, :] - both + 1e-9), 0.0)
        i, t = np.nonzero(overlap >= self.least_overlap)
        taken: set[int] = set()
        for n in np.lexsort((t, i, -overlap[i, t])):
            if i[n] not in taken and free[t[n]]:
                taken.add(i[n])
                free[t[n]] = False
                yield int(i[n]), int(t[n])


def _run(tracker: Tracker, rows: pd.DataFrame, prefix: str) -> pd.DataFrame:
    rows = rows.sort_values(["f", "k"], kind="stable")
    boxes, scores, frames = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows.s.to_numpy(float), rows.f.to_numpy()
    cuts = np.flatnonzero(np.diff(frames)) + 1
    names: list[str | None] = []
    for at in np.split(np.arange(len(rows)), cuts):
        if len(at):
            names += [None if t is None else f"{prefix}{t}" for t in tracker.step(int(frames[at[0]]), boxes[at], scores[at])]
    return pd.DataFrame({"k": rows.k.to_numpy(), "track_id": pd.Series(names, dtype=object).to_numpy()})


def _columns(boxes: DataFrame, by: str, frame: str, key: str, box: tuple[str, str, str, str], score: str) -> DataFrame:
    named = [F.col(c).cast("double").alias(n) for c, n in zip((*box, score), ("x1", "y1", "x2", "y2", "s"))]
    rows = boxes.select(F.col(by).cast("string").alias("g"), F.col(frame).cast("long").alias("f"), F.col(key).alias("k"), *named)
    return rows.where("g is not null and f is not null and k is not null and s is not null and x1 <= x2 and y1 <= y2")


def track_boxes(boxes: DataFrame, by: str, frame: str, key: str, box: tuple[str, str, str, str], score: str, max_gap: int = 30, **settings) -> DataFrame:
    """(key, track_id): the track of each box, null where it has none.

    No track outlives a gap of more than ``max_gap`` frames without any box, so a video is cut at such gaps and its parts are tracked on
    their own; a part is sequential by nature and one task. Rows with a null column or a box that is turned round count for nothing.
    """
    rows = _columns(boxes, by, frame, key, box, score)
    kind = rows.schema["k"].dataType.simpleString()
    rows = islands(rows, ["g"], ["f", "k"], lambda p: F.col("f") - p["f"] > max_gap, ["f"], width=10_000.0, name="part")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _run(Tracker(max_gap, **settings), part, f"{part.g.iloc[0]}.{part.part.iloc[0]}.")

    return rows.groupBy("g", "part").applyInPandas(run, f"k {kind}, track_id string").withColumnRenamed("k", key)


def track_stream(boxes: DataFrame, by: str, frame: str, key: str, box: tuple[str, str, str, str], score: str, max_gap: int = 30, **settings) -> DataFrame:
    """(key, track_id) of a stream: the tracker of each ``by`` is kept as state between batches.

    A frame's boxes must come in one batch and frames must rise from batch to batch; a box of an earlier frame has no track.
    """
    rows = _columns(boxes, by, frame, key, box, score)
    kind = rows.schema["k"].dataType.simpleString()

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(max_gap, **settings)
        found = _run(tracker, pd.concat(list(parts)), f"{group[0]}.")
        state.update((pickle.dumps(tracker),))
        yield found

    out = rows.groupBy("g").applyInPandasWithState(run, f"k {kind}, track_id string", "tracker binary", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)
