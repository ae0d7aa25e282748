"""Runs of near-identical consecutive events, by optimal segmentation per entity.

The events of an entity are ordered by time and cut into runs so that the dissimilarity of neighbours within runs, plus a
penalty for each boundary, is least, while no event of a run is farther than DRIFT from the run's first one; forced boundaries cost
nothing. So a text that changes little from frame to frame until nothing of it is left is no single event: it is cut where the
changes are largest. A dynamic program over prefixes finds the optimum. A start whose run has drifted too far, or that a forced
boundary cuts off, can never be a last boundary again and is dropped; of the others the best is at hand, since the order of two
starts doesn't change with the end.

An entity is spread over time chunks: the program runs within a chunk, and runs that meet at a chunk's end are joined by
the same program on the two events that meet there, from one row per chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut

#: Seconds per chunk of an entity.
CHUNK_SEC = 3600.0
#: Cost of a boundary; a neighbour's dissimilarity is 1 where a quarter of the characters is misread.
PENALTY = 1.0
#: Share of characters that may be misread, and seconds between neighbours of a run.
MISREAD, MAX_GAP_SEC = 0.25, 10.0
#: Dissimilarity that an event may have from the first one of its run: two readings of one text are each within 1 of it.
DRIFT = 2.0


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is larger; a column of the table is kept as two bit vectors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for ch in b:
        eq = where.get(ch, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 | 1, less << 1
        rise = eq | down
        up, down = (less | ~(rise | more)) & full, more & rise & full
    return min(score, most + 1)


@lru_cache(maxsize=1 << 16)
def text_dissimilarity(a: str, na: str, b: str, nb: str, most: float = 1.0) -> float:
    """0 for equal texts, 1 where MISREAD of the longer one is misread, infinite beyond ``most``, for another number or a text against none."""
    if a == b and na == nb:
        return 0.0
    if na != nb or not a or not b:
        return float("inf")
    longest = max(len(a), len(b))
    edits = int(longest * MISREAD * most)
    d = edit_distance(a, b, edits)
    return float("inf") if d > edits else d / (longest * MISREAD)


def segment(cost: np.ndarray, forced: np.ndarray, penalty: float = PENALTY, fits: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """Sorted first positions of the runs of n events; cost[i] and forced[i] concern the neighbours i - 1 and i.

    Minimises the sum of ``cost`` within runs plus ``penalty`` per unforced boundary over all cuts into runs whose every event i
    ``fits(start, i)``; equal totals prefer fewer boundaries. A boundary at an infinite cost counts as forced.
    """
    if not len(cost):
        return np.empty(0, int)
    # A neighbour that costs nothing is the same event, which never opens a run in an optimum with the fewest boundaries.
    may = np.flatnonzero(forced | (cost != 0))
    may = may if len(may) and may[0] == 0 else np.concatenate([[0], may])
    cost, forced = cost[may], forced[may]
    n = len(cost)
    wall = forced | ~np.isfinite(cost)
    within = np.cumsum(np.where(wall, 0.0, cost))
    within -= within[0]
    # Per start its total before it less the cost up to it: what is added later is the same for all starts.
    heap: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    checked = np.arange(n)
    back, number = np.zeros(n + 1, int), np.zeros(n + 1, int)
    first = 0
    for last in range(n):
        if wall[last] and last:
            first = last
        while True:
            key, runs, start = heap[0]
            if start >= first:
                at = int(checked[start])
                while at < last and (fits is None or fits(int(may[start]), int(may[at + 1]))):
                    at += 1
                checked[start] = at
                if at == last:
                    break
            heapq.heappop(heap)
        total = key + within[last]
        back[last + 1], number[last + 1] = start, runs + 1
        if last + 1 < n:
            step = 0.0 if wall[last + 1] else penalty
            heapq.heappush(heap, (round(total + step - within[last + 1], 9), runs + 1, last + 1))
    starts, e = [], n
    while e > 0:
        starts.append(back[e])
        e = back[e]
    return may[np.array(starts[::-1])]


def _neighbour_costs(texts: list[tuple], gap: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Costs and forced boundaries between neighbours; same: which events are known to have the texts of the one before."""
    blank = np.array([not any(x) for x in texts], bool)
    forced = (gap > MAX_GAP_SEC) | blank
    forced[1:] |= blank[:-1]
    forced[:1] = False
    cost = np.zeros(len(texts))
    compare = ~forced if same is None else ~forced & ~same
    compare[:1] = False
    for i in np.flatnonzero(compare):
        p, q = texts[i - 1], texts[i]
        cost[i] = max(text_dissimilarity(p[0], p[1], q[0], q[1]), text_dissimilarity(p[2], p[3], q[2], q[3]))
    return cost, forced


def _fits(texts: list[tuple]) -> Callable[[int, int], bool]:
    def fits(start: int, i: int) -> bool:
        p, q = texts[start], texts[i]
        return text_dissimilarity(p[0], p[1], q[0], q[1], DRIFT) <= DRIFT and text_dissimilarity(p[2], p[3], q[2], q[3], DRIFT) <= DRIFT

    return fits


def _plain(column: str) -> F.Column:
    """Letters and digits of a text, lower-cased; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", "")


def _numbers(column: str) -> F.Column:
    """The numbers of a text in order."""
    return F.concat_ws(" ", F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(\p{Nd}+)"), 1))


def collapse_runs(df: DataFrame, entity: str, key: str, time: str, text_a: str, text_b: str, chunk_sec: float = CHUNK_SEC) -> DataFrame:
    """One row per run: (entity, first_key, last_key, n_events BIGINT, from_sec, to_sec, duration_sec DOUBLE).

    Order within an entity is by time, then key. Repeats of a key at one time count once, with the least of their texts; a key at two
    times is two events. Rows with a null entity, key or time,
    or a NaN time count for nothing; null texts are empty ones. An event with neither text is a run of its own with an
    empty first text and is left out, and so ends the run before it. An empty table gives no rows; other columns
    are not read.
    """
    kind, key_kind = df.schema[entity].dataType.simpleString(), df.schema[key].dataType.simpleString()
    rows = (
        df.select(F.col(entity).alias("e"), F.col(key).alias("k"), F.col(time).cast("double").alias("t"), _plain(text_a).alias("a"), _numbers(text_a).alias("na"), _plain(text_b).alias("b"), _numbers(text_b).alias("nb"))
        .where("e is not null and k is not null and t is not null and not isnan(t)")
        .withColumn("chunk", F.floor(F.col("t") / chunk_sec))
    )
    out = f"e {kind}, chunk long, run int, runs int, first_key {key_kind}, last_key {key_kind}, n long, from_sec double, to_sec double, blank boolean, head array<string>, tail array<string>"

    def runs(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("t", "k", "a", "b")]))
        if rows.num_rows > 1:
            new = pc.or_(pc.not_equal(rows["k"][1:], rows["k"][:-1]), pc.not_equal(rows["t"][1:], rows["t"][:-1]))
            rows = rows.filter(pa.chunked_array([pa.array([True]), *new.chunks]).combine_chunks())
        rows = rows.combine_chunks()
        texts = list(zip(*(rows[c].to_pylist() for c in ("a", "na", "b", "nb"))))
        t = rows["t"].to_numpy()
        same_texts = np.zeros(len(t), bool)
        same_texts[1:] = np.logical_and.reduce([pc.equal(rows[c][1:], rows[c][:-1]).to_numpy() for c in ("a", "na", "b", "nb")])
        start = segment(*_neighbour_costs(texts, np.diff(t, prepend=t[:1]), same_texts), fits=_fits(texts))
        end = np.append(start[1:], len(t)) - 1
        n = len(start)
        same = lambda c: rows[c].take([0] * n)
        texts_at = lambda i, at: pa.array([list(texts[i]) if j == at else None for j in range(n)], pa.list_(pa.string()))
        return pa.table(
            {
                "e": same("e"), "chunk": same("chunk"), "run": pa.array(range(n), pa.int32()), "runs": pa.array([n] * n, pa.int32()), "first_key": rows["k"].take(start), "last_key": rows["k"].take(end), "n": pa.array(end - start + 1, pa.int64()),
                "from_sec": pa.array(t[start]), "to_sec": pa.array(t[end]), "blank": pa.array([not any(texts[i]) for i in start]),
                "head": texts_at(0, 0), "tail": texts_at(-1, n - 1),  # only the ends of a chunk are compared again
            }
        )

    local = cut(rows.groupBy("e", "chunk").applyInArrow(runs, out))
    # One row per chunk decides whether its first run goes on from the chunk before; runs are joined by a running start.
    edge = local.groupBy("e", "chunk").agg(
        F.min_by(F.struct("head", "from_sec"), "run").alias("h"), F.max_by(F.struct("tail", "to_sec"), "run").alias("l"), F.first("runs").alias("runs")
    )
    w = Window.partitionBy("e").orderBy("chunk")
    edge = edge.withColumn("p", F.lag("l").over(w))

    @F.pandas_udf("boolean")
    def same(head: pd.Series, tail: pd.Series, gap: pd.Series) -> pd.Series:
        found = []
        for h, l, g in zip(head, tail, gap):
            if l is None or g is None or g != g:
                found.append(False)
                continue
            cost, forced = _neighbour_costs([tuple(l), tuple(h)], np.array([0.0, g]))
            found.append(len(segment(cost, forced)) == 1)
        return pd.Series(found, dtype=bool)

    edge = edge.withColumn("joined", same(F.col("h.head"), F.col("p.tail"), F.col("h.from_sec") - F.col("p.to_sec")))
    # The run open at a chunk's end began in this chunk unless the chunk is one run that goes on from before.
    edge = edge.withColumn("own", F.expr("if(runs > 1 or not joined, chunk, null)")).withColumn("begin", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    at = edge.select("e", "chunk", "joined", "begin", F.coalesce(F.lead("joined").over(w), F.lit(False)).alias("goes_on"))
    named = local.drop("head", "tail").join(at, ["e", "chunk"]).withColumn("home", F.expr("if(run = 0 and joined, begin, chunk)"))
    # Within its home chunk a run that goes on is the last one: all its parts are named by home chunk and -1.
    named = named.withColumn("name", F.expr("if((run = runs - 1 and goes_on) or (run = 0 and joined), -1, run)"))
    merged = named.groupBy("e", "home", "name").agg(
        F.min_by("first_key", "chunk").alias("first_key"), F.max_by("last_key", "chunk").alias("last_key"), F.sum("n").alias("n_events"),
        F.min("from_sec").alias("from_sec"), F.max("to_sec").alias("to_sec"), F.min_by("blank", "chunk").alias("blank"),
    )
    return merged.where(~F.col("blank")).select(F.col("e").alias("entity"), "first_key", "last_key", "n_events", "from_sec", "to_sec", (F.col("to_sec") - F.col("from_sec")).alias("duration_sec"))
