"""Exact vector search and vector aggregates.

Two sides meet block by block: each is cut into blocks by a hash of its keys, a row is sent to every block of the other side, and a task
holds one pair of blocks. So nothing is collected or broadcast, the work is one shuffle whatever the sizes, and a task's memory is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut

#: Rows of a block on average; a task compares one pair of blocks in slices of SLICE_ROWS.
LEFT_ROWS, RIGHT_ROWS, SLICE_ROWS = 4096, 16384, 512
#: Rows per pivot of a search within a distance, pivots at most, and rows of a sub-block of a cell.
PIVOT_ROWS, MAX_PIVOTS, CELL_BLOCK = 2048, 1024, 4096


def _by_length(t: pa.Table, vector: str = "v") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of a table's vectors by their length; vectors with a null are left out."""
    v = t.column(vector).combine_chunks()
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        whole = ~np.isnan(x).any(axis=1)
        out[int(n)] = at[whole], x[whole]
    return out


def block_join(left: DataFrame, right: DataFrame, key_left: str, key_right: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """``run`` on every pair of a block of ``left`` and a block of ``right``."""
    nl, nr = max(1, -(-left.count() // left_rows)), max(1, -(-right.count() // right_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__a", F.pmod(F.xxhash64(key_left), F.lit(nl)).cast("int")).withColumn("__b", every(nr))
    b = right.withColumn("__b", F.pmod(F.xxhash64(key_right), F.lit(nr)).cast("int")).withColumn("__a", every(nl))
    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(run, schema)


def top_neighbors(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, digits: int = 6, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """(key, neighbor, score, rank): exactly the k largest inner products of each query with the base, itself left out.

    A stated query set against all rows, block by block; a task keeps k per query. Scores are rounded to ``digits``; equal ones rank by
    key. Null keys and vectors, and vectors with a null or NaN or of another length than the query's count for nothing. Copies of a row
    with one key count once per query.
    """
    kind = base.schema[key].dataType.simpleString()
    side = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))

    def scan(q: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        others = _by_length(b)
        for n, (at, x) in _by_length(q).items():
            if n not in others:
                continue
            ids, names = q.column("k").take(pa.array(at)).to_numpy(zero_copy_only=False), b.column("k").take(pa.array(others[n][0])).to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            names, y = names[order], others[n][1][order]
            for i in range(0, len(x), SLICE_ROWS):
                s = np.round(x[i : i + SLICE_ROWS] @ y.T, digits)
                s[ids[i : i + SLICE_ROWS, None] == names[None, :]] = -np.inf
                # All that reach the k-th score, so that ties at the end are decided by key; columns are in order of keys.
                bar = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                row, col = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
                best = np.lexsort((col, -s[row, col], row))
                row, col = row[best], col[best]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append((ids[i : i + SLICE_ROWS][row[top]], names[col[top]], s[row[top], col[top]]))
        cat = lambda c, t: pa.array(np.concatenate([f[c] for f in found]), t) if found else pa.array([], t)
        return pa.table({"q": cat(0, q.schema.field("k").type), "neighbor": cat(1, q.schema.field("k").type), "score": cat(2, pa.float64())})

    found = block_join(side(queries), side(base), "k", "k", scan, f"q {kind}, neighbor {kind}, score double", left_rows, right_rows)
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "neighbor"))), 1, k).alias("b"))
    out = best.select(F.col("q").alias(key), F.posexplode("b").alias("pos", "x"))
    return out.select(key, F.col("x.neighbor").alias("neighbor"), (-F.col("x.s")).alias("score"), (F.col("pos") + 1).alias("rank"))


def mean_vector(df: DataFrame, by: str, vector: str, weight=None, unit: bool = True) -> DataFrame:
    """(by, mean ARRAY<DOUBLE>): the weighted mean of each group's vectors, scaled to length one; summed per dimension before the shuffle."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    parts = df.where(F.col(vector).isNotNull()).select(by, w.cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    dims = parts.groupBy(by, "__i").agg(F.sum(F.col("__w") * F.col("__x")).alias("__s"), F.sum("__w").alias("__w"))
    vectors = dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", (F.col("__s") / F.col("__w")).alias("__m")))), lambda x: x["__m"]).alias("mean"))
    if not unit:
        return vectors
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return vectors.select(by, F.transform("mean", lambda x: x / length).alias("mean"))


def pairs_within(df: DataFrame, key: str, vector: str, max_distance: float, digits: int = 9, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(a, b, distance): all pairs a < b of unit vectors whose cosine distance is at most ``max_distance``; only these leave a task.

    Exact. Rows go to the cell of their nearest pivot, of a bounded sample; two cells are compared, block by block, unless the angle between
    their pivots less the widest angles within them rules out such a pair. What counts is as in top_neighbors; repeated keys count once.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    total = rows.count()
    wanted = min(MAX_PIVOTS, max(1, total // pivot_rows))
    share = min(1.0, 2.0 * wanted / max(1, total))
    picked = [r.v for r in rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(wanted).collect()]
    picked = [v for v in picked if len(v) == len(picked[0]) and all(x is not None and x == x for x in v)]
    pivots = np.array(picked, np.float64) if picked else np.zeros((1, 1))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    dim = pivots.shape[1]

    def assign(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            # Vectors of another length than the pivots' have a cell of their own per length.
            for n, (at, x) in _by_length(t).items():
                if n == dim:
                    s = (x @ pivots.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    cell = s.argmax(axis=1)
                    angle = np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1))
                else:
                    cell, angle = np.full(len(at), -n), np.zeros(len(at))
                part = t.take(pa.array(at))
                yield from pa.table({"k": part["k"], "v": part["v"], "cell": pa.array(cell, pa.int64()), "angle": pa.array(angle, pa.float64())}).to_batches()

    item = df.schema[vector].dataType.simpleString()
    placed = cut(rows.mapInArrow(assign, f"k {kind}, v {item}, cell long, angle double"))
    cells = placed.groupBy("cell").agg(F.max("angle").alias("width"), F.count("*").alias("n")).collect()  # as many as pivots and lengths
    blocks = {r.cell: max(1, math.ceil(r.n / CELL_BLOCK)) for r in cells}
    width = {r.cell: r.width for r in cells}
    # The largest angle of a pair, with room for rounding and for vectors that are not quite of length one.
    reach = math.acos(max(-1.0, min(1.0, 1.0 - max_distance))) + 1e-3
    first, offset = {}, 0
    for c in sorted(blocks):
        first[c], offset = offset, offset + blocks[c]
    near = []
    for c in sorted(blocks):
        for o in sorted(blocks):
            apart = 0.0 if c == o else (math.acos(max(-1.0, min(1.0, float(pivots[c] @ pivots[o])))) if c >= 0 and o >= 0 else math.inf)
            if apart - width[c] - width[o] <= reach:
                near.append((c, blocks[c], first[c], first[o], first[o] + blocks[o] - 1))
    met = spark.createDataFrame(near, "cell long, own int, base int, lo int, hi int")
    sent = placed.join(F.broadcast(met), "cell").withColumn("b", F.col("base") + F.pmod(F.xxhash64("k"), "own").cast("int"))
    sent = sent.select("k", "v", "b", F.explode(F.sequence("lo", "hi")).alias("o")).select("k", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def compare(t: pa.Table) -> pa.Table:
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        block = t.column("b").to_numpy()
        found = []
        left = _by_length(t.filter(pa.array(block == p)))
        right = left if p == q else _by_length(t.filter(pa.array(block == q)))
        name = {x: t.filter(pa.array(block == x)).column("k").to_numpy() for x in {p, q}}
        for n, (at, x) in left.items():
            if n not in right:
                continue
            ids, others, y = name[p][at], name[q][right[n][0]], right[n][1]
            for i in range(0, len(x), SLICE_ROWS):
                dist = np.round(1.0 - x[i : i + SLICE_ROWS] @ y.T, digits)
                row, col = np.nonzero(dist <= max_distance)
                a, b, d = ids[i : i + SLICE_ROWS][row], others[col], dist[row, col]
                keep = a < b if p == q else a != b
                a, b, d = a[keep], b[keep], d[keep]
                swap = b < a
                found.append((np.where(swap, b, a), np.where(swap, a, b), d))
        kind = t.schema.field("k").type
        cat = lambda c, k: pa.array(np.concatenate([f[c] for f in found]), k) if found else pa.array([], k)
        return pa.table({"a": cat(0, kind), "b": cat(1, kind), "distance": cat(2, pa.float64())})

    return sent.groupBy("p", "q").applyInArrow(compare, f"a {kind}, b {kind}, distance double")


def farthest_within(df: DataFrame, by: str, vector: str, block_rows: int = 2048, digits: int = 6) -> DataFrame:
    """(by, cosine): the least inner product of two members of each group; groups of one have none.

    A group is cut into blocks of ``block_rows`` on average and each pair of blocks is one task that returns one row, so neither a
    group nor its pairs ever stand in one place. Rows with a null group or vector count for nothing.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(F.col(by).alias("g"), F.col(vector).alias("v"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block_rows).alias("n"))
    b = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("v"), "n"))
    pairs = b.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("g", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "v")
    kind = df.schema[by].dataType.simpleString()

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, block = pdf.p.iloc[0], pdf.q.iloc[0], pdf.b.to_numpy()
        x = np.array(pdf.v.tolist(), np.float64)
        s = x[block == p] @ x[block == q].T
        if p == q:
            np.fill_diagonal(s, np.inf)
        low = float(s.min()) if s.size else np.inf
        return pd.DataFrame({"g": pdf.g.iloc[:1], "low": [round(low, digits) if np.isfinite(low) else None]}).astype({"low": "float64"})

    found = pairs.groupBy("g", "p", "q").applyInPandas(least, f"g {kind}, low double")
    return found.where(F.col("low").isNotNull() & ~F.isnan("low")).groupBy(F.col("g").alias(by)).agg(F.min("low").alias("cosine"))


def cluster_distances(rows: DataFrame, sums: DataFrame, key: str, by: str, vector: str) -> DataFrame:
    """(key, a, b): each unit vector's mean cosine distance to the other members of its own cluster and to the nearest other cluster.

    sums: (c, m, n) per cluster, the sum of its members' vectors and their number, from which the mean distances follow without pairs.
    Blocks of rows meet blocks of clusters; a is null for a cluster of one, b where there is no other. Keys are unique.
    """
    kind = rows.schema[key].dataType.simpleString()
    left = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(by).alias("own"), F.col(vector).alias("v"))
    right = sums.select("c", F.col("m").alias("v"), F.col("n").cast("double").alias("n"))

    def scan(r: pa.Table, c: pa.Table) -> pa.Table:
        keys, a, b = [], [], []
        groups = _by_length(c)
        for size, (at, x) in _by_length(r).items():
            if size not in groups:
                continue
            where, m = groups[size]
            n, name = c.column("n").to_numpy()[where], c.column("c").to_numpy(zero_copy_only=False)[where]
            own = r.column("own").to_numpy(zero_copy_only=False)[at]
            for i in range(0, len(x), SLICE_ROWS):
                far = n - x[i : i + SLICE_ROWS] @ m.T
                same = own[i : i + SLICE_ROWS, None] == name[None, :]
                a.append(np.where(same & (n > 1), far / np.maximum(n - 1, 1), -np.inf).max(axis=1))
                b.append(np.where(same, np.inf, far / n).min(axis=1))
                keys.append(at[i : i + SLICE_ROWS])
        at = np.concatenate(keys) if keys else np.empty(0, int)
        value = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
        return pa.table({"k": r.column("k").take(pa.array(at)), "a": value(a), "b": value(b)})

    found = block_join(left, right, "k", "c", scan, f"k {kind}, a double, b double")
    best = found.groupBy(F.col("k").alias(key)).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    return best.select(key, finite("a"), finite("b"))
