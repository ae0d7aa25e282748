"""Most similar vectors of every vector: inverted lists scanned block by block of rotated dimensions.

1. Usable vectors are scaled to length one; exact copies are folded by a 64-bit hash before the search and unfolded after it,
   k + 1 members of a group at most being needed by anyone.
2. A bounded sample (SAMPLE vectors at most) fits the centres of up to MAX_LISTS lists; every row is compared with all of them and goes
   to the list of its nearest centre and, as a query, to its PROBES nearest lists (FAR_PROBES without a least similarity). Lists are grouped into cells of about CELL_ROWS
   rows, so that a query that probes several lists mostly meets them in one cell and is sent there once; the longer the
   lists, the fewer are in a cell.
3. A task holds one block of a cell's rows and one part of its queries. Cells for which the sample foretells more than CELL_ROWS rows or
   CELL_QUERIES queries are cut into blocks and parts by a hash, and each part meets each block, so no task holds more however large the
   input or a cell is. Vectors are rotated by one random orthogonal matrix and shipped in fixed point, with the similarity that the
   last probed list has; the task finds the probed lists of its cell by it.
4. In a task, a list that is much longer than LIST_ROWS is divided into lists of that length around centres of its own, of which a query
   scans the SUB_PROBES nearest: so what a query scans doesn't grow with the input, although the sample is bounded.
5. Each list is scanned in column blocks. After each block a hypothesis test compares the partial distance,
   scaled to all dimensions, with the query's current k-th distance: a candidate whose partial distance exceeds
   (1 + EPSILON / sqrt(d)) times that is abandoned. Nearest lists come first, so the bound is tight early.
6. The k best of each task are merged to the k best per vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut

#: Most vectors used to fit the centres; every row is indexed.
SAMPLE = 65536
#: Vectors a list holds on average, until there are MAX_LISTS lists; longer lists are divided in the task.
LIST_ROWS = 160
MAX_LISTS = 32768
#: Lists per cell at most, rows of a cell or of a block of one, and queries of a part of one, on average.
CELL_LISTS = 64
CELL_ROWS = 32768
CELL_QUERIES = 65536
#: Lists that a query scans: neighbours of at least NEAR_COSINE lie in few lists, those of vectors without near ones anywhere.
PROBES, FAR_PROBES, NEAR_COSINE = 8, 160, 0.8
#: Lists that a query scans within each divided one.
SUB_PROBES = 6
#: From this many members a group of copies is joined apart from the others, by a broadcast of one row per such group.
HOT_COPIES = 100_000
#: Vectors are shipped in fixed point of 16 bits, which moves a cosine by about 0.00001.
SCALE = 32767
#: Columns scanned before each test.
BLOCK = 16
#: Significance of the test; 2.1 abandons a true neighbour in far less than one case in a hundred.
EPSILON = 2.1
#: Queries of a list scanned at once, to bound the memory of a scan.
QUERY_ROWS = 1024


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m most similar centres of each row, best first."""
    m = min(m, len(centres))
    out = np.empty((len(x), m), np.int32)
    for i in range(0, len(x), 2048):
        s = x[i : i + 2048] @ centres.T
        top = np.argpartition(s, -m, axis=1)[:, -m:] if m < s.shape[1] else np.tile(np.arange(m), (len(s), 1))
        out[i : i + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def fit_centres(sample: np.ndarray, k: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Spherical k-means centres of the sample, started from random members so that dense places get more of them."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        cut = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(sample[order], cut, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        ok = norm[:, 0] > 1e-6
        c = c.copy()
        c[near[order][cut][ok]] = (sums / np.maximum(norm, 1e-6))[ok]
    return c


def scan_list(q: np.ndarray, x: np.ndarray, bound: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON):
    """(query index, candidate index, squared distance) of the pairs that no test abandons and that are within bound.

    q, x: rotated unit rows; bound: the squared distance each query still accepts.
    """
    dim = q.shape[1]
    d = min(block, dim)
    part = ((q[:, :d] ** 2).sum(1)[:, None] + (x[:, :d] ** 2).sum(1)[None, :]) - 2 * (q[:, :d] @ x[:, :d].T)
    limit = bound * (d / dim) * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else bound
    qi, xi = np.nonzero(part <= limit[:, None])
    left = part[qi, xi]
    while d < dim and len(qi):
        e = min(d + block, dim)
        diff = q[qi, d:e] - x[xi, d:e]
        left = left + np.einsum("ij,ij->i", diff, diff)
        d = e
        limit = bound * (d / dim) * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else bound
        keep = left <= limit[qi]
        qi, xi, left = qi[keep], xi[keep], left[keep]
    return qi, xi, left


def _scan_cell(rows: np.ndarray, ids: np.ndarray, probes: np.ndarray, lists: np.ndarray, base: np.ndarray, queries: np.ndarray, k: int, widest: float):
    """The k best candidates of a cell for each of its queries: (query id, candidate id, squared distance).

    probes: lists by query, nearest first, -1 for none; base, queries: positions in rows; lists: the list of each base row.
    """
    order = np.argsort(lists, kind="stable")
    base, lists = base[order], lists[order]
    names, begin = np.unique(lists, return_index=True)
    end = np.append(begin[1:], len(base))
    bound = np.full(len(queries), widest, np.float32)
    best_d = np.full((len(queries), k), np.inf, np.float32)
    best_i = np.full((len(queries), k), -1, np.int64)
    for rank in range(probes.shape[1]):
        at = probes[:, rank]
        slot = np.searchsorted(names, at)
        slot[slot == len(names)] = 0
        live = np.flatnonzero((names[slot] == at) & (at >= 0)) if len(names) else np.empty(0, int)
        live = live[np.argsort(slot[live], kind="stable")]
        cuts = np.flatnonzero(np.diff(slot[live])) + 1
        for group in np.split(live, cuts):
            for i in range(0, len(group), QUERY_ROWS):
                g = group[i : i + QUERY_ROWS]
                if not len(g):
                    continue
                b = base[begin[slot[g[0]]] : end[slot[g[0]]]]
                qi, xi, dist = scan_list(rows[queries[g]], rows[b], bound[g])
                other = ids[b[xi]]
                keep = other != ids[queries[g]][qi]
                qi, other, dist = qi[keep], other[keep], dist[keep]
                if not len(qi):
                    continue
                order = np.lexsort((other, dist, qi))
                qi, other, dist = qi[order], other[order], dist[order]
                first = np.searchsorted(qi, qi)
                pos = np.arange(len(qi)) - first
                top = pos < k
                touched = np.unique(qi)
                new_d = np.full((len(g), k), np.inf, np.float32)
                new_i = np.full((len(g), k), -1, np.int64)
                new_d[qi[top], pos[top]] = dist[top]
                new_i[qi[top], pos[top]] = other[top]
                t = g[touched]
                both_d = np.concatenate([best_d[t], new_d[touched]], 1)
                both_i = np.concatenate([best_i[t], new_i[touched]], 1)
                pick = np.argsort(both_d, axis=1, kind="stable")[:, :k]
                best_d[t] = np.take_along_axis(both_d, pick, 1)
                best_i[t] = np.take_along_axis(both_i, pick, 1)
                bound[t] = np.minimum(widest, best_d[t][:, -1])
    hit = np.nonzero(np.isfinite(best_d))
    return ids[queries[hit[0]]], best_i[hit], best_d[hit]


def nearest_lists(x: np.ndarray, centres: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m most similar centres of each row, best first, and the similarities."""
    lists, sims = np.empty((len(x), m), np.int32), np.empty((len(x), m), np.float32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ centres.T
        top = np.argpartition(s, -m, axis=1)[:, -m:]
        value = np.take_along_axis(s, top, 1)
        best = np.argsort(-value, axis=1, kind="stable")
        lists[i : i + 1024], sims[i : i + 1024] = np.take_along_axis(top, best, 1), np.take_along_axis(value, best, 1)
    return lists, sims


def divide_lists(base: np.ndarray, lists: np.ndarray, queries: np.ndarray, probes: np.ndarray, list_rows: int = LIST_ROWS, sub_probes: int = SUB_PROBES):
    """(list of each base row, probes of each query) with every list of more than four times ``list_rows`` rows divided.

    A divided list is replaced by lists around centres fitted to a sample of its rows; a query that probes it probes the
    ``sub_probes`` nearest of these instead.
    """
    names, counts = np.unique(lists, return_counts=True)
    if not (counts > 4 * list_rows).any():
        return lists, probes
    lists, wide = lists.copy(), np.full((*probes.shape, sub_probes), -1, np.int32)
    wide[:, :, 0] = probes
    following = int(max(lists.max(), probes.max())) + 1
    for name in names[counts > 4 * list_rows]:
        own = np.flatnonzero(lists == name)
        sample = base[own[:: max(1, len(own) // SAMPLE)]]
        centres = fit_centres(sample, max(2, len(own) // list_rows), rounds=2)
        lists[own] = following + _nearest(base[own], centres, 1)[:, 0]
        row, rank = np.nonzero(probes == name)
        near = _nearest(queries[row], centres, sub_probes)
        wide[row, rank, : near.shape[1]] = following + near
        following += len(centres)
    return lists, wide.reshape(len(probes), -1)


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id BIGINT, h BIGINT, v BINARY) of every row whose id and vector can be used; v is scaled to length one, h its hash.

    Null ids and vectors that are null, not ``dim`` long, all zero, or that hold a null, NaN or infinite number are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column("v")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype(np.float32)
            data = np.ascontiguousarray(unit)
            h = np.array([xxhash.xxh3_64_intdigest(r) for r in data], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id").filter(pa.array(ok)), pa.array(h), _binary(data)], names=["id", "h", "v"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id long, h long, v binary")


def nearest_neighbors(
    df: DataFrame, key: str, vector: str, dim: int, k: int = 10, min_cosine: float = -1.0, probes: int | None = None, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES, hot_copies: int = HOT_COPIES
) -> DataFrame:
    """(id, neighbor, cosine DOUBLE, rank INT): the k most similar other ids of each usable id, best first.

    Equally similar neighbours rank by smaller id; with more than k exact copies any id names the smallest k others. With
    ``min_cosine`` only neighbours at least that similar come out. Repeated rows count once; of different vectors
    under one id one is taken, the same whatever the order of rows. Fewer than k usable others give fewer rows, no usable
    vector gives none. See ``usable_vectors`` for the rows that count; other columns are not read. Without ``probes`` a query scans PROBES
    lists if min_cosine is NEAR_COSINE or more, else FAR_PROBES.
    """
    spark = df.sparkSession
    probes = probes or (PROBES if min_cosine >= NEAR_COSINE else FAR_PROBES)
    rows = usable_vectors(df, key, vector, dim)
    members = rows.groupBy("id").agg(F.max("h").alias("h"))
    w = Window.partitionBy("h").orderBy("id")
    first = members.withColumn("n", F.row_number().over(w)).where(f"n <= {k + 1}")
    own = first.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("own"))
    total = df.count()
    found = _search(df, key, vector, rows, total, dim, k, min_cosine, probes, list_rows, max_lists, cell_rows, cell_queries)
    other = found.join(own.select(F.col("h").alias("nh"), F.col("own").alias("theirs")), "nh")
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("theirs", lambda i: F.struct((-F.col("cosine")).alias("c"), i.alias("i")))))), 1, k)
    other = other.groupBy("h").agg(best.alias("other"))
    lists = own.join(other, "h", "left")
    if total > hot_copies:
        # Groups of so many copies are few (total / hot_copies); their members find their lists without a shuffle by the group.
        hot = cut(members.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_copies).select("h"))
        apart = members.join(F.broadcast(hot), "h").join(F.broadcast(lists.join(F.broadcast(hot), "h", "left_semi")), "h")
        every = members.join(F.broadcast(hot), "h", "left_anti").join(lists, "h").unionByName(apart)
    else:
        every = members.join(lists, "h")
    mine = F.transform(F.filter("own", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i")))
    every = every.select("id", F.slice(F.concat(mine, F.coalesce("other", F.array().cast("array<struct<c:double,i:bigint>>"))), 1, k).alias("best"))
    out = every.select("id", F.posexplode("best").alias("pos", "b"))
    return out.select("id", F.col("b.i").alias("neighbor"), (-F.col("b.c")).alias("cosine"), (F.col("pos") + 1).cast("int").alias("rank")).where(F.col("cosine") >= min_cosine)


def _search(df: DataFrame, key: str, vector: str, rows: DataFrame, total: int, dim: int, k: int, min_cosine: float, probes: int, list_rows: int, max_lists: int, cell_rows: int, cell_queries: int) -> DataFrame:
    """(h, nh, cosine): for each distinct vector its k most similar others; total: bound on the rows."""
    spark = df.sparkSession
    nothing = "h long, nh long, cosine double"
    if total < 2:
        return spark.createDataFrame([], nothing)
    share = min(1.0, 0.9 * min(SAMPLE, max(4096, 4 * total // list_rows)) / total)
    # Sampled by id before Python sees a row.
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    taken = usable_vectors(some, key, vector, dim).select("v").distinct().limit(SAMPLE).collect() or rows.select("v").limit(1).collect()
    if not taken:
        return spark.createDataFrame([], nothing)
    turn = rotation(dim)
    sample = np.array([np.frombuffer(r.v, np.float32) for r in taken]) @ turn
    centres = fit_centres(sample, int(min(max_lists, max(1, total // list_rows))))
    m = min(probes, len(centres))
    near, _ = nearest_lists(sample, centres, m)
    per_list = np.bincount(near[:, 0], minlength=len(centres)) * (total / len(sample))
    # As many lists to a cell as make up its rows: fewer the longer the lists are.
    in_cell = int(min(CELL_LISTS, max(1, cell_rows // max(1.0, per_list.mean()))))
    hubs = fit_centres(centres, max(1, len(centres) // in_cell), seed=11)
    cell_of = _nearest(centres, hubs, 1)[:, 0]
    table = [np.flatnonzero(cell_of == c).astype(np.int32) for c in range(len(hubs))]
    met = [np.unique(x) for x in cell_of[near]]
    load = np.bincount(np.concatenate(met), minlength=len(hubs)) * (total / len(sample))
    blocks = np.maximum(1, np.ceil(np.bincount(cell_of[near[:, 0]], minlength=len(hubs)) * (total / len(sample)) / cell_rows)).astype(np.int64)
    parts = np.maximum(1, np.ceil(load / cell_queries)).astype(np.int64)
    shared = spark.sparkContext.broadcast((turn, centres, table, cell_of, blocks, parts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres, _, cell_of, blocks, parts = shared.value
        for batch in batches:
            # Copies are dropped here within a batch and in the scan for good, so a large group of them is never sent whole.
            ids, pos = np.unique(batch.column("h").to_numpy(), return_index=True)
            x = _matrix(batch.column("v").take(pa.array(pos)), np.float32, dim) @ turn
            near, sims = nearest_lists(x, centres, m)
            home = cell_of[near[:, 0]]
            cells = np.sort(cell_of[near], axis=1)
            fresh = np.ones(cells.shape, bool)
            fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
            row, which = np.nonzero(fresh)
            cell = cells[row, which].astype(np.int64)
            mine = (ids[row] >> 20) % parts[cell], ids[row] % blocks[cell]
            # A query meets each block of the cell in its part; at home it is also a row of its block for each part.
            n = blocks[cell]
            q_row, q_cell, q_part = (np.repeat(a, n) for a in (row, cell, mine[0]))
            q_block = np.arange(len(q_row)) - np.repeat(np.cumsum(n) - n, n)
            at_home = cell == home[row]
            b_row, b_cell, b_block = row[at_home], cell[at_home], mine[1][at_home]
            n = parts[b_cell]
            b_row, b_cell, b_block = (np.repeat(a, n) for a in (b_row, b_cell, b_block))
            b_part = np.arange(len(b_row)) - np.repeat(np.cumsum(n) - n, n)
            row, task = np.concatenate([q_row, b_row]), np.concatenate([_task(q_cell, q_block, q_part), _task(b_cell, b_block, b_part)])
            role = np.repeat(np.array([1, 2], np.int8), [len(q_row), len(b_row)])
            # One message where a row is both query and row of the same task.
            order = np.lexsort((role, task, row))
            row, task, role = row[order], task[order], role[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (task[1:] != task[:-1])
            at = np.flatnonzero(new)
            role = np.add.reduceat(role, at) if len(at) else role
            row, task = row[at], task[at]
            packed = np.round(np.clip(x, -1, 1) * SCALE).astype(np.int16)
            for i in range(0, len(row), 8192):
                r = row[i : i + 8192]
                yield pa.record_batch(
                    [pa.array(task[i : i + 8192]), pa.array(role[i : i + 8192].astype(np.int8)), pa.array(ids[r]), _binary(packed[r]), pa.array(sims[r, -1])],
                    names=["task", "role", "h", "v", "least"],
                )

    sent = rows.select("h", "v").mapInArrow(assign, "task long, role byte, h long, v binary, least float")
    widest = float(max(0.0, 2 - 2 * min_cosine)) * (1 + 1e-4) + 1e-5

    def scan(key: tuple, rows: pa.Table) -> pa.Table:
        _, centres, table, _, _, _ = shared.value
        _, first = np.unique(rows.column("h").to_numpy(), return_index=True)
        rows = rows.take(pa.array(first))
        x = _matrix(rows.column("v"), np.int16, dim).astype(np.float32) / SCALE
        ids, role, least = rows.column("h").to_numpy(), rows.column("role").to_numpy(), rows.column("least").to_numpy()
        own = table[key[0].as_py() >> 40]
        base, queries = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        lists = own[_nearest(x[base], centres[own], 1)[:, 0]] if len(base) else np.empty(0, np.int32)
        near = np.full((len(queries), min(m, len(own))), -1, np.int32)
        for i in range(0, len(queries), 4096):
            q = queries[i : i + 4096]
            s = x[q] @ centres[own].T
            best = np.argsort(-s, axis=1, kind="stable")[:, : near.shape[1]]
            near[i : i + 4096] = np.where(np.take_along_axis(s, best, 1) >= least[q, None] - 1e-4, own[best], -1)
        lists, near = divide_lists(x[base], lists, x[queries], near, list_rows)
        q, c, dist = _scan_cell(x, ids, near, lists, base, queries, k, widest)
        return pa.table({"h": q, "nh": c, "cosine": 1.0 - dist.astype(np.float64) / 2})

    found = sent.groupBy("task").applyInArrow(scan, nothing)
    best = found.groupBy("h").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "nh"))), 1, k).alias("best"))
    return best.select("h", F.explode("best").alias("b")).select("h", F.col("b.nh").alias("nh"), (-F.col("b.c")).alias("cosine"))


def _task(cell: np.ndarray, block: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (cell.astype(np.int64) << 40) + (block.astype(np.int64) << 20) + part


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _matrix(column, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)
