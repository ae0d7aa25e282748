"""Continuous periods and gaps of time intervals per entity, by dyadic blocks.

Each interval of whole milliseconds [a, b] covers the integer cells [2a, 2b + 1): even cells are instants, odd cells
the open milliseconds between them, so two intervals touch exactly if their cells overlap or adjoin. The cells are cut
at buckets of 2**BUCKET_BITS cells and the pieces at both ends are decomposed into canonical dyadic blocks, numbered as the nodes of
a binary tree over their bucket (root 1, children 2n and 2n + 1). The whole buckets between them are the cells of the next level, which are
cut and decomposed in the same way, so an interval of any length gives a few pieces. Blocks below another block are removed and sibling
pairs merge upward, within each batch of rows before the shuffle, so repeats and hot entities shrink early, and again over all blocks of an
(entity, level, bucket), so an entity is spread over its buckets; then neighbours coalesce. Buckets below a range of a higher level are
removed, and periods that cross buckets are joined, from one row per (entity, bucket).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A bucket is 2**22 cells, about 35 minutes on the first level; at most 2**23 - 1 block numbers exist in one.
BUCKET_BITS = 22
#: Levels of buckets; three reach beyond 2**62 cells.
LEVELS = 3


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, node): the tree numbers of the canonical blocks of the cells [lo, hi) of each row, within one bucket of 2**bits cells."""
    rows, nodes = [], []
    for level in range(bits + 1):
        a, b, root = (lo + (1 << level) - 1) >> level, hi >> level, 1 << (bits - level)
        left, right = np.flatnonzero((a < b) & (a & 1 == 1)), np.flatnonzero((a < b) & (b & 1 == 1))
        rows += [left, right]
        nodes += [root + a[left], root + b[right] - 1]
    return np.concatenate(rows), np.concatenate(nodes)


def merge_blocks(group: np.ndarray, node: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) without blocks below another one, sibling pairs merged upward as far as they go."""
    span = np.int64(1) << (bits + 1)
    key = np.unique(group.astype(np.int64) * span + node)
    g, n = key // span, key % span
    covered = np.zeros(len(key), bool)
    for k in range(1, bits + 1):
        up = n >> k
        live = (up > 0) & ~covered
        if not live.any():
            break
        want = g[live] * span + up[live]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        covered[np.flatnonzero(live)[key[at] == want]] = True
    g, n = g[~covered], n[~covered]
    depth = np.frexp(n.astype(np.float64))[1] - 1
    groups, nodes = [], []
    carry_g, carry_n = np.empty(0, np.int64), np.empty(0, np.int64)
    for d in range(bits, -1, -1):
        here = depth == d
        at = np.sort(np.concatenate([g[here] * span + n[here], carry_g * span + carry_n]))
        hg, hn = at // span, at % span
        left = np.zeros(len(at), bool)
        left[:-1] = (hn[:-1] % 2 == 0) & (at[1:] == at[:-1] + 1) & (d > 0)
        pair = left.copy()
        pair[1:] |= left[:-1]
        carry_g, carry_n = hg[left], hn[left] >> 1
        groups.append(hg[~pair])
        nodes.append(hn[~pair])
    return np.concatenate(groups), np.concatenate(nodes)


def coalesce_blocks(group: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, starts and ends (cells of the bucket) of the coalesced blocks, sorted by group and start."""
    g, n = merge_blocks(group, node, bits)
    depth = np.frexp(n.astype(np.float64))[1] - 1
    s = (n - (np.int64(1) << depth)) << (bits - depth)
    e = s + (np.int64(1) << (bits - depth))
    order = np.lexsort((s, g))
    g, s, e = g[order], s[order], e[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != e[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(g) - 1) if len(g) else np.empty(0, np.int64)
    return g[new], s[new], e[last]


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, level, bucket, nodes) of the rows (entity, lo, hi) of each batch, the blocks of one bucket merged."""
    size = np.int64(1) << BUCKET_BITS
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("entity").dictionary_encode()
        code, lo, hi = names.indices.to_numpy(), batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
        pieces = []
        for level in range(1, LEVELS + 1):
            # Both ends of a range lie in buckets of this level; the whole buckets between them are the range of the next one.
            first, last = lo >> BUCKET_BITS, (hi - 1) >> BUCKET_BITS
            pieces.append((code, np.full(len(code), level), first, lo - first * size, np.minimum(hi - first * size, size)))
            far = np.flatnonzero(last > first)
            pieces.append((code[far], np.full(len(far), level), last[far], np.zeros(len(far), np.int64), hi[far] - last[far] * size))
            wide = np.flatnonzero(last > first + 1)
            code, lo, hi = code[wide], first[wide] + 1, last[wide]
        code, level, bucket, lo, hi = (np.concatenate(c) for c in zip(*pieces))
        order = np.lexsort((bucket, level, code))
        code, level, bucket, lo, hi = code[order], level[order], bucket[order], lo[order], hi[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (level[1:] != level[:-1]) | (bucket[1:] != bucket[:-1])
        row, node = dyadic_blocks(lo, hi)
        g, n = merge_blocks((np.cumsum(new) - 1)[row], node)
        order = np.argsort(g, kind="stable")
        at = np.flatnonzero(new)
        offsets = np.searchsorted(g[order], np.arange(len(at) + 1)).astype(np.int32)
        yield pa.record_batch(
            [names.dictionary.take(pa.array(code[at])), pa.array(level[at].astype(np.int32)), pa.array(bucket[at]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(n[order]))],
            names=["entity", "level", "bucket", "nodes"],
        )


def _coalesce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("nodes")
        lengths = np.diff(nodes.offsets.to_numpy())
        flat = nodes.flatten().to_numpy()
        bucket, level = batch.column("bucket").to_numpy(), batch.column("level").to_numpy().astype(np.int64)
        g, s, e = coalesce_blocks(np.repeat(np.arange(len(lengths)), lengths), flat, BUCKET_BITS)
        offsets = np.searchsorted(g, np.arange(len(lengths) + 1)).astype(np.int32)
        base, shift = bucket[g] << BUCKET_BITS, BUCKET_BITS * (level[g] - 1)
        yield pa.record_batch(
            [
                batch.column("entity"),
                batch.column("level"),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array((s + base) << shift)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array((e + base) << shift)),
            ],
            names=["entity", "level", "starts", "ends"],
        )


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, unit_ms: float = 1000.0) -> DataFrame:
    """Continuous periods of each entity and the gaps between them.

    df: any table; entity: key column (cast to string); start, end: numeric bounds, ``unit_ms`` milliseconds a unit.
    Returns (entity STRING, kind STRING ``period``/``gap``, from_ms BIGINT, to_ms BIGINT).

    Defined cases: bounds are rounded half up to whole milliseconds first, so residue below that neither splits nor
    reverses an interval; intervals that share an instant join; an instant (start = end) is a period. Rows whose entity
    or bound is null, whose bound is NaN, infinite or 2**61 ms (73 million years) or more, or whose rounded start is after its end count
    for nothing. Repeated rows count once, other columns are not read, an empty table gives no rows.
    """
    ms = lambda c: F.round(F.col(c).cast("double") * unit_ms)
    cells = (
        df.select(F.col(entity).cast("string").alias("entity"), ms(start).alias("a"), ms(end).alias("b"))
        .where(f"entity is not null and a <= b and abs(a) < {float(1 << 61)} and abs(b) < {float(1 << 61)}")
        .select("entity", (F.col("a").cast("long") * 2).alias("lo"), (F.col("b").cast("long") * 2 + 1).alias("hi"))
    )
    blocks = cells.mapInArrow(_block_batches, "entity string, level int, bucket long, nodes array<long>")
    sets = blocks.groupBy("entity", "level", "bucket").agg(F.flatten(F.collect_list("nodes")).alias("nodes"))
    local = sets.mapInArrow(_coalesce_batches, "entity string, level int, starts array<long>, ends array<long>")
    # Ranges of higher levels one by one; what lies below one of them is removed. A bucket lies below a range wholly or not at all.
    one = lambda x: F.struct(F.array(x["starts"]).alias("starts"), F.array(x["ends"]).alias("ends"))
    ranges = F.when(F.col("level") == 1, F.array(F.struct("starts", "ends"))).otherwise(F.transform(F.arrays_zip("starts", "ends"), one))
    local = local.select("entity", "level", F.explode(ranges).alias("r")).select("entity", "level", "r.starts", "r.ends", F.col("r.starts")[0].alias("at"))

    w = Window.partitionBy("entity").orderBy("at", F.desc("level"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("covered", F.coalesce(F.max(F.when(F.col("level") > 1, F.element_at("ends", -1))).over(before) > F.col("at"), F.lit(False))).where("not covered")
    local = (
        local.withColumn("prev_end", F.lag(F.expr("element_at(ends, -1)")).over(w))
        .withColumn("next_start", F.lead(F.expr("starts[0]")).over(w))
        .withColumn("joined", F.expr("coalesce(starts[0] = prev_end, false)"))
        .withColumn("goes_on", F.expr("coalesce(element_at(ends, -1) = next_start, false)"))
        .withColumn("open", F.expr("if(size(starts) > 1 or not joined, element_at(starts, -1), null)"))
        .withColumn("carried", F.last("open", ignorenulls=True).over(before))
    )
    rows = local.select("entity", "prev_end", "joined", "goes_on", "carried", "starts", "ends", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "x"))
    rows = rows.select(
        "entity",
        F.expr(
            "filter(array("
            "if(i < size(starts) - 1 or not goes_on, named_struct('kind', 'period', 'f', if(i = 0 and joined, carried, x.starts), 't', x.ends - 1), null), "
            "if(i > 0, named_struct('kind', 'gap', 'f', ends[i - 1] - 1, 't', x.starts), "
            "if(not joined and prev_end is not null, named_struct('kind', 'gap', 'f', prev_end - 1, 't', x.starts), null))), r -> r is not null)"
        ).alias("out"),
    ).select("entity", F.explode("out").alias("r"))
    return rows.select("entity", F.col("r.kind").alias("kind"), F.expr("r.f div 2").alias("from_ms"), F.expr("r.t div 2").alias("to_ms"))
