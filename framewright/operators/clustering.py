"""Constrained agglomerative clustering of identities.

Complete-linkage merging is global, but a merge under a distance limit never joins two clusters from different connected
components of the graph of pairs within the limit: the farthest pair between them is beyond it. So the pairs within the limit are
found first, components split the work, and each component is merged on its own, in the order of the smallest distance.

Components too large for one task are merged in rounds over the table of cluster pairs within the limit. Complete linkage is reducible,
ties by key included: a merge never brings a third cluster nearer. So pairs that are each other's nearest stay so until they merge, and
merging all of them at once gives the clusters of the one-by-one order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.vectors import pairs_within
from framewright.session import cut, discard

#: Members of a component that one task merges by matrices of 128 MB each; larger components merge in rounds.
DENSE_MEMBERS = 4000
#: Cluster pairs within the limit that one task takes over from the rounds.
TASK_PAIRS = 250_000


def label_components(edges: DataFrame, nodes: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, component): the smallest key linked to each node, by min-label propagation with pointer jumping."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct())
    labels = cut(nodes.select(F.col(key).alias("u"), F.col(key).alias("c")).distinct())
    while True:
        before = labels
        now = labels.select("u", "c")
        near = both.join(now.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").groupBy("u").agg(F.min("d").alias("d"))
        step = now.join(near, "u", "left").select("u", F.col("c").alias("old"), F.least("c", F.coalesce("d", "c")).alias("c"))
        jump = step.select(F.col("u").alias("c"), F.col("c").alias("e"))
        new = cut(step.join(jump, "c", "left").select("u", "old", F.least("c", F.coalesce("e", "c")).alias("c")))
        discard(before)
        if new.where("c <> old").isEmpty():
            return new.select(F.col("u").alias(key), F.col("c").alias("component"))
        labels = new


def merge_members(dist: np.ndarray, allowed: np.ndarray, limit: float) -> np.ndarray:
    """Cluster of each member: the allowed pair with the least complete-linkage distance merges while it is within the limit.

    Of equal distances the pair of the smallest positions merges; the larger joins the smaller and both keep their constraints.
    """
    n = len(dist)
    d = np.where(allowed, dist, np.inf).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    cluster = np.arange(n)
    if n < 2:
        return cluster
    near = d.argmin(axis=1)
    least = d[cluster, near]
    while True:
        i = int(least.argmin())
        if not least[i] <= limit:
            return cluster
        i, j = min(i, int(near[i])), max(i, int(near[i]))
        cluster[cluster == j] = i
        d[i] = d[:, i] = np.maximum(d[i], d[j])  # an inf of either keeps the two apart
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        # Distances only grow, so the nearest of a row changes only where it was one of the two.
        again = np.flatnonzero((near == i) | (near == j))
        again = np.union1d(again, [i, j])
        near[again] = d[again].argmin(axis=1)
        least[again] = d[again, near[again]]


def merge_pairs(pairs: list[tuple]) -> list[tuple]:
    """(old, new) for each cluster that joins a smaller one; pairs: (distance, a, b) with a < b, all that may merge."""
    near: dict = defaultdict(dict)
    for d, a, b in pairs:
        near[a][b] = near[b][a] = d
    heapq.heapify(pairs)
    joined = []
    while pairs:
        d, i, j = heapq.heappop(pairs)
        if near[i].get(j) != d:
            continue
        kept, gone = near[i], near.pop(j)
        joined.append((j, i))
        for k in kept:
            if k != j:
                del near[k][i]
        for k in gone:
            if k != i:
                del near[k][j]
        near[i] = {}
        for k in kept.keys() & gone.keys():
            near[i][k] = near[k][i] = far = max(kept[k], gone[k])
            if far != kept[k]:
                heapq.heappush(pairs, (far, min(i, k), max(i, k)))
    return joined


def merge_rounds(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, cluster) by complete linkage of any number of members; pairs: (a, b, distance) with a < b, all that may merge.

    A pair of clusters is in the table while all pairs of their members are; it carries the farthest of them.
    """
    kind = nodes.schema[key].dataType.simpleString()
    labels = nodes.select(key, F.col(key).alias("cluster"))
    pairs = cut(pairs.select("a", "b", (F.col("distance") + 0.0).alias("distance")))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [row for x in batches for row in zip(x.distance.tolist(), x.a.tolist(), x.b.tolist())]
        root: dict = {}
        for old, new in reversed(merge_pairs(found)):
            root[old] = root.get(new, new)
        yield pd.DataFrame({"old": list(root), "new": list(root.values())})

    def renamed(joined: DataFrame) -> DataFrame:
        return labels.join(joined.withColumnRenamed("old", "cluster"), "cluster", "left").select(key, F.coalesce("new", "cluster").alias("cluster"))

    while pairs.count() > TASK_PAIRS:
        p = F.struct("distance", "a", "b").alias("p")
        best = pairs.select(F.explode(F.array("a", "b")).alias("u"), p).groupBy("u").agg(F.min("p").alias("p"))
        joined = cut(best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select(F.col("p.b").alias("old"), F.col("p.a").alias("new")))
        labels = cut(renamed(joined))
        moved = cut(joined.union(joined.select("new", "new")))
        of = lambda s: moved.select(F.col("old").alias(s), F.col("new").alias(f"n{s}"))
        step = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("ca", F.coalesce("na", "a")).withColumn("cb", F.coalesce("nb", "b")).where("ca <> cb")
        parts = F.when(F.col("na").isNull(), 1).otherwise(2) * F.when(F.col("nb").isNull(), 1).otherwise(2)
        whole = step.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("n"), F.max(parts).alias("parts"))
        old, pairs = pairs, cut(whole.where("n = parts").select("a", "b", "distance"))
        for table in (old, moved, joined):
            discard(table)
    return renamed(pairs.coalesce(1).mapInPandas(rest, f"old {kind}, new {kind}"))


def complete_linkage(nodes: DataFrame, cannot: DataFrame, key: str, vector: str, pairs: DataFrame, limit: float) -> DataFrame:
    """(key, cluster): clusters named by their smallest key.

    nodes: (key, vector of length one); pairs: (a, b) candidate pairs that include all within the limit; cannot: (a, b) pairs that may
    never share a cluster. Keys decide the order of ties. Nodes without candidates stay alone. Nodes with a null key or vector are left
    out, repeated keys count once, pairs that name a missing node count for nothing.
    """
    nodes = nodes.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).dropDuplicates([key])
    known = nodes.select(F.col(key).alias("a"))
    pairs = pairs.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    comp = label_components(pairs, nodes, "a", "b", key)
    own = nodes.join(comp, key)
    edge = cannot.join(comp.select(F.col(key).alias("a"), "component"), "a").join(comp.select(F.col(key).alias("b"), F.col("component").alias("other")), "b").where("component = other")
    kind = nodes.schema[key].dataType.simpleString()
    large = cut(comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > DENSE_MEMBERS).select("component"))
    left = own.join(large, "component", "left_anti").select(F.col("component").alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    right = edge.join(large, "component", "left_anti").select(F.col("component").alias("h"), "a", "b")

    def run(group: pd.DataFrame, apart: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"k": group.k, "cluster": group.k})
        group = group.sort_values("k")
        keys = group.k.to_numpy()
        x = np.array(group.v.tolist(), np.float64)
        at = {k: i for i, k in enumerate(keys)}
        allowed = np.ones((len(keys), len(keys)), bool)
        for a, b in zip(apart.a, apart.b):
            allowed[at[a], at[b]] = allowed[at[b], at[a]] = False
        c = merge_members(np.round(1.0 - x @ x.T, 9), allowed, limit)
        return pd.DataFrame({"k": keys, "cluster": keys[c]})

    out = left.groupBy("g").cogroup(right.groupBy("h")).applyInPandas(run, f"k {kind}, cluster {kind}")
    out = out.withColumnRenamed("k", key)
    if large.isEmpty():
        return out
    rest = cut(own.join(large, "component", "left_semi").select(key, vector, "component"))
    of = lambda s: rest.select(F.col(key).alias(s), F.col("component").alias(f"c{s}"))
    near = pairs_within(rest, key, vector, limit).join(of("a"), "a").join(of("b"), "b").where("ca = cb")
    near = near.join(edge.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return out.unionByName(merge_rounds(near, rest, key))


def best_shots(crops: DataFrame, cluster: str, key: str, vector: str, quality: str, good: str, k: int = 3) -> DataFrame:
    """(cluster, key, vector): each cluster's k crops of the best quality, of its good ones if it has any; equal ones by key.

    good: a boolean column. Rows with a null cluster, key or vector count for nothing; a null quality comes last.
    """
    rows = crops.where(F.col(cluster).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(cluster).alias("cluster"), F.col(key).alias("key"), F.col(vector).alias("vector"), F.coalesce(F.col(good), F.lit(False)).alias("__good"), F.col(quality).alias("__q"))
    any_good = rows.groupBy("cluster").agg(F.max("__good").alias("__any"))
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("__q"), "key")
    return rows.join(any_good, "cluster").where("__good or not __any").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select("cluster", "key", "vector")


def farthest_pairs(shots: DataFrame, limit: float, apart: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: pairs of clusters all of whose shots are within ``limit`` of each other, with the farthest distance.

    shots: (cluster, key, vector of length one); apart: (a, b) pairs of clusters that may never merge, in either order.
    """
    of = lambda s: shots.select(F.col("key").alias(s), F.col("cluster").alias(f"c{s}"))
    near = pairs_within(shots, "key", "vector", limit).join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
    both = near.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("n"))
    size = shots.groupBy("cluster").agg(F.count("*").alias("size"))
    whole = both.join(size.select(F.col("cluster").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("size").alias("nb")), "b").where("n = na * nb")
    barred = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return whole.select("a", "b", "distance").join(barred, ["a", "b"], "left_anti")


def shot_linkage(shots: DataFrame, clusters: DataFrame, apart: DataFrame, limit: float) -> DataFrame:
    """(cluster, merged): complete linkage of clusters on their shots; ``clusters`` is a table with each cluster once.

    The distance of two clusters is that of their farthest shots, and a merged cluster has the shots of both, so this is complete
    linkage over the table of cluster pairs.
    """
    merged = merge_rounds(farthest_pairs(shots, limit, apart), clusters.select(F.col("cluster").alias("key")), "key")
    return merged.select(F.col("key").alias("cluster"), F.col("cluster").alias("merged"))


def merge_gated(pairs: list[tuple], vectors: dict, limit: float) -> dict:
    """Cluster of each name: the pair with the nearest vectors merges while that is within the limit and all its shots are within the gate.

    pairs: (a, b, farthest distance of their shots) that pass the gate; vectors: of length one, the merged one being the scaled sum.
    """
    near: dict = defaultdict(dict)
    for a, b, far in pairs:
        near[a][b] = near[b][a] = far
    vectors, version, root = dict(vectors), dict.fromkeys(vectors, 0), {k: k for k in vectors}
    heap: list[tuple] = []

    def push(a, b) -> None:
        a, b = min(a, b), max(a, b)
        d = round(float(1.0 - vectors[a] @ vectors[b]), 9)
        if d <= limit:
            heapq.heappush(heap, (d, a, b, version[a], version[b]))

    for a, b, _ in pairs:
        push(a, b)
    while heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or b not in near[a]:
            continue
        root[b] = a
        version[a] += 1
        version[b] = -1
        v = vectors[a] + vectors[b]
        vectors[a] = v / (np.linalg.norm(v) + 1e-9)
        kept, gone = near.pop(a), near.pop(b)
        for k in (kept.keys() | gone.keys()) - {a, b}:
            near[k].pop(a, None)
            near[k].pop(b, None)
        near[a] = {}
        # A third cluster stays in the gate only where it was for both.
        for k in (kept.keys() & gone.keys()) - {a, b}:
            near[a][k] = near[k][a] = max(kept[k], gone[k])
            push(a, k)
    out = {}
    for k in root:
        top = k
        while root[top] != top:
            top = root[top]
        out[k] = top
    return out


def gated_linkage(appearance: DataFrame, shots: DataFrame, apart: DataFrame, limit: float, gate: float) -> DataFrame:
    """(cluster, merged): clusters merge in the order of their appearance distance while it is within ``limit``, if all shots of both are within ``gate``.

    appearance: (cluster, vector of length one). A merge never joins clusters from different components of the graph of pairs that pass
    the gate, so these are merged on their own, one task each; its memory is that of the pairs of one component of clusters.
    """
    near = cut(farthest_pairs(shots, gate, apart))
    names = appearance.where("cluster is not null and vector is not null").dropDuplicates(["cluster"])
    comp = label_components(near, names, "a", "b", "cluster")
    kind = appearance.schema["cluster"].dataType.simpleString()

    def run(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        vectors = {k: np.array(v, np.float64) for k, v in zip(own.cluster, own.vector)}
        found = merge_gated([p for p in zip(pairs.a, pairs.b, pairs.distance) if p[0] in vectors and p[1] in vectors], vectors, limit)
        return pd.DataFrame({"cluster": list(found), "merged": list(found.values())})

    left = names.join(comp, "cluster").select("cluster", "vector", "component")
    right = near.join(comp.select(F.col("cluster").alias("a"), F.col("component").alias("other")), "a")
    return left.groupBy("component").cogroup(right.groupBy("other")).applyInPandas(run, f"cluster {kind}, merged {kind}").where("cluster is not null")


def merge_proposals(appearance: DataFrame, shots: DataFrame, together: DataFrame, limit: float, gate: float) -> DataFrame:
    """(a, b, app_dist, face_dist): pairs of named clusters that look alike by body and by their farthest shots and never share a frame.

    together: (a, b) clusters that appear in one frame. Both distances are rounded to three places.
    """
    near = pairs_within(appearance, "cluster", "vector", limit).withColumnRenamed("distance", "app")
    face = farthest_pairs(shots, gate, together)
    return near.join(face, ["a", "b"]).select("a", "b", F.round("app", 3).alias("app_dist"), F.round("distance", 3).alias("face_dist"))
