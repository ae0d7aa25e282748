"""Linkage by best shots and by appearance, vector search by blocks and numbering, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators.clustering import best_shots, gated_linkage, merge_gated, merge_proposals, shot_linkage
from framewright.operators.tables import numbered
from framewright.operators.vectors import cluster_distances, pairs_within, top_neighbors


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _case(seed, n=14, dim=6):
    rng = np.random.default_rng(seed)
    cluster = rng.integers(0, n, 40)
    x = _unit(rng.standard_normal((40, dim)) + 1.2)
    apart = {frozenset(map(int, rng.integers(0, n, 2))) for _ in range(6)}
    return cluster, x, {p for p in apart if len(p) == 2}


def _barred(a, b, apart):
    return any(frozenset((i, j)) in apart for i in a for j in b)


def brute(shots, apart, limit, app=None, app_limit=None):
    """Greedy merging: the nearest allowed pair by the farthest shots, or by appearance under the gate of the farthest shots."""
    groups = {c: {c} for c in shots}
    shots, app = dict(shots), dict(app or {})
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            if _barred(groups[a], groups[b], apart):
                continue
            far = round(float(1 - (shots[a] @ shots[b].T).min()), 9)
            d = far if app_limit is None else round(float(1 - app[a] @ app[b]), 9)
            if far <= limit and d <= (limit if app_limit is None else app_limit) and (best is None or d < best[0]):
                best = d, a, b
        if not best:
            return {i: c for c, g in groups.items() for i in g}
        _, a, b = best
        groups[a] |= groups.pop(b)
        shots[a] = np.vstack([shots[a], shots.pop(b)])
        if app:
            v = app[a] + app.pop(b)
            app[a] = v / (np.linalg.norm(v) + 1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_by_shots_and_by_appearance(spark, seed):
    cluster, x, apart = _case(seed)
    df = spark.createDataFrame([(int(c), i, [float(v) for v in r], float(i * 37 % 11), i % 4 != 0) for i, (c, r) in enumerate(zip(cluster, x))], "cl int, crop int, v array<double>, q double, ok boolean")
    top = best_shots(df, "cl", "crop", "v", "q", "ok", 3)
    want = {}
    for c in set(map(int, cluster)):
        own = [i for i in range(40) if cluster[i] == c]
        own = [i for i in own if i % 4] or own
        want[c] = sorted(own, key=lambda i: (-(i * 37 % 11), i))[:3]
    got = {}
    for r in top.collect():
        got.setdefault(r.cluster, []).append(r.key)
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in want.items()}
    shots = {c: x[v] for c, v in want.items()}
    ban = spark.createDataFrame([tuple(sorted(p)) for p in apart], "a int, b int")
    clusters = df.select(F.col("cl").alias("cluster")).distinct()
    for limit in (0.25, 0.5):
        assert dict(shot_linkage(top, clusters, ban, limit).collect()) == brute(shots, apart, limit)
    app = {c: _unit(np.random.default_rng(9 * seed + c).standard_normal((1, 5)) + 1.5)[0] for c in want}
    looks = spark.createDataFrame([(c, [float(v) for v in r]) for c, r in app.items()], "cluster int, vector array<double>")
    merged = dict(gated_linkage(looks, top, ban, 0.35, 0.6).collect())
    assert merged == brute(shots, apart, 0.6, app, 0.35) and len(set(merged.values())) < len(merged)
    found = {(r.a, r.b) for r in merge_proposals(looks, top, ban, 0.35, 0.6).collect()}
    assert found == {(a, b) for a, b in itertools.combinations(sorted(app), 2) if frozenset((a, b)) not in apart and round(float(1 - app[a] @ app[b]), 9) <= 0.35 and round(float(1 - (shots[a] @ shots[b].T).min()), 9) <= 0.6}


def test_a_pair_beyond_the_limit_may_come_within_it():
    e = np.eye(3)
    v = {0: e[0], 1: _unit(np.array([[1.0, 1.0, 0.0]]))[0], 2: e[1]}
    assert merge_gated([(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.1)], v, 0.3)[2] == 2
    assert merge_gated([(0, 1, 0.1), (1, 2, 0.1)], v, 0.9) == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("pivot_rows", [5, 1000])
def test_pairs_within_by_cells(spark, pivot_rows):
    rng = np.random.default_rng(5)
    x = _unit(np.repeat(rng.standard_normal((12, 8)), 12, axis=0) + 0.3 * rng.standard_normal((144, 8)))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, [1.0, 0.0]), (501, [1.0, 0.0]), (502, None), (None, [1.0] * 8), (503, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(4)
    got = {(r.a, r.b): r.distance for r in pairs_within(df, "id", "v", 0.3, pivot_rows=pivot_rows).collect()}
    d = np.round(1 - x @ x.T, 9)
    want = {(i, j): d[i, j] for i, j in itertools.combinations(range(144), 2) if d[i, j] <= 0.3} | {(500, 501): 0.0}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)
    assert pairs_within(df.where("1 = 0"), "id", "v", 0.3).count() == 0


def test_top_neighbors_by_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((120, 4)), 1)
    df = spark.createDataFrame([(f"n{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("n900", None), ("n901", [float("nan")] * 4), (None, [1.0] * 4)], "id string, v array<double>")
    got = {}
    for r in top_neighbors(df.where("id < 'n040'"), df, "id", "v", 5, digits=1, left_rows=7, right_rows=11).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor))
    s = np.round(x @ x.T, 1)
    np.fill_diagonal(s, -np.inf)
    assert len(got) == 40 and all([n for _, n in sorted(got[f"n{i:03d}"])] == [f"n{j:03d}" for j in np.lexsort((np.arange(120), -s[i]))[:5]] for i in range(40))
    assert top_neighbors(df.where("1 = 0"), df, "id", "v", 5).count() == 0


def test_cluster_distances(spark):
    x = _unit(np.random.default_rng(8).standard_normal((30, 5)))
    own = [0] * 10 + [1] * 19 + [2]
    df = spark.createDataFrame([(i, own[i], [float(v) for v in r]) for i, r in enumerate(x)], "id int, c int, v array<double>")
    sums = spark.createDataFrame([(c, [float(v) for v in x[[i for i in range(30) if own[i] == c]].sum(0)], own.count(c)) for c in range(3)], "c int, m array<double>, n long")
    d = 1 - x @ x.T
    for r in cluster_distances(df, sums, "id", "c", "v").collect():
        mean = lambda c: np.mean([d[r.id, j] for j in range(30) if own[j] == c and j != r.id])
        assert (r.a is None) == (own[r.id] == 2) and (r.a is None or abs(r.a - mean(own[r.id])) < 1e-9) and abs(r.b - min(mean(c) for c in range(3) if c != own[r.id])) < 1e-9


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    assert [r["rank"] for r in sorted(numbered(df, [F.col("x")]).collect(), key=lambda r: r.x)] == list(range(1, 1001))
    assert numbered(df.where("1 = 0"), [F.col("x")]).count() == 0
