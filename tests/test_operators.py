"""Operators against brute force and stated cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import numeric as N
from framewright.functions import text as X
from framewright.operators import clustering as C
from framewright.operators import narration as T
from framewright.operators.clustering import complete_linkage, label_components, merge_members
from framewright.operators.intervals import BUCKET_BITS, coalesce_blocks, periods_and_gaps
from framewright.operators.joins import as_of, range_join, within
from framewright.operators.models import memoised, with_retries
from framewright.operators.search import reciprocal_rank_fusion, search
from framewright.operators.sequences import islands, running_count, scene_cuts, with_previous
from framewright.operators.stages import Stages, fingerprint, guarded
from framewright.operators.vectors import farthest_within, mean_vector, pairs_within, top_neighbors


def periods(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_intervals_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], set()
    size = (1 << BUCKET_BITS) // 2
    for e in range(12):
        spans = []
        for _ in range(rng.randint(1, 40)):
            a = rng.choice([rng.randint(0, 3000), rng.randint(0, 4 * size), size * rng.randint(0, 3)])
            b = a + rng.choice([0, 1, rng.randint(0, 500), rng.randint(0, 2 * size)])
            spans.append((a, b))
        rows += [(f"e{e}", a / 1000, b / 1000, 1) for a, b in spans + spans[:3]]
        p = periods(spans)
        want |= {(f"e{e}", "period", a, b) for a, b in p} | {(f"e{e}", "gap", x[1], y[0]) for x, y in itertools.pairwise(p)}
    got = periods_and_gaps(spark.createDataFrame(rows, "f string, a double, b double, entity int"), "f", "a", "b").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_intervals_edge_cases(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.001, 4.0), (None, 0.0, 1.0), ("b", 5.0, 4.0), ("b", None, 4.0), ("b", float("nan"), 4.0), ("c", 1.0000000003, 1.0), ("d", -2.0, -1.0), ("d", 1.0, 1.0), ("x", float("inf"), float("inf"))]
    df = spark.createDataFrame(rows, "f string, a double, b double")
    got = {tuple(r) for r in periods_and_gaps(df, "f", "a", "b").collect()}
    assert got == {("a", "period", 1000, 3000), ("a", "period", 3001, 4000), ("a", "gap", 3000, 3001), ("c", "period", 1000, 1000), ("d", "period", -2000, -1000), ("d", "period", 1000, 1000), ("d", "gap", -1000, 1000)}
    assert periods_and_gaps(df.where("1 = 0"), "f", "a", "b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=30))
def test_blocks(nodes):
    cells = set()
    for n in nodes:
        d = n.bit_length() - 1
        cells |= set(range((n - (1 << d)) << (5 - d), (n - (1 << d) + 1) << (5 - d)))
    _, s, e = coalesce_blocks(np.zeros(len(nodes), int), np.array(nodes), 5)
    assert {c for a, b in zip(s, e) for c in range(a, b)} == cells
    assert all(b < c for b, c in zip(e[:-1], s[1:]))


def test_range_and_distance_joins(spark):
    rng = random.Random(1)
    pts = [(i, rng.choice("xy"), rng.random() * 50) for i in range(80)] + [(99, "x", None), (98, "x", float("nan"))]
    ivs = [(j, rng.choice("xy"), a := rng.random() * 45, a + rng.random() * 9) for j in range(40)] + [(77, "x", 9.0, 1.0), (78, "x", None, 1.0)]
    p, i = spark.createDataFrame(pts, "i int, g string, t double"), spark.createDataFrame(ivs, "j int, g string, a double, b double")
    good = [x for x in ivs if x[2] is not None]
    for closed in (True, False):
        want = {(x[0], y[0]) for x in pts[:80] for y in good if x[1] == y[1] and y[2] <= x[2] and (x[2] <= y[3] if closed else x[2] < y[3])}
        assert {tuple(r) for r in range_join(p, i, "g", "t", "a", "b", 4.0, closed).select("i", "j").collect()} == want
    q = p.selectExpr("i as k", "g", "t as u")
    want = {(x[0], y[0]) for x in pts[:80] for y in pts[:80] if x[1] == y[1] and abs(x[2] - y[2]) <= 1.5}
    assert {tuple(r) for r in within(p, q, "g", "t", "u", 1.5).select("i", "k").collect()} == want


def test_as_of(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), float(rng.randint(0, 60))) for i in range(60)] + [(90, "x", None), (91, "z", 5.0)]
    evs = [(rng.choice("xy"), float(rng.randint(5, 60)), k, f"v{k}" if k % 4 else None) for k in range(25)]
    got = {r.i: r.v for r in as_of(spark.createDataFrame(rows, "i int, g string, t double"), spark.createDataFrame(evs, "g string, t double, k int, v string"), "g", "t", "k", "v", 10.0).collect()}
    for i, g, t in rows:
        hits = [(e[1], e[2], e[3]) for e in evs if t is not None and e[0] == g and e[1] <= t and e[3]]
        assert got[i] == (max(hits)[2] if hits else None), i


def test_components_and_linkage(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9)]
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 9, 10)], "k int")
    got = dict(label_components(spark.createDataFrame(edges, "a int, b int"), nodes, "a", "b", "k").collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9, 10: 10}

    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.25 * rng.standard_normal((8, 12)) for c in rng.standard_normal((5, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cannot = [(0, 1), (9, 12)]

    def brute(limit):
        groups, apart = [[i] for i in range(len(x))], {frozenset(p) for p in cannot}
        d = np.round(1 - x @ x.T, 9)
        while True:
            best = None
            for a, b in itertools.combinations(groups, 2):
                far = max(d[i, j] for i in a for j in b)
                if far <= limit and not any(frozenset((i, j)) in apart for i in a for j in b) and (best is None or (far, a[0], b[0]) < best[:3]):
                    best = (far, a[0], b[0], a, b)
            if not best:
                return {i: min(g) for g in groups for i in g}
            groups.remove(best[4])
            best[3].extend(best[4])
            best[3].sort()

    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    for limit in (0.3, 0.6):
        pairs = pairs_within(df, "id", "v", limit)
        assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if round(1 - x[i] @ x[j], 9) <= limit}
        got = dict(complete_linkage(df, spark.createDataFrame(cannot, "a int, b int"), "id", "v", pairs.select("a", "b"), limit).collect())
        assert got == brute(limit)
    assert merge_members(np.array([[0.0]]), np.array([[True]]), 1.0).tolist() == [0]


@pytest.mark.parametrize("task_pairs", [0, 60, 10**6])
def test_linkage_of_large_components(spark, monkeypatch, task_pairs):
    monkeypatch.setattr(C, "MAX_MEMBERS", 8, raising=False)
    monkeypatch.setattr(C, "DENSE_MEMBERS", 8, raising=False)
    monkeypatch.setattr(C, "TASK_PAIRS", task_pairs, raising=False)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, (50, 6)).astype(float)  # many equal distances
    x[:, 0] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cannot = [(0, 1), (12, 9), (3, 30), (5, 6), (40, 2)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    allowed = np.ones((50, 50), bool)
    for a, b in cannot:
        allowed[a, b] = allowed[b, a] = False
    got = dict(complete_linkage(df, spark.createDataFrame(cannot, "a int, b int"), "id", "v", pairs_within(df, "id", "v", 0.2).select("a", "b"), 0.2).collect())
    want = merge_members(np.round(1 - x @ x.T, 9), allowed, 0.2).tolist()
    assert got == dict(enumerate(want)) and 3 < len(set(want)) < 25


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [1.0])], "id int, v array<double>")
    got = top_neighbors(df.where("id < 5"), df, "id", "v", 4).collect()
    for i in range(5):
        s = np.round(x @ x[i], 6)
        s[i] = -np.inf
        assert [r.neighbor for r in sorted(got, key=lambda r: r["rank"]) if r.id == i] == np.lexsort((np.arange(60), -s))[:4].tolist()
    m = mean_vector(spark.createDataFrame([("a", [3.0, 4.0, 0.0])], "k string, v array<double>"), "k", "v").first().mean
    assert np.allclose(m, [0.6, 0.8, 0])


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    L = F.lit
    assert get(N.minutes_seconds(L(743.9))) == "12:23" and get(N.minutes_seconds(L(7205.0))) == "120:05"
    assert get(N.parse_minutes_seconds(L("12:23"))) == 743 and get(N.parse_minutes_seconds(L("1:75"))) is None
    assert round(get(N.iou((L(0), L(0), L(10), L(10)), (L(0), L(0), L(10), L(10)))), 6) == 1 and get(N.iou((L(0), L(0), L(1), L(1)), (L(5), L(5), L(6), L(6)))) == 0
    assert get(X.caption_echoes_text(L("the words victoria line"), L("Victoria Line"))) and not get(X.caption_echoes_text(L(""), L("")))
    assert get(X.joined_document(L("a train"), L(" "), L("EMBANKMENT"))) == "a train. EMBANKMENT"
    assert get(X.occurrences(L("go go go"), "go")) == 3 and get(X.occurrences(L(None).cast("string"), "go")) == 0
    assert get(X.is_title_card(L("Amber Line"), L(""))) and not get(X.is_title_card(L("Amber Line northbound platform"), L("a sign")))
    assert get(X.is_signage(L("EMBANKMENT"))) and get(X.is_signage(L("Charing Cross"))) and not get(X.is_signage(L("Son"))) and not get(X.is_signage(L("London Experian Credit")))
    w = get(N.wilson(L(11), L(11)))
    assert w.hi == 1.0 and w.lo < 0.8 and tuple(get(N.wilson(L(0), L(0)))) == (0.0, 1.0)
    assert get(X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0)) == 1.0
    assert X.first_json_array('Sure: ```json\n[{"a": [1]}]\n``` done') == '[{"a": [1]}]' and X.first_json_array("none [") is None
    assert X.collapse_repetition("All is well. Then the the the the the end") == "All is well."
    snap = X.snap_to_lexicon_python(["Metropolitan", "Line"])
    got = spark.createDataFrame([("Metropolite",), ("tine",), ("Water",), (None,)], "w string").select(snap("w").alias("v")).collect()
    assert [r.v for r in got] == ["Metropolitan", "line", "Water", None]


def test_search(spark):
    df = spark.createDataFrame([(0, "Welcome to the station", "a"), (1, None, "an embankmnt sign"), (2, "welcome", "x")], "id int, ocr_text string, caption string")
    assert [r.id for r in search(df, "welcome").collect()] == [0, 2] and search(df, "  ").count() == 0
    assert search(df, "embankment", ("caption",)).count() == 0 and search(df, "embankment", ("caption",), fuzzy=True).first().score == 1
    assert search(df, "W[a-z]+", regex=True).count() == 2
    r = [spark.createDataFrame([(k, i + 1) for i, k in enumerate(x)], "k int, rank int") for x in ([1, 2, 3], [1, 3, 4])]
    assert [x.k for x in reciprocal_rank_fusion(r, "k").orderBy(F.desc("score"), "k").collect()] == [1, 3, 2, 4]


def test_ordered_rows_across_buckets(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randint(0, 300)), i, rng.choice("ab")) for i, g in enumerate("xxxxxxxxyy" * 12)] + [("x", None, 500, "a"), (None, 1.0, 501, "b"), (None, 99.0, 502, "b")]
    df = spark.createDataFrame(rows, "g string, t double, i int, v string")
    order = sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    before, count, island = {}, {}, {}
    for g, part in itertools.groupby(order, key=lambda r: r[0]):
        last, n, k = None, 0, -1
        for r in part:
            n += r[3] == "a"
            k += last is None or last[3] != r[3]
            before[r[2]], count[r[2]], island[r[2]] = last and last[3], n, k
            last = r
    got = with_previous(df, ["g"], ["t", "i"], ["v"], 25.0).collect()
    assert len(got) == len(rows) and {r.i: r.prev and r.prev.v for r in got} == before
    got = running_count(df.withColumn("a", F.col("v") == "a"), ["g"], ["t", "i"], "a", "n", 25.0).collect()
    assert {r.i: r.n for r in got} == count
    assert {r.i: r.island for r in islands(df, ["g"], ["t", "i"], lambda p: F.col("v") != p["v"], ["v"], 25.0).collect()} == island


def test_farthest_within(spark):
    x = np.random.default_rng(7).standard_normal((90, 5))
    g = [i % 3 if i < 88 else i for i in range(90)]
    df = spark.createDataFrame([(a, [float(v) for v in r]) for a, r in zip(g, x)] + [(None, [1.0] * 5), (1, None)], "g int, v array<double>")
    want = {k: round(min(x[i] @ x[j] for i in range(90) for j in range(i) if g[i] == g[j] == k), 6) for k in range(3)}
    assert dict(farthest_within(df, "g", "v", block_rows=7).collect()) == want


def test_scene_cuts(spark):
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    rows = [(i, float(i), v[c], False) for i, c in enumerate("aaaaaabbaaaaaa")]
    df = spark.createDataFrame(rows, "i int, t double, v array<double>, card boolean").withColumn("g", F.lit(1))
    assert [r.scene for r in scene_cuts(df, "g", "i", "t", "v", "card").orderBy("i").collect()] == [0] * 8 + [1] * 6
    card = df.withColumn("card", F.expr("i in (6, 7)"))
    assert [r.scene for r in scene_cuts(card, "g", "i", "t", "v", "card").orderBy("i").collect()] == [0] * 6 + [1] * 2 + [2] * 6


def test_narration(spark):
    df = spark.createDataFrame([(1, "lead\n## Amber Line\nbody one\nbody two\n### Other\nrest")], "k int, t string")
    got = {r.label: r.body for r in T.sections(df, "k", "t", ["Amber Line"]).collect()}
    assert got == {"Introduction": "lead", "Amber Line": "body one\nbody two\n### Other\nrest"}
    reply = '```json\n[{"timestamp": "0:05", "description": "x"}, {"timestamp": "9:99", "description": "y"}, {"timestamp": "1:00", "description": " "}]\n```'
    e = T.timeline_events(spark.createDataFrame([(1, reply), (2, None), (3, "no")], "k int, r string"), "k", "r", 100).collect()
    assert [(x.k, x.sec) for x in e] == [(1, 5)]


def test_models_and_stages(spark, tmp_path):
    req = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p2"), (None, "p3")], "k string, p string")
    rec = spark.createDataFrame([("a", "old")], "k string, r string")
    assert dict(memoised(req, rec, "k", "p", "r", lambda: lambda p: p.upper()).collect()) == {"a": "old", "b": "P2"}
    calls = []

    def busy(p):
        calls.append(p)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert with_retries(busy, sleep=lambda s: None)("x") == "ok" and len(calls) == 3
    s = Stages(tmp_path / "stages.json")
    out = tmp_path / "o"
    assert s.stale("a", [out], {"x": 1})
    with s.run("a", {"x": 1}):
        out.write_text("1")
    assert not s.stale("a", [out], {"x": 1}) and s.stale("a", [out], {"x": 2}) and s.stale("a", [out], {"x": 1}, force=True)
    with pytest.raises(ValueError), s.run("b"):
        raise ValueError
    assert set(s.load()) == {"a"} and fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})
    assert guarded({"x": lambda: 1, "y": lambda: 1 / 0}) == {"x": 1, "y": None}
