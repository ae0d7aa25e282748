"""Operators for training data against brute force, round trips and stated cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, leaks, neighbors, pairs, pii, pii_spans, queries, segments
from framewright.llm.components import components
from framewright.llm.p2_components import confirmed_groups
from tests.oracle import DATA, assert_equal

needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_equal(spark, name, queries.QUERIES[name], queries.SQL[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


# ---------------------------------------------------------------- 1


def _clustered(rng, n=900, dim=16):
    c = rng.standard_normal((25, dim))
    x = c[rng.integers(0, 25, n)] + 0.4 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_neighbors_recall(spark):
    x = _clustered(np.random.default_rng(1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "f long, e array<float>").repartition(5)
    got = neighbors.nearest_neighbors(df, "f", "e", 16, k=10, probes=8).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    found = set(zip(got["id"], got.neighbor))
    assert np.mean([(i, j) in found for i in range(len(x)) for j in top[i]]) >= 0.9
    assert np.allclose(got.cosine, [s[i, j] for i, j in zip(got["id"], got.neighbor)], atol=1e-4)


@pytest.mark.parametrize("how", [dict(max_lists=8), dict(max_lists=40, cell_rows=120, cell_queries=200), dict(list_rows=10, cell_rows=20)])
def test_recall_with_divided_lists_blocks_and_many_cells(spark, how):
    # As a large input meets them: lists far longer than planned, cells cut into blocks and parts, over a hundred cells.
    x = _clustered(np.random.default_rng(3), 2400)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "f long, e array<float>").repartition(5)
    got = neighbors.nearest_neighbors(df, "f", "e", 16, k=10, **({"list_rows": 40, "probes": 8} | how)).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    found = set(zip(got["id"], got.neighbor))
    assert np.mean([(i, j) in found for i in range(len(x)) for j in top[i]]) >= 0.9
    assert not got.duplicated(["id", "neighbor"]).any() and not (got["id"] == got.neighbor).any()


def test_large_groups_of_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.1 * (i % 50 == 0)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    plain = lambda **c: sorted(map(tuple, neighbors.nearest_neighbors(df, "id", "v", 4, k=3, **c).select("id", "neighbor", "rank").collect()))
    assert plain(hot_copies=100) == plain() and len(plain()) == 1200


def test_abandoning_loses_little():
    x = _clustered(np.random.default_rng(2), 500, 64) @ neighbors.rotation(64)
    d = 2 - 2 * x @ x.T
    for limit in (0.2, 0.8):
        i, j, dist = neighbors.scan_list(x, x, np.full(len(x), limit, np.float32))
        want = {(a, b) for a, b in zip(*np.nonzero(d <= limit - 1e-4))}
        got = set(zip(i, j))
        assert len(want - got) <= 0.01 * len(want) and np.allclose(dist, d[i, j], atol=1e-4)


def test_neighbors_edge_cases(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, [2.0 * a for a in v]) for i in range(30)] + [(40, w), (41, [0.1, 1.0, 0.0, 0.0]), (41, [0.1, 1.0, 0.0, 0.0]), (50, None), (51, []), (52, [0.0] * 4), (53, [float("nan"), 1.0, 0.0, 0.0]), (54, [1.0]), (None, v), (55, [None, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("h", F.lit("clash"))
    got = neighbors.nearest_neighbors(df, "id", "v", 4, k=3, min_cosine=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r.neighbor))
    assert set(by) == set(range(30)) | {40, 41}
    assert [n for _, n in sorted(by[0])] == [1, 2, 3] and [n for _, n in sorted(by[29])] == [0, 1, 2] and by[40] == [(1, 41)] and by[41] == [(1, 40)]
    assert neighbors.nearest_neighbors(df.where("1 = 0"), "id", "v", 4).count() == 0
    assert neighbors.nearest_neighbors(df.where("id = 40"), "id", "v", 4).count() == 0


# ---------------------------------------------------------------- 2


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"m{i:03d}") for i in range(50)] + [(f"r{rng.randint(0, 80)}", f"r{rng.randint(0, 80)}") for _ in range(60)] + [("x", "x"), (None, "q"), ("n001", "n000")]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        if a and b and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for a in parent:
        groups.setdefault(find(a), []).append(a)
    want = {a: min(g) for g in groups.values() for a in g}
    df = spark.createDataFrame(links, "p string, q string").withColumn("src", F.lit(1))
    for hub_links in (200_000, 20):  # with 20 the hub, and the larger clusters, are joined apart
        got = components(df, "p", "q", hub_links=hub_links).collect()
        assert {r.member: r.group_id for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([("x", "x")], "p string, q string"), "p", "q").count() == 0


def test_confirmed_groups(spark):
    c = spark.createDataFrame([(" Face_02", "FACE_01", "Same "), ("face_02", "Face_03", "TRUE"), ("Face_04", "unknown", "same"), ("Face_05", None, "y"), ("Face_06", "Face_06 ", "1"), ("Face_07", "Face_08", "same?"), ("Face_01", "Face_03", "different")], "face_a string, face_b string, verdict string")
    i = spark.createDataFrame([("Face_01",), ("Face_02",), ("Face_03",), (None,)], "face_id string")
    assert {tuple(r) for r in confirmed_groups(c, i).collect()} == {("Face_01", f"Face_0{k}") for k in (1, 2, 3)}


# ---------------------------------------------------------------- 3


def test_segmentation_is_optimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 9)
        cost = np.array([rng.choice([0.0, 0.3, 0.9, 1.0, 1.7, float("inf")]) for _ in range(n)])
        forced = np.array([rng.random() < 0.15 for _ in range(n)])

        def total(cuts):
            t = 0.0
            for i in range(1, n):
                if i in cuts:
                    t += 0.0 if forced[i] or np.isinf(cost[i]) else 1.0
                else:
                    t += np.inf if forced[i] or np.isinf(cost[i]) else cost[i]
            return t

        best = min((total(set(c)), len(c)) for k in range(n) for c in itertools.combinations(range(1, n), k))
        got = segments.segment(cost, forced).tolist()
        assert got[0] == 0 and (round(total(set(got[1:])), 9), len(got) - 1) == (round(best[0], 9), best[1])


def test_drifting_events_are_cut_where_they_change_most():
    rng = random.Random(14)
    differs = 0
    for _ in range(300):
        x = np.cumsum([rng.choice([0.0, 0.2, 0.5, 0.8, 1.0, 1.4]) * rng.choice([-1, 1, 1]) for _ in range(rng.randint(1, 10))])
        n = len(x)
        cost = np.abs(np.diff(x, prepend=x[:1]))
        cost = np.where(cost > 1, np.inf, cost)
        forced = np.array([rng.random() < 0.1 for _ in range(n)])
        fits = lambda a, b: abs(x[a] - x[b]) <= 2.0 + 1e-9

        def total(cuts):
            t, start = 0.0, 0
            for i in range(1, n):
                wall = forced[i] or np.isinf(cost[i])
                if i in cuts:
                    t, start = t + (0.0 if wall else 1.0), i
                else:
                    t += np.inf if wall or not fits(start, i) else cost[i]
            return t

        best = min((round(total(set(c)), 9), len(c)) for k in range(n) for c in itertools.combinations(range(1, n), k))
        got = segments.segment(cost, forced, fits=fits).tolist()
        assert got[0] == 0 and (round(total(set(got[1:])), 9), len(got) - 1) == best
        differs += got[1:] != [i for i in range(1, n) if forced[i] or np.isinf(cost[i])]
    assert differs > 30  # the program decides: a threshold on neighbours gives other runs


def test_text_that_changes_bit_by_bit(spark):
    texts = ["abcdefghijklmnop"]
    for i in range(16):
        texts.append(texts[-1][:i] + "z" + texts[-1][i + 1 :])
    df = spark.createDataFrame([("v", i, float(i), t, "") for i, t in enumerate(texts)], "video string, frame long, t double, o string, c string")
    got = sorted((r.first_key, r.last_key) for r in segments.collapse_runs(df, "video", "frame", "t", "o", "c").collect())
    assert len(got) == 2 and got[0][0] == 0 and got[-1][1] == 16
    noisy = [(i, "the same sign" if i % 3 else "the sane sjgn") for i in range(40)]
    df = spark.createDataFrame([("v", i, float(i), t, "") for i, t in noisy] + [("v", 3, 90.0, "another", "")], "video string, frame long, t double, o string, c string")
    assert sorted((r.first_key, r.n_events) for r in segments.collapse_runs(df, "video", "frame", "t", "o", "c").collect()) == [(0, 40), (3, 1)]


def test_edit_distance():
    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (prev := row) else (lambda new: [new.append(min(prev[j] + 1, new[j - 1] + 1, prev[j - 1] + (x != b[j - 1]))) or new for j in range(1, len(b) + 1)] and new or new)([i])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "xy")
        assert segments.edit_distance(a, b, 99) == plain(a, b)
    assert segments.edit_distance("a" * 3000, "b" * 3000, 750) == 751


def test_runs_across_chunks_and_edge_cases(spark):
    rows = [("v", i, float(i) * 9, "SAME SIGN", None) for i in range(200)]  # crosses three chunks
    rows += [("v", 300, 1795.0, "same sjgn!", ""), ("v", 301, 1796.0, None, " "), ("v", 302, 1797.0, "SAME SIGN", ""), ("w", 1, 1.0, "7 MIN", "x"), ("w", 2, 2.0, "8 MIN", "x"), ("w", 2, 2.0, "8 MIN", "x"), (None, 5, 1.0, "a", "b"), ("w", 9, None, "a", "b"), ("w", 10, float("nan"), "a", "b")]
    df = spark.createDataFrame(rows, "video string, frame long, t double, o string, c string").withColumn("run", F.lit(0))
    got = {(r.entity, r.first_key, r.last_key, r.n_events) for r in segments.collapse_runs(df, "video", "frame", "t", "o", "c", chunk_sec=600.0).collect()}
    assert got == {(r.entity, r.first_key, r.last_key, r.n_events) for r in segments.collapse_runs(df, "video", "frame", "t", "o", "c").collect()}
    assert got == {("v", 0, 300, 201), ("v", 302, 302, 1), ("w", 1, 1, 1), ("w", 2, 2, 1)}
    assert segments.collapse_runs(df.where("1 = 0"), "video", "frame", "t", "o", "c").count() == 0


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize(
    "prompt, response, limit, want",
    [
        ("Describe it.", None, 64, "empty"), ("Describe it.", "```json\n```", 64, "empty"), ("Describe it.", "{ } “”…", 64, "empty"),
        ("Describe it.", "I'm sorry, but I can't help with that. Please ask the operator.", 64, "refusal"), ("Beschreibe die Szene bitte.", "Als Sprachmodell kann ich dabei nicht helfen.", 64, "refusal"),
        ("Describe it.", 'The notice says "I cannot help". The train leaves the station.', 64, None), ("Describe it.", "I cannot name the people, but the scene is clear. A train leaves.", 64, None),
        ("Write two sentences about the lift near the gate.", "> Write two sentences about the lift near the gate.", 64, "copy"), ("Write two sentences about the lift near the gate.", "The lift near the gate is out of order today and nobody uses it.", 64, None),
        ("Write two sentences in German about the lift.", "The lift is at the end of the hall and it is out of order.", 64, "language"), ("Write two sentences in German about the lift.", "Der Aufzug ist am Ende der Halle und fährt nicht.", 64, None),
        ("Tell the story of the line.", "The train leaves the station and the crowd wal", 12, "truncated"), ("Tell the story of the line.", "The train leaves the station and the crowd walks.", 12, None), ("Tell the story of the line.", "The train leaves the station and the crowd wal", None, None),
        ("List it as a JSON array.", '[{"a": "the train leaves the hall"}, {"a": "the tr', 12, "truncated"), (None, "The train leaves.", 64, None),
    ],
)
def test_defects(prompt, response, limit, want):
    assert pairs.defect_of(prompt, response, limit) == want


def test_tiling():
    p = "a b c d e f g h".split()
    assert pairs.tile(p, p) == (1.0, 1.0, 0)
    assert pairs.tile(p, "x a b c y e f g".split()) == (6 / 8, 6 / 8, 2)
    assert pairs.tile([], []) == (0.0, 0.0, 0)


def test_defects_frame(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "Describe it.", "Fine, a train.", 64), (None, "a", "", 1)], "k long, prompt string, response string, n int").withColumn("defect", F.lit("clash"))
    assert [tuple(r) for r in pairs.find_defects(df, "k", "prompt", "response", "n").collect()] == [(1, "empty")]
    assert pairs.find_defects(df.where("1 = 0"), "k", "prompt", "response", "n").count() == 0
    long = "word " * 60000
    assert pairs.defect_of(long, long, 10) == "copy"


# ---------------------------------------------------------------- 6


def test_bpe_equals_merging(spark):
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.encoder()
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ids, special_tokens={})
    rng = random.Random(6)
    texts = ["", "a" * 5000, " \n\t  x", "<|endoftext|>", "日本語 🚇‍ é"] + ["".join(rng.choice("aab cdetheing's \n01éß日🚇") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in texts:
        ids = e.encode(t)
        assert ids == ref.encode_ordinary(t) and e.decode(ids) == t
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:20], None])], "doc long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode_texts(df, "doc", "text")
    assert {r.doc: r.ids for r in got.collect()} == {i: e.encode(t or "") for i, t in enumerate([*texts[:20], None])}
    assert {r.doc: r.text for r in bpe.decode_ids(got, "doc").collect()} == {i: t or "" for i, t in enumerate([*texts[:20], None])}
    assert bpe.encode_texts(df.where("1 = 0"), "doc", "text").count() == 0


# ---------------------------------------------------------------- 7


def _item(rng, n=40):
    return [f"w{rng.randint(0, 60)}" for _ in range(n)]


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(7)
    index = leaks.ItemIndex([(i, _item(rng)) for i in range(120)])
    for _ in range(200):
        terms = {f"w{rng.randint(0, 70)}" for _ in range(rng.randint(1, 25))}
        want = [i for i in range(len(index.ids)) if sum(index.weight[t][index.at[t].tolist().index(i)] for t in terms if i in index.at.get(t, ())) >= 1.0]
        assert index.search(terms) == want
        assert index.may_score([set(), terms])[1].any() or not want


def test_wand_over_wide_blocks():
    rng = random.Random(17)
    index = leaks.ItemIndex([(i, [f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randint(15, 40))]) for i in range(1500)], wide_blocks=5)
    assert index.width > 1 and index.wide_max.shape[1] <= 5
    for _ in range(100):
        terms = set(rng.choice(index.words)) if rng.random() < 0.5 else {f"w{int(rng.expovariate(0.01))}" for _ in range(30)}
        score = np.zeros(len(index.ids))
        for t in terms & set(index.at):
            score[index.at[t]] += index.weight[t]
        assert index.search(terms) == np.flatnonzero(score >= 1 - 1e-9).tolist()


def test_quotations():
    rng = random.Random(8)
    item = [f"u{i}" for i in range(40)]
    filler = lambda n: [f"f{rng.randint(0, 99)}" for _ in range(n)]
    q = item[5:20]
    assert leaks.quotes(item, filler(30) + q + filler(30)) and not leaks.quotes(item, filler(9) + item[5:19] + filler(9))
    changed = q[:7] + ["x"] + q[8:]
    assert leaks.quotes(item, filler(3) + changed) and not leaks.quotes(item, filler(3) + q[:4] + ["x"] + q[5:9] + ["y"] + q[10:] + filler(3))
    assert leaks.quotes(item, item[:12] + ["x", *item[12:24]]) and leaks.quotes(item, item[:12] + item[13:24])


def test_leaks_frame(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(25)]
    part = items[3][1].split()[10:28]
    docs = [(1, "Intro.\n[0:12] uh " + " ".join(part[:9]).upper() + "\n> **" + ", ".join(part[9:]) + "** end"), (2, " ".join(items[4][1].split()[:12])), (3, None), (4, ""), (5, part[0][:4] + "-\n" + part[0][4:] + " " + " ".join(part[1:])), (5, " ".join(part)), (None, items[0][1])]
    got = leaks.leaked_items(spark.createDataFrame(docs, "d long, t string").withColumn("i", F.lit(0)), spark.createDataFrame(items + [(99, None), (None, "x")], "i long, t string"), "d", "t", "i", "t").collect()
    assert {tuple(r) for r in got} == {(1, 3), (5, 3)}


# ---------------------------------------------------------------- 8


TEXT = "Lives at Flat 19, 230 Wexley St., Ostham. Call +44 (0)20 7946 0230 or write to anna.test+x (at) mail.example.\nSpeaker: Dr Helen Brackello. Ticket 0840 4676 7687 is not valid. NINO: QQ 50 95 64 C"


def test_candidates_start_where_they_should():
    got = {(s.family, TEXT[s.start : s.start + 5]) for s in pii_spans.spots_of(TEXT)}
    assert {("address", "Flat "), ("phone", "44 (0"), ("email", "anna."), ("name", "Helen"), ("id_number", "QQ 50")} <= got


def test_vote_model_prefers_agreement():
    m = pii.VoteModel({"a=name b=name": 80, "a=name": 15, "b=none": 60, "a=name b=none": 5})
    assert m.probability("a=name b=name") > 0.9 > 0.5 > m.probability("b=none") and 0 <= m.probability("c=name") <= 1


def test_detection_and_redaction(spark):
    rows = [(i, TEXT.replace("230", str(200 + i))) for i in range(40)] + [(100, None), (101, ""), (102, "Car number 020-5700 stood at Lindal Mill."), (103, "x " * 50000), (None, TEXT)]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("spots", F.lit(1))
    found = pii.detect(df, "doc", "text")
    first = sorted((r.pii_type, TEXT[r.start_pos :][:4]) for r in found.where("doc = 30").collect())
    assert first == [("address", "Flat"), ("email", "anna"), ("id_number", "QQ 5"), ("name", "Hele"), ("phone", "44 (")]
    assert found.where("doc >= 100").count() == 0
    red = {r.doc: r.text for r in pii.redact(df, "doc", "text", found).collect()}
    assert red[30] == "Lives at [ADDRESS]. Call +[PHONE] or write to [EMAIL].\nSpeaker: Dr [NAME]. Ticket 0840 4676 7687 is not valid. NINO: [ID_NUMBER]" and red[100] is None and red[102] == rows[42][1]
    assert pii.detect(df.where("1 = 0"), "doc", "text").count() == 0
