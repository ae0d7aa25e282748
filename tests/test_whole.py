"""Queries over all rows: against their SQL without the clauses that keep a part of the rows, and against stated cases."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framewright.plans import aggregates, clustering, evaluation, joins, narration, predicates, retrieval, windows
from tests.oracle import DATA, connection, rows

tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def assert_whole(spark, plans, name, clause, folder=DATA):
    """The query equals its SQL without ``clause``, which keeps a part of the rows."""
    mine, theirs = plans.QUERIES[name](spark, str(folder)).toPandas(), connection(folder).sql(plans.SQL[name].replace(clause, "")).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)
    return len(mine)


def write(folder, **data):
    for name, columns in data.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@tables
@pytest.mark.parametrize("name, clause", [("corroborated_clusters", " where frame_id % 50 = 0"), ("prefer_quality", " where frame_id % 10 = 0")])
def test_aggregates_of_all_detections(spark, name, clause):
    assert assert_whole(spark, aggregates, name, clause)


@tables
@pytest.mark.parametrize("name, clause", [("cannot_link", " where a.frame_id % 5 = 0"), ("co_occurrence", " and frame_id % 3 = 0")])
def test_pairs_of_all_frames(spark, name, clause):
    assert assert_whole(spark, clustering, name, clause)


@pytest.mark.parametrize("plans, name", [(joins, "track_continuity"), (evaluation, "continuity_recall")])
def test_continuity_of_all_detections(spark, tmp_path, plans, name):
    rng = random.Random(4)
    det = [(frame, part) for part in range(1, 61) for start in [rng.randint(1, 900)] for frame in {start + rng.randint(0, 40) for _ in range(5)}]
    n = len(det)
    lineitem = dict(l_orderkey=[f for f, _ in det], l_linenumber=[1 + i % 7 for i in range(n)], l_partkey=[p for _, p in det], l_suppkey=[1 + p % 2 for _, p in det])
    lineitem |= dict(l_quantity=[float(rng.randint(30, 50)) for _ in det], l_extendedprice=[30000.0] * n, l_discount=[0.05] * n, l_tax=[0.02] * n, l_returnflag=["R"] * n)
    folder = tmp_path / "tracks"
    folder.mkdir()
    write(folder, lineitem=lineitem, part=dict(p_partkey=list(range(1, 61)), p_size=[10] * 60))
    assert assert_whole(spark, plans, name, " where frame_id % 4 = 0", folder)
    if name == "continuity_recall":
        assert plans.QUERIES[name](spark, str(folder)).first().n_pairs > 50


@tables
@pytest.mark.parametrize("name", ["event_as_of", "scene_as_of", "scene_start_covered", "timeline_in_scenes"])
def test_all_events(spark, name):
    assert assert_whole(spark, joins, name, " and frame_id % 7 = 0")


def test_share_of_all_events(spark, tmp_path):
    f = dict(frame_id=[1, 2, 7, 8], video_id=["v"] * 4, timestamp_sec=[1.0, 2.0, 7.0, 20.0], event_description=["a", None, "b", "c"], scene_index=[0, 0, 0, None])
    d = write(tmp_path, frame_metadata=f)
    assert joins.timeline_in_scenes(spark, d).first().in_scene == 0.666667


def test_texts_beyond_plain_ascii(spark, tmp_path):
    d = write(
        tmp_path,
        llm_cache=dict(request_id=[1, 2, 3, 4], response=["Première ligne.\n\nZweite Zeile – Ende.\n", "<thinking>é\n</thinking>\n\nÜber", "plain", None]),
        frame_metadata=dict(
            frame_id=[1, 2, 3, 4],
            caption=["café sortie ligne", "eine Straße", "le métro\narrive au platform 9 – après", None],
            ocr_text=["SORTIE LIGNE\nCAFÉ", None, "Über Straße", "ÎLES"],
        ),
        documents=dict(doc_id=[1, 2], source=["ocr", "ocr"], text=["Métro  Liné\nGare", " \n"]),
    )
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(narration.strip_reasoning(spark, d)) == {(1, "Première ligne.\n\nZweite Zeile – Ende."), (2, "Über"), (3, "plain")}
    assert got(narration.fix_echoes(spark, d)) == {(1, "a title card that reads: SORTIE LIGNE\nCAFÉ"), (2, "eine Straße"), (3, "le métro\narrive au platform 9 – après"), (4, None)}
    assert got(predicates.signage(spark, d)) == {("SORTIE LIGNE\nCAFÉ", True), ("Über Straße", False), ("ÎLES", True)}
    assert got(predicates.token_gate(spark, d)) == {(1, 1, "Métro"), (1, 2, "Liné"), (1, 3, "Gare")}
    assert got(predicates.filter_tokens(spark, d)) == {(1, "Métro Liné Gare", 3, 81.7)}
    assert got(retrieval.snippets(spark, d)) == {(3, "le métro\narrive au platform 9 – après")}


def test_lexicon_of_all_texts(spark, tmp_path):
    words = [a + b for a in ("garden", "mirror", "bottle", "window", "dragon", "summit") for b in "abcdefghij"]  # more than sixty
    text = ["é " + " ".join(f"{w} {w}" for w in [*words[:59], "platform"]) + " platfrom"]
    d = write(tmp_path, documents=dict(doc_id=[1], source=["ocr"], text=text))
    assert [tuple(r) for r in predicates.lexicon_snap(spark, d).collect()] == [("platfrom", "platform")]


def test_windows_of_long_texts(spark, tmp_path):
    d = write(tmp_path, documents=dict(doc_id=[1, 2, 3], text=["a b c " * 6000, "a b c d", "a"], n_chars=[36000, 7, 1]))
    assert {tuple(r) for r in windows.distinct_ngrams(spark, d).collect()} == {(1, round(3 / 17998, 6)), (2, 1.0), (3, 0.0)}
