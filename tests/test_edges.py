"""Queries over empty tables and over nulls in any column: they end, with a defined schema."""

import pytest

from tests.edges import write
from tests.oracle import DATA
from tests.test_queries import CORE

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
NAMES = """p5_found occurrence_stats scene_of_frame segments_of_frame event_as_of next_frame_match nearest_labelled track_templates medoids scene_numbers group_consecutive lexical_search
fuzzy_search semantic_search visual_search fused_search linkage appearance_linkage apply_merges worst_within_cluster silhouette cluster_scores timeline story_sections scene_digest json_arrays
lexicon_snap collapse_repetition keyed_upsert stream_windows scene_build prompt_strategies best_shot_linkage merge_proposals derived_findings story_report next_frame_match index_order timeline_validity
batch_reply grounded_replies tracked_boxes stream_tracks face_seam enlarged_seam text_seam embedding_seam language_seam identity_ranking neighbors_per_row""".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edges"))


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", NAMES)
def test_query_ends(spark, folder, name, kind):
    assert CORE[name](spark, str(folder / kind)).count() >= 0
