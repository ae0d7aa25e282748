"""Batch replies: every index that was asked for, and no list of indices on the driver."""

import json
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.operators import narration as T
from framewright.plans import narration
from tests.oracle import DATA, connection, rows


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_indices_of_any_size(spark, tmp_path):
    at = ["1:30", "99:98", "100:00", "123:46", "123:47", "12345678:20", "21474836:46"]
    replies = [json.dumps([{"timestamp": t, "description": f"at {t}"} for t in at]), '[{"scene_index": -4, "description": "a"}, {"scene_index": 10000, "description": "b"}, {"scene_index": 10000, "description": "c"}]', None]
    pq.write_table(pa.table(dict(request_id=[1, 2, 3], video_id=["v"] * 3, prompt=["p"] * 3, response=replies)), tmp_path / "llm_cache.parquet")
    shutil.copy(DATA / "frame_metadata.parquet", tmp_path)
    mine, theirs = narration.batch_reply(spark, str(tmp_path)).toPandas(), connection(tmp_path).sql(narration.SQL["batch_reply"]).df()
    assert rows(mine) == rows(theirs)
    assert sorted(mine.scene_index) == [-4, 130, 9998, 10000, 10000, 12346, 1234567820, 2147483646]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_rows_of_the_query_are_those_of_its_replies(spark):
    assert "Join" not in narration.batch_reply(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_lists_of_indices_are_not_broadcast(spark):
    r = spark.range(50).select(F.col("id").alias("k"), F.lit('[{"scene_index": 3, "description": "a"}, {"scene_index": 6, "description": "b"}, {"scene_index": 99999999999, "description": "c"}, {"scene_index": "99999999999.5", "description": "d"}]').alias("t"))
    asked = r.select("k", F.explode(F.expr("sequence(0, 98, 2)")).alias("scene_index"))
    got = T.batch_items(r, "k", "t", asked)
    assert {tuple(x) for x in got.collect()} == {(k, 6, "b") for k in range(50)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
