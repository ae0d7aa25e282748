"""Cases in which data could get lost: restarted merges, failing renames, brackets within strings."""

import os

import pytest

from framewright.functions.text import first_json_array
from framewright.sources import artifacts
from framewright.streaming import events


def test_restarted_merge_keeps_earlier_keys(spark, tmp_path):
    schema = "k long, ts long, x string"
    source, table, checkpoint = (str(tmp_path / x) for x in ("source", "table", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: events.upsert_into(spark.readStream.schema(schema).parquet(source), table, ["k"], "ts", checkpoint).awaitTermination()
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(2, 5, "c")], [(3, 1, "d"), (2, 2, "late")], [(4, 1, "e")]):
        write(rows)
        run()
    got = {tuple(r) for r in events.read_upserted(spark, table).collect()}
    assert got == {(1, 1, "a"), (2, 5, "c"), (3, 1, "d"), (4, 1, "e")}
    # A version without its success mark isn't read.
    newest = events.versions(spark, table)[-1]
    os.remove(f"{table}/{newest}/_SUCCESS")
    assert events.versions(spark, table)[-1] != newest
    with pytest.raises(FileNotFoundError):
        events.read_upserted(spark, str(tmp_path / "nothing"))


def test_failing_rename_keeps_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    artifacts.write_atomic(spark.range(3), path)
    monkeypatch.setattr(artifacts, "_renamed", lambda *a: False)
    with pytest.raises(OSError, match="old one is unchanged"):
        artifacts.write_atomic(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]
    monkeypatch.undo()
    artifacts.write_atomic(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9 and sorted(os.listdir(tmp_path)) == ["t"]


@pytest.mark.parametrize("text, want", [('So: [{"a": "x ] y"}] done', '[{"a": "x ] y"}]'), ('["a \\" ] b", 1]', '["a \\" ] b", 1]'), ('He said "x" and then [1]', "[1]"), ("[1, 2", None), (None, None), ('["a]', None)])
def test_json_array_with_brackets_in_strings(text, want):
    assert first_json_array(text) == want
