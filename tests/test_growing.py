import json
import os

import pytest
from pyspark.sql import functions as F

from strataspark.sources.growing import GrowingReader, growing_lines
from strataspark.streaming import jobs


def said(text):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}, "sessionId": "s"})


def ended(query):
    done = query.awaitTermination(120)
    query.stop()
    assert done


def test_appended_truncated_and_restarted(spark, tmp_path):
    land, out = tmp_path / "land/sub", tmp_path / "out"
    land.mkdir(parents=True)
    calls = {}

    def ingest():
        lines = jobs.transcript_stream(spark, str(tmp_path / "land"), split_bytes=64)
        stored = jobs.parse_lines(lines, "A").where("content is not null").select("content", "session")
        ended(jobs.store_stream(stored, str(out), str(tmp_path / "cp"), lambda rows, n: calls.setdefault(n, sorted(r.content for r in rows.collect()))))
        return sorted(r.content for r in spark.read.parquet(str(out)).collect())

    one, two = land / "one.jsonl", land / "two.jsonl"
    half = said("broken in the middle")
    one.write_text(said("first") + "\n" + said("second") + "\n" + half[:30])
    two.write_text(said("other") + "\n" + said("no line end"))
    assert ingest() == ["first", "no line end", "other", "second"]
    with one.open("a") as file:
        file.write(half[30:] + "\n")
    with two.open("a") as file:
        file.write("\n" + said("appended") + "\n")
    now = ["appended", "broken in the middle", "first", "no line end", "other", "second"]
    assert ingest() == now
    assert ingest() == now  # a restart without anything new
    two.write_text(said("written anew") + "\n")
    (land / "three.jsonl").write_text("")
    (land / "one.1.jsonl").write_text(said("segment"))
    now = sorted([*now, "written anew", "segment"])
    assert ingest() == now
    assert sorted(x for v in calls.values() for x in v) == now  # every batch's rows were handed on once
    assert calls[1] == ["appended", "broken in the middle"]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_once_whatever_the_split(tmp_path, split):
    lines = ["", "a", "x" * 50, "é" * 9, "  ", "b", "", "last"]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    (tmp_path / "_hidden").write_text("no\n")
    reader = GrowingReader(str(tmp_path), split)
    end = reader.latestOffset()
    got = [x for p in reader.partitions(reader.initialOffset(), end) for x in reader.read(p)]
    assert [v for _, _, v in got] == [v for v in lines if v.strip()]
    data = (tmp_path / "f").read_bytes()
    assert all(data[at:].startswith(v.encode()) and (at == 0 or data[at - 1 : at] == b"\n") for _, at, v in got)
    assert reader.partitions(end, reader.latestOffset()) == []
    with (tmp_path / "f").open("a") as file:
        file.write("more\nhalf")
    mid = reader.latestOffset()
    assert [x[2] for p in reader.partitions(end, mid) for x in reader.read(p)] == ["more"]
    assert json.loads(mid["files"]) == json.loads(GrowingReader(str(tmp_path), split).latestOffset()["files"])  # a restarted reader sees the same
    (tmp_path / "f").write_text("")
    assert json.loads(reader.latestOffset()["files"]) == {}


def test_a_batch_run_again_hands_on_its_rows(spark, tmp_path):
    src, out, seen = tmp_path / "src", tmp_path / "out", []
    os.mkdir(src)
    (src / "a").write_text("one\ntwo\none\n")

    def run(fail):
        def then(rows, n):
            seen.append((n, sorted(r.content for r in rows.collect())))
            if fail:
                raise RuntimeError("crash between the write and the end of the batch")

        query = jobs.store_stream(growing_lines(spark, str(src)).select(F.col("value").alias("content")), str(out), str(tmp_path / "cp"), then)
        try:
            query.awaitTermination(120)
        except Exception:
            assert fail
        query.stop()

    run(True)
    run(False)
    assert seen == [(0, ["one", "two"])] * 2
    assert sorted(r.content for r in spark.read.parquet(str(out)).collect()) == ["one", "two"]
