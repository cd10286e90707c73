import os

import pytest
from pyspark.sql import functions as F

from strataspark.plans.store import MemoryTable
from strataspark.schema import EDGES, MEMORIES
from strataspark.sources import sinks
from tests.test_store import T, memory


def edge(a, b):
    return (a, b, "supports", 0.5, T(2024, 1, 1))


def test_backup_of_rows_and_edges(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.createDataFrame([memory(f"m{i}", i % 5 + 1) for i in range(6)], MEMORIES)
    edges = spark.createDataFrame([edge("m1", "m2"), edge("m2", "m9"), edge("m9", "m1"), edge("m3", "m3"), edge("m4", None)], EDGES)
    sinks.write_backup(rows, edges, path, "20240101-000000")
    with pytest.raises(FileExistsError):
        sinks.write_backup(rows.limit(1), edges, path, "20240101-000000")
    # a crash before the mark: it doesn't count, and is written over
    sinks.write_backup(rows.limit(2), edges.limit(0), path, "20240102-000000")
    os.remove(tmp_path / "b" / "ts=20240102-000000" / "_SUCCESS")
    assert [r.ts for r in sinks.list_snapshots(spark, path).collect()] == ["20240101-000000"]
    with pytest.raises(FileNotFoundError):
        sinks.read_backup(spark, path, "20240102-000000")
    now = rows.where("id <> 'm2'")
    sinks.write_backup(now, edges, path, "20240102-000000")
    old_rows, old_edges = sinks.restore_backup(spark, path, "20240101-000000", now.limit(0), edges, "20240103-000000")
    assert old_rows.count() == 6 and {(r.from_id, r.to_id) for r in old_edges.collect()} == {("m1", "m2"), ("m3", "m3")}
    assert {(r.from_id, r.to_id) for r in sinks.read_backup(spark, path, "20240102-000000")[1].collect()} == {("m3", "m3")}
    assert [d.count() for d in sinks.read_backup(spark, path, "20240103-000000")] == [0, 0]
    assert sorted(sinks.prune_snapshots(spark, path, 1)) == [f"{path}/ts=20240101-000000", f"{path}/ts=20240102-000000"]


def test_a_backup_of_the_store_stays(spark, tmp_path):
    edges = spark.createDataFrame([edge("a", "b"), edge("b", "c")], EDGES)
    table = MemoryTable(spark, edges=edges, path=str(tmp_path / "t"))
    text = lambda *ids: spark.createDataFrame([(i, 5, f"text {i}", {}) for i in ids], "id string, layer int, content string, attrs map<string,string>")
    table.store(text("a", "b"), T(2024, 1, 1))
    table.backup(str(tmp_path / "b"), "20240101-000000")
    table.store(text("c"), T(2024, 1, 2))
    table.backup(str(tmp_path / "b"), "20240102-000000")
    read = lambda ts: sinks.read_backup(spark, str(tmp_path / "b"), ts, table.snapshot().schema)
    assert [d.count() for d in read("20240101-000000")] == [2, 1] and [d.count() for d in read("20240102-000000")] == [3, 2]
    assert read("20240101-000000")[0].where(F.col("id") == "c").isEmpty()
