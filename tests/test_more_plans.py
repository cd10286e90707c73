import pytest
from pyspark.sql import functions as F

from strataspark.functions.models import const_completer, hash_embedder
from strataspark.operators import state
from strataspark.plans import compact, search
from strataspark.plans.store import MemoryTable
from strataspark.schema import EDGES, MEMORIES
from strataspark.sources import readers
from tests.test_store import T, memory


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["the parser in src/parse.py splits lines", "src/store.py keeps rows", "unrelated talk of bridges", "parse.py was slow", "rules for parse.py"]
    made = [memory(f"m{i}", layer, content=t, attrs={"tags": "x", "source_file": "f"} if i == 0 else {}) for i, (t, layer) in enumerate(zip(texts, (3, 4, 5, 5, 2), strict=True))]
    return spark.createDataFrame(made, MEMORIES).persist()


def test_file_context(spark, rows):
    paths = spark.createDataFrame([("/repo/src/parse.py",), ("nothing.txt",)], "path string")
    got = {(x.query_id, x.id) for x in search.file_context(rows, paths, "2024-01-02").collect()}
    assert {i for p, i in got if p == "/repo/src/parse.py"} >= {"m0"} and not {i for _, i in got} & {"m4"}


def test_rag_context(spark, rows):
    questions = spark.createDataFrame([(1, 7, "parse.py lines"), (2, 8, "nowhere")], "query_id int, conv_id long, query string")
    turns = spark.createDataFrame([(7, i, "user", f"turn {i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    got = {x.query_id: x.context for x in search.rag_context(rows, questions, turns, "2024-01-02").collect()}
    assert "- the parser in src/parse.py splits lines [tags: x] [file: f]" in got[1] and got[1].endswith("Question: parse.py lines")
    assert "user: turn 3" in got[1] and "turn 2" not in got[1] and got[2] == "Question: nowhere"


def test_rebuild_layer(spark):
    rows = spark.createDataFrame([memory("p", 2), memory("k", 3, access_count=12, importance=8.0), memory("w", 4)], MEMORIES)
    edges = spark.createDataFrame([("p", "k", "derived_from", 1.0, T(2024, 1, 1)), ("k", "w", "supports", 1.0, T(2024, 1, 1))], EDGES)
    after, linked, report = compact.rebuild_layer(rows, edges, const_completer('{"rule":"again","tags":"t","domain":"d"}'), "2024-02-01")
    got = {x.id: x for x in after.collect()}
    assert got["p"].compacted_at is not None and got["k"].compacted_at is None
    made = [x for x in got.values() if x.id not in ("p", "k", "w")]
    assert [(x.layer, x.content) for x in made] == [(2, "again")] and {(x.from_id, x.to_id) for x in linked.collect()} == {("k", "w"), (made[0].id, "k")}
    assert report.first().made == 1


def test_verbs_of_the_store(spark, tmp_path):
    t = MemoryTable(spark, path=str(tmp_path / "m"), embedder=hash_embedder(4), fold_every=3)
    t.store(spark.createDataFrame([("a", 5, "red apple", {}), ("b", 3, "green pear", {})], "id string, layer int, content string, attrs map<string,string>"), "2024-01-01")
    found = t.search(spark.createDataFrame([(1, "apple")], "query_id int, query string"), "2024-01-01 01:00:00")
    assert [x.id for x in found.collect()] == ["a"]
    t.accessed(found.select("id"), "2024-01-02")
    t._append(state.ops_of(spark.createDataFrame([("b", [1.0, 0.0])], "id string, v array<double>"), "embed", id="id", at=F.lit("2024-01-03").cast("timestamp"), vector="v", value=F.lit("m1")))
    t.soft_delete(spark.createDataFrame([("a",)], "id string"), "2024-01-04")
    got = {x.id: x for x in t.snapshot().collect()}
    assert got["a"].access_count == 1 and got["a"].stability == 1 and got["a"].compacted_at == T(2024, 1, 4) and got["b"].embedding == [1.0, 0.0] and got["b"].embedding_model == "m1"
    assert [x.id for x in t.list().collect()] == ["b"] and t.stats().first().live == 1
    assert [x.id for x in state.usable_vectors(t.snapshot(), "m1", 2).collect()] == ["b"] and state.usable_vectors(t.snapshot(), "m2", 2).count() == 0


def test_read_memories(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    assert {x.id for x in readers.read_memories(spark, str(tmp_path / "rows")).collect()} == {x.id for x in rows.collect()}
