import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataspark.operators import cluster, graph, joins, state
from strataspark.plans.store import MemoryTable
from strataspark.plans.sync import sync_pull, sync_push
from strataspark.schema import EDGES, MEMORIES
from strataspark.sources import readers, sinks

T = dt.datetime


def ops(spark, rows):
    names = [c.split()[0] for c in state.OPS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], state.OPS)


def store(i, at, content, layer=5, attrs=None):
    return {"id": i, "op": "store", "at": T(2024, 1, 1, at), "layer": layer, "content": content, "attrs": attrs or {}}


def test_fold(spark):
    at = lambda h: T(2024, 1, 2, h)
    log = [
        store("a", 1, "one", attrs={"created_at": "2023-05-01T00:00:00Z", "k": "v"}), store("b", 2, "one", attrs={"created_at": "2022-01-01T00:00:00Z", "source": "x"}), store("c", 3, "two", 1), store("bad", 4, "three", attrs={"created_at": "nope"}), store("no", 4, "", 5),
        store("nine", 4, "four", 9), {"id": "a", "op": "get", "at": at(1)}, {"id": "a", "op": "get", "at": at(2)}, {"id": "a", "op": "access", "at": at(3)}, {"id": "c", "op": "valence", "at": at(1)}, {"id": "c", "op": "valence", "at": at(2)}, {"id": "c", "op": "valence", "at": at(3)},
        {"id": "a", "op": "valence", "at": at(1), "number": 0.5}, {"id": "a", "op": "importance", "at": at(1), "number": 9.0}, {"id": "a", "op": "importance", "at": at(2), "number": 8.0}, {"id": "a", "op": "attr", "at": at(1), "key": "k", "value": "w"},
        {"id": "c", "op": "tombstone", "at": at(4)}, {"id": "a", "op": "embed", "at": at(1), "vector": [1.0, 0.0], "value": "m"},
    ]
    want = None
    for rows in (log, log[::-1]):
        got = {r.id: r for r in state.fold_ops(ops(spark, rows)).collect()}
        assert set(got) == {"a", "c"}
        a, c = got["a"], got["c"]
        assert a.created_at == T(2023, 5, 1) and a.attrs == {"k": "w", "source": "x"} and a.access_count == 3 and a.stability == 3 and a.importance == 8 and a.valence == 0.5 and a.valence_scored and a.embedding == [1.0, 0.0]
        assert a.decay_rate == pytest.approx(0.5 / 3) and c.decay_rate == 0 and c.valence_scored and c.valence == 0 and c.compacted_at == at(4)
        want = want or got
        assert got == want


def test_restoring_a_dead_text(spark):
    log = [store("a", 1, "one"), {"id": "a", "op": "tombstone", "at": T(2024, 1, 1, 2)}, store("b", 3, "one")]
    assert state.fold_ops(ops(spark, log)).first().compacted_at is not None
    assert state.fold_ops(ops(spark, log), revive=True).first().compacted_at is None


def some_log(r, n):
    ids, texts, rows = [f"i{k}" for k in range(12)], [f"text {k}" for k in range(7)], []
    for _ in range(n):
        row = {"id": r.choice(ids), "op": r.choice(["store", "store", "get", "access", "attr", "replace_attrs", "valence", "importance", "embed", "tombstone", "revive", "pushed", "touch"]), "at": T(2024, 1, 1, r.randrange(24), r.randrange(6))}
        if row["op"] == "store":
            row |= {"content": r.choice([*texts, "", None]), "layer": r.randint(0, 6), "attrs": r.choice([None, {}, {"k": "a"}, {"k": "b", "source": "s"}, {"created_at": "2023-05-01T00:00:00Z"}, {"created_at": "bad"}])}
        elif row["op"] in ("attr", "embed"):
            row |= {"key": r.choice("kl"), "value": r.choice(["x", "y", None]), "vector": [r.random()]}
        elif row["op"] == "replace_attrs":
            row |= {"attrs": {"k": r.choice("uv")}}
        elif row["op"] in ("valence", "importance"):
            row |= {"number": r.choice([None, 0.25, 3.0]) if row["op"] == "valence" else 4.0}
        rows.append(row)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_logs_cut_anywhere_give_the_same_rows(spark, seed):
    r = random.Random(seed)
    log = some_log(r, 160)
    for revive in (False, True):
        want = sorted(map(str, state.fold_ops(ops(spark, log), revive).collect()))
        shuffled = r.sample(log, len(log))
        cuts = sorted(r.sample(range(len(log)), 2))
        parts = [state.fold_state(ops(spark, part)) for part in (shuffled[: cuts[0]], shuffled[cuts[0] : cuts[1]], shuffled[cuts[1] :])]
        merged = state.merge_states(parts[2], state.merge_states(parts[0], parts[1]))
        assert sorted(map(str, state.state_rows(merged, revive).collect())) == want and len(want) > 2


def test_many_gets_keep_the_plan(spark, tmp_path):
    t = MemoryTable(spark, path=str(tmp_path / "m"), fold_every=4)
    t.store(spark.createDataFrame([("a1", 5, "red", {}), ("b2", 4, "green", {})], "id string, layer int, content string, attrs map<string,string>"), "2024-01-01")
    sizes = set()
    for k in range(9):
        assert t.get("a", f"2024-01-02 00:{k:02d}:00").first().access_count == k
        plan = t.snapshot()._jdf.queryExecution().optimizedPlan().toString()
        sizes.add((t.segments[-1] - t.folded > 0, len([x for x in plan.split("\n") if "Relation" in x])))
    assert len(sizes) <= 3 and max(n for _, n in sizes) <= 16
    again = MemoryTable(spark, path=str(tmp_path / "m"), fold_every=4)
    got = {x.id: x for x in again.snapshot().collect()}
    assert got["a1"].access_count == 9 and got["a1"].stability == 10 and got["b2"].access_count == 0
    again.tag(spark.createDataFrame([("b2",)], "id string"), {"k": "v"}, "2024-01-03")
    assert again.list(4).first().attrs == {"k": "v"} and again.list(5).first().id == "a1"
    assert again.folded == max(again._done("state", "pairs")) and len(again.segments) == 11
    # a state that a crash left without its last table doesn't count
    import shutil

    shutil.rmtree(tmp_path / f"m/state/{again.folded:012d}/pairs")
    crashed = MemoryTable(spark, path=str(tmp_path / "m"), fold_every=4)
    assert crashed.folded < again.folded and {x.id: x.access_count for x in crashed.snapshot().collect()} == {"a1": 9, "b2": 0}


def test_memory_table(spark):
    t = MemoryTable(spark)
    t.store(spark.createDataFrame([("a1", 5, "red apple pie", {"p": "x"}), ("a2", 4, "green pear", {}), ("a3", 5, "red apple pie", {})], "id string, layer int, content string, attrs map<string,string>"), "2024-01-01")
    assert t.stats().first().live == 2
    assert t.get("a2", "2024-01-02").first().content == "green pear"
    found = t.search(spark.createDataFrame([(1, "apple"), (2, "pear")], "query_id int, query string"), "2024-01-01 00:10:00")
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, "a1"), (2, "a2")]
    t.soft_delete(spark.createDataFrame([("a1",)], "id string"), "2024-01-03")
    t.tag(spark.createDataFrame([("a2",)], "id string"), {"k": "v"}, "2024-01-03")
    assert [(r.id, r.attrs, r.stability) for r in t.list().collect()] == [("a2", {"k": "v"}, 2.0)]
    with pytest.raises(LookupError):
        t.get("zz", "2024-01-04")


def memory(i, layer=5, source="me", hour=1, content=None, **more):
    names = [c.strip().split()[0] for c in MEMORIES.replace("map<string,string>", "map").split(",")]
    row = {"id": i, "layer": layer, "content": content or f"text {i}", "content_hash": f"h{content or i}", "importance": 5.0, "access_count": 0, "created_at": T(2024, 1, 1, hour), "updated_at": T(2024, 1, 1, hour), "source": source, "valence": 0.0, "attrs": {"n": i}} | more
    return tuple(row.get(n) for n in names)


def test_push_and_pull(spark, tmp_path):
    rows = spark.createDataFrame([memory("a", 3), memory("b", 4), memory("s", 5, source="server"), memory("d", 5, compacted_at=T(2024, 1, 2))], MEMORIES)
    counts, marked = sync_push(rows, str(tmp_path), "acc", "org", "me", "", "2024-02-01")
    assert counts.first().asDict() == {"accepted": 2, "skipped": 0}
    assert {r.id for r in marked.collect() if r.pushed_at} == {"a", "b"}
    assert sync_push(rows, str(tmp_path), "acc", "org", "me", "", "2024-02-02")[0].first().asDict() == {"accepted": 0, "skipped": 2}
    here = spark.createDataFrame([memory("a2", 3, content="a", hour=0, importance=2.0)], MEMORIES).withColumn("content_hash", F.lit("ha"))
    got = {r.content_hash: r for r in sync_pull(here, str(tmp_path), "acc", "org", at="2000-01-01").collect()}
    assert got["ha"].action == "updated" and got["ha"].importance == 5 and got["ha"].id == "a2" and got["hb"].action == "inserted" and got["hb"].source == "server" and got["hb"].attrs == {"n": "b"}
    assert sync_pull(here, str(tmp_path), "acc", "org", scopes=["teams/x"]).count() == 1


def test_export_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([memory(f"m{i}", i % 5 + 1, embedding=[0.5, 1.0]) for i in range(12)] + [memory("dead", compacted_at=T(2024, 1, 3))], MEMORIES)
    edges = spark.createDataFrame([("m1", "m2", "supports", 0.5, T(2024, 1, 1)), ("m1", "", "supports", 0.5, T(2024, 1, 1))], EDGES)
    sinks.write_export(rows, edges, str(tmp_path / "x"), "2024-02-01", lines=2)
    m, e = readers.read_export(spark, str(tmp_path / "x"))
    assert m.count() == 12 and {r.id: r.attrs for r in m.collect()}["m3"] == {"n": "m3"} and readers.invalid_export(m, e).first().asDict() == {"bad_memories": 0, "bad_edges": 1}
    assert spark.read.json(str(tmp_path / "x" / "manifest")).first().memory_count == 12
    for ts in ("20240101-000000", "20240102-000000", "20240103-000000"):
        sinks.write_snapshot(rows, str(tmp_path / "s"), ts)
    assert sinks.prune_snapshots(spark, str(tmp_path / "s"), 2) == [f"{tmp_path}/s/ts=20240101-000000"]
    assert sinks.restore_snapshot(spark, str(tmp_path / "s"), "20240102-000000", rows.limit(1), "20240104-000000").count() == 13
    assert [r.ts for r in sinks.list_snapshots(spark, str(tmp_path / "s")).collect()] == ["20240102-000000", "20240103-000000", "20240104-000000"]


def test_graph_cases(spark):
    edges = spark.createDataFrame([("a", "b", "relates_to", 0.9, None), ("b", "c", "supports", 0.5, None), ("c", "d", "supports", 0.5, None), ("a", "a", "supports", 0.1, None)], EDGES)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.other for r in graph.neighbors(edges, ids("b")).collect()} == {"a", "c"} and graph.neighbors(edges, ids("a"), ["relates_to"]).count() == 1
    assert [(r.to_id, r.level) for r in graph.bfs(edges, "a", 2).orderBy("level").collect()] == [("b", 1), ("c", 2)] and graph.bfs(edges, "a", 0).count() == 0
    ranks = {r.id: r.rank for r in graph.personalized_pagerank(edges, ids("a")).collect()}
    assert ranks["a"] >= ranks["b"] >= ranks["c"] > 0 and sum(ranks.values()) == pytest.approx(1)
    alone = {r.id: r.rank for r in graph.personalized_pagerank(edges, ids("z")).collect()}
    assert [k for k, v in alone.items() if v > 0] == ["z"]
    new = spark.createDataFrame([("a", "b", "relates_to", 0.1, None), ("a", "c", "supports", 0.3, None), ("a", "gone", "supports", 0.3, None)], EDGES)
    assert joins.edge_insert_ignore(edges, new, ids("a", "b", "c", "d")).count() == 5


def test_greedy_clusters(spark):
    import random

    import numpy as np

    r = random.Random(3)
    rows = []
    for i in range(150):
        base = np.eye(6)[r.randrange(4)]
        v = base + 0.45 * np.array([r.gauss(0, 1) for _ in range(6)])
        rows.append((i, T(2024, 1, 1, i % 3), [float(x) for x in v]))
    rows += [(900, T(2024, 1, 1), None), (901, T(2024, 1, 1), [0.0] * 6)]
    got = {(x.id, x.cluster, x.pos) for x in cluster.greedy_clusters(spark.createDataFrame(rows, "id long, created_at timestamp, embedding array<float>"), 0.75, 2).collect()}
    order = sorted((x for x in rows if x[2] and any(x[2])), key=lambda x: (x[1], x[0]))
    unit = [np.array(x[2], np.float32).astype(float) / np.linalg.norm(np.array(x[2], np.float32).astype(float)) for x in order]
    free, want = [True] * len(order), set()
    for s in range(len(order)):
        if not free[s]:
            continue
        members = [s]
        for j in range(s + 1, len(order)):
            if free[j] and all(np.float32(unit[j] @ unit[m]) >= np.float32(0.75) for m in members):
                members.append(j)
        if len(members) >= 2:
            for pos, m in enumerate(members):
                free[m] = False
                want.add((order[m][0], order[s][0], pos))
    assert got == want and len(want) > 60


def greedy_by_hand(rows, threshold, min_size):
    import numpy as np

    order = sorted((x for x in rows if x[2] and any(x[2])), key=lambda x: (x[1], x[0]))
    unit = [np.array(x[2], np.float32).astype(float) / np.linalg.norm(np.array(x[2], np.float32).astype(float)) for x in order]
    free, want = [True] * len(order), set()
    for s in range(len(order)):
        members = [s] if free[s] else []
        for j in range(s + 1, len(order) if members else 0):
            if free[j] and all(np.float32(unit[j] @ unit[m]) >= np.float32(threshold) for m in members):
                members.append(j)
        if len(members) >= min_size:
            for pos, m in enumerate(members):
                free[m] = False
                want.add((order[m][0], order[s][0], pos))
    return want


@pytest.mark.parametrize(("min_size", "group_nodes"), [(2, 20), (5, 20), (5, 4096)])
def test_greedy_clusters_of_copies(spark, monkeypatch, min_size, group_nodes):
    import random

    import numpy as np

    r = random.Random(min_size)
    base = [[float(x) for x in np.eye(5)[r.randrange(3)] + 0.5 * np.array([r.gauss(0, 1) for _ in range(5)])] for _ in range(60)]
    rows = [(i, T(2024, 1, 1, r.randrange(20)), base[0] if i % 3 == 0 else r.choice(base)) for i in range(240)]
    paired, plain = [], cluster.cosine_links
    monkeypatch.setattr(cluster, "cosine_links", lambda v, *more: (paired.append(v.count()), plain(v, *more))[1])
    df = spark.createDataFrame(rows, "id long, created_at timestamp, embedding array<float>")
    got = {(x.id, x.cluster, x.pos) for x in cluster.greedy_clusters(df, 0.75, min_size, group_nodes=group_nodes).collect()}
    assert got == greedy_by_hand(rows, 0.75, min_size) and len({x[1] for x in got}) > 3
    assert max(paired) <= 60  # copies have no pairs


@pytest.mark.parametrize(("min_size", "links", "nodes"), [(2, 1 << 19, 40), (4, 1500, 16384)])
def test_greedy_clusters_of_one_loose_component(spark, monkeypatch, min_size, links, nodes):
    import random

    r = random.Random(8)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(260)]
    rows = [(i, T(2024, 1, 1, r.randrange(20)), base[i] if i < 260 else r.choice(base)) for i in range(320)]
    rounds, plain = [], cluster._round
    monkeypatch.setattr(cluster, "_round", lambda *a: (rounds.append(1), plain(*a))[1])
    monkeypatch.setattr(cluster, "AHEAD_LINKS", links)
    monkeypatch.setattr(cluster, "AHEAD_NODES", nodes)
    monkeypatch.setattr(cluster, "AHEAD_LEAST", 8)
    df = spark.createDataFrame(rows, "id long, created_at timestamp, embedding array<float>")
    got = {(x.id, x.cluster, x.pos) for x in cluster.greedy_clusters(df, 0.4, min_size, group_nodes=30).collect()}
    assert got == greedy_by_hand(rows, 0.4, min_size) and len({x[1] for x in got}) > 20
    assert not rounds  # of two links each seed reaches nearly all, so they would decide one by one
