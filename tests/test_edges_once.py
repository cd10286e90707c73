"""What is made from all line items is made once."""

from strataspark import more_queries, queries
from strataspark.operators import graph
from tests.test_queries import save


def test_edges_are_written_once(spark, tmp_path):
    items = [(i % 7, i % 3, "ARN"[i % 3], i % 5 + 1) for i in range(60)]
    sf = save(spark, tmp_path, lineitem=(items, "l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int"))
    out = more_queries.edge_insert_ignore(spark, sf)
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    edges = {(r.from_id, r.to_id, r.edge_type): r.weight for r in queries.edge_table(spark, sf).collect()}
    want = {k: w for k, w in edges.items() if w < 0.45}
    new = {k: w for k, w in edges.items() if w >= 0.25}
    for a, b, t in edges:
        if t == "relates_to":
            new[b, a, "supports"] = max(new.get((b, a, "supports"), 0), 0.125)
    ids = {x for k in edges for x in k[:2]} - {"p1"}
    want |= {k: w for k, w in new.items() if k not in want and set(k[:2]) <= ids}
    assert {(r.from_id, r.to_id, r.edge_type): r.weight for r in out.collect()} == want


def test_pushes_from_hubs_in_pieces(spark):
    edges = [("h", f"n{i}", 1.0 + i % 3) for i in range(40)] + [(f"n{i}", f"n{i * 7 % 40}", 1.0) for i in range(0, 40, 2)] + [("n1", "h", 2.0)]
    edges = spark.createDataFrame(edges, "from_id string, to_id string, weight double")
    seeds = spark.createDataFrame([("a", "h"), ("b", "n1"), ("b", "n2")], "query_id string, id string")
    got = {(r.query_id, r.id): r.rank for r in graph.pagerank_of_queries(edges, seeds, iterations=4, piece_links=8)[0].collect()}
    assert graph.dealt_links(edges, 8)[1].where("from_id = 'h'").first().pieces == 5
    for q in "ab":
        want = {r.id: r.rank for r in graph.personalized_pagerank(edges, seeds.where(f"query_id = '{q}'"), iterations=4).collect()}
        assert {i: round(x, 9) for (p, i), x in got.items() if p == q} == {i: round(x, 9) for i, x in want.items() if x > 0}
