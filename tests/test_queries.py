"""Registered queries against brute force over small tables."""

import random
import re

from strataspark import queries


def save(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_same_trace_edges(spark, tmp_path):
    r = random.Random(1)
    events = [(i, r.choice((1, 1, 1, 2))) for i in range(120)]
    sf = save(spark, tmp_path, events=(events, "event_id long, user_id long"))
    want, traces = set(), {}
    for i, user in events:
        want |= {(f"s{i}", f"s{j}") for j in traces.get(user, [])[:50]}
        traces.setdefault(user, []).append(i)
    got = [(x.from_id, x.to_id) for x in queries.same_trace_edges(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_slugs_and_hex_of_whole_texts(spark, tmp_path):
    texts = ["--- " * 50 + "Long title, é and more " * 9, "two\nlines " * 40, "short", "x" * 61, "", "ü" * 100]
    sf = save(spark, tmp_path, documents=(list(enumerate(texts + texts[::-1] + ["odd"] + texts)), "doc_id long, text string"))
    docs = dict(enumerate(texts + texts[::-1] + ["odd"] + texts))
    assert {x.doc_id: x.slug for x in queries.slugs(spark, sf).collect()} == {i: re.sub("[^a-z0-9]+", "-", t.lower()).strip("-")[:80] for i, t in docs.items()}
    assert {x.doc_id: x.decoded for x in queries.base64_hex(spark, sf).collect()} == {i: "!" + t if i % 2 else t.encode().hex() for i, t in docs.items()}


def test_searches_take_whole_texts_and_all_rows(spark, tmp_path):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3)]
    sf = save(spark, tmp_path, embeddings=(vectors, "vec_id long, embedding array<float>"), benchmark=(items, "item_id long, text string"))
    assert {x.query_id: x.query for x in queries.query_table(spark, sf).collect()} == dict(items)
    v = {str(x.vec_id): x.embedding for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    far = lambda q, n: sorted(v, key=lambda i: (sum((x - y) ** 2 for x, y in zip(v[q], v[i], strict=True)), i))[:n]
    links = {(q, i) for q in v for i in far(q, 6) if i != q and dot(v[q], v[i]) >= 0.3 * (dot(v[q], v[q]) * dot(v[i], v[i])) ** 0.5}
    assert {(x.from_id, x.to_id) for x in queries.auto_link(spark, sf).collect()} == links
    assert {(x.query_id, x.id) for x in queries.knn_l2(spark, sf).collect()} == {(q, i) for q in ("0", "50", "100") for i in far(q, 10)}
