import random
import re

import pytest

from strataspark.llm import near_dedup
from strataspark.llm.components import connected_components
from strataspark.llm.near_dedup import keep_one_of_each, near_duplicates


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, threshold):
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows, base = [], [" ".join(r.choices(vocab, k=r.randint(5, 120))) for _ in range(25)]
    for i in range(260):
        w = r.choice(base[:4] if i % 2 else base).split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 3, " ".join(w)))
    return rows + [(1, None), (2, ""), (4, " \n\t"), (5, "One"), (7, "one"), (8, "two words"), (10, "TWO  words"), (11, "Éa b"), (13, "éa b")]


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, id string, n double").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=words).collect()}
    assert got == brute(rows, words, 0.8)
    kept = {r.doc_id for r in keep_one_of_each(df, words=words).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_long_text_repeated_rows_and_empty_table(spark):
    long = " ".join(f"word{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, long + " end"), (None, "x y"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(df, words=2).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 7)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 0}


def test_members_of_one_group_meet_one_pivot_first(spark, monkeypatch):
    r = random.Random(7)
    base, vocab = [f"w{i}" for i in range(150)], [f"v{i}" for i in range(400)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    compared, call = [], near_dedup._Confirm.__call__

    def counted(self, pairs):
        pairs = pairs.select("id", "other").distinct()
        compared.append(pairs.count())
        return call(self, pairs)

    monkeypatch.setattr(near_dedup._Confirm, "__call__", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == brute(rows, 2, 0.8)
    assert compared[0] < len(rows) and sum(compared) < 2 * len(rows)
