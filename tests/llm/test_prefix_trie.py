import hashlib
import random

import pytest

from strataspark.llm import prefix_trie as trie


def brute(made):
    """made: conversation -> list of (role, text)."""
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    prefixes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            prefixes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in prefixes}
    leaves, saved = dict(kids), dict(kids)
    for p in prefixes:
        if p:
            kids[p[:-1]] += 1
    for p, members in prefixes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(prefixes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(c for c in m if len(made[c]) == len(p)))
        for p, m in prefixes.items()
    )


def rows_of(df):
    return sorted((x.conv_id, x.depth, -1 if x.parent_conv_id is None else x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in df.collect())


def some_conversations(r, n, kinds):
    made = {}
    for c in range(n):
        k = r.random()
        if k < 0.25 and made:
            made[c] = list(r.choice(list(made.values())))
        elif k < 0.5 and made:
            other = r.choice(list(made.values()))
            made[c] = other[: r.randint(0, len(other))] + [(r.choice(["user", ""]), r.choice(["x", "é", "", f"own {c}"]))] * r.randint(0, 3)
        else:
            made[c] = [(r.choice(["user", "assistant"]), r.choice("abc"[:kinds])) for _ in range(r.randint(0, 6))]
    return {c * 3 - 20: v for c, v in made.items()}


@pytest.mark.parametrize("seed, n, kinds, partitions", [(1, 60, 1, 1), (2, 150, 2, 9)])
def test_trie_equals_brute_force(spark, seed, n, kinds, partitions):
    made = some_conversations(random.Random(seed), n, kinds)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        turns = spark.createDataFrame([(c, i, *t, "other") for c, v in made.items() for i, t in enumerate(v)], "conv_id long, turn int, role string, text string, digest string")
        got = rows_of(trie.prefix_trie(trie.number_turns(turns), spark.createDataFrame([(c,) for c in made], "conv_id long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(made)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, "first"), (1, 2, "user", None), (1, 2, "user", None), (None, 1, "user", "lost"), (2, 5, "", "first"), (2, 9, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = {1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", "")], 7: []}
    members = spark.createDataFrame([(c,) for c in made], "conv_id long")
    assert rows_of(trie.prefix_trie(trie.number_turns(turns), members)) == brute(made)
    assert rows_of(trie.prefix_trie(trie.number_turns(turns.limit(0)), members)) == brute({c: [] for c in made})
    assert rows_of(trie.prefix_trie(trie.number_turns(turns.limit(0)), members.limit(0))) == []


def test_only_shared_turns_are_sorted(spark):
    long = [("user", f"turn {i}") for i in range(3000)]
    made = {5: long, 6: long[:3] + [("user", "another")], 8: long[:2]}
    turns = spark.createDataFrame([(c, i, *t) for c, v in made.items() for i, t in enumerate(v)], "conv_id long, turn int, role string, text string")
    assert rows_of(trie.prefix_trie(trie.number_turns(turns), spark.createDataFrame([(c,) for c in made], "conv_id long"))) == brute(made)
