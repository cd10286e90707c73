import pytest
from pyspark.sql import functions as F

from strataspark.functions import models, replies, scores, text, vectors


def values(spark, rows, schema, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.withColumn("x", make).orderBy("i").collect()]


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.6, 0.8], [0.6, 0.8]), ([], []), (None, [1.0])]
    got = values(spark, rows, "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b")))
    assert got == pytest.approx([1, 0, 0, -1, 0.7071, 0, 1, 0, 0], abs=1e-4)


def test_parse_tags(spark):
    rows = ['["Go", " rust "]', '```json\n["a"]\n```', '```\n["A"]\n```', '["x", "", " "]', '["1","2","3","4","5","6"]', "[]", "not json", "", None]
    assert values(spark, [(r,) for r in rows], "r string", replies.parse_tags(F.col("r"))) == ["go,rust", "a", "a", "x", "1,2,3,4,5", "", "", "", ""]


def test_parse_numbers(spark):
    rows = ["0.8", "-0.5", "1.0", "-1.0", "0.0", "1.5", "-2", " 0.25\n", "I rate it **0.7**, because", "abc", ""]
    assert values(spark, [(r,) for r in rows], "r string", replies.parse_valence(F.col("r"))) == [0.8, -0.5, 1.0, -1.0, 0.0, 1.0, -1.0, 0.25, 0.7, None, None]
    rows = ["7", " 12 ", "0", "about 6/10", "none", ""]
    assert values(spark, [(r,) for r in rows], "r string", replies.parse_importance(F.col("r"))) == [7, 10, 1, 6, None, None]


def test_parse_objects(spark):
    good = '```json\n{"rules":["r1"],"skills":[{"content":"c","tags":"t"}]}\n```'
    got = values(spark, [(good,), ('{"rules":["a"]}',), ("{bad",), ("",)], "r string", replies.parse_rules_skills(F.col("r")))
    assert got[0].rules == ["r1"] and got[0].skills[0].content == "c" and got[1].rules == ["a"] and got[2] is None and got[3] is None
    got = values(spark, [('{"rule":" do it ","tags":"a","domain":"go"}',), ('{"rule":""}',), ("x",)], "r string", replies.parse_wisdom(F.col("r")))
    assert (got[0].content, got[0].attrs) == ("do it", {"tags": "a", "domain": "go", "classified": "1"}) and got[1:] == [None, None]
    replies_ = [('"Go"',), ('```json\n"go"\n```',), ("'go'",), ('""',), ('"a\\"b"',)]
    assert values(spark, replies_, "r string", replies.parse_classification(F.col("r"), "domain", ["go", "Rust"])) == [{"domain": "go"}] * 3 + [None, None]
    got = values(spark, [("GO",), ('{"domain":"Rust","tags":["A","b","c","d"]}',), ("java",)], "r string", replies.parse_classification(F.col("r"), "domain", ["go", "Rust"], True))
    assert got == [{"domain": "go"}, {"domain": "rust", "tags": "a,b,c"}, None]


def test_truncate_utf8(spark):
    for size, rows in ((3, [("ab中cd", "ab"), ("abc", "abc")]), (5, [("ab中cd", "ab中")]), (2, [("aéb", "a"), ("", "")])):
        assert values(spark, [(a,) for a, _ in rows], "r string", text.truncate_utf8(F.col("r"), size)) == [b for _, b in rows]
    whole = "a中é😀zß漢"
    for size in range(len(whole.encode()) + 1):
        want = whole.encode()[:size].decode("utf-8", "ignore")
        assert values(spark, [(whole,)], "r string", text.truncate_utf8(F.col("r"), size)) == [want]


@pytest.mark.parametrize(
    "glob, path, ok",
    [
        ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("docs/**", "docs/a/b", True), ("docs/**", "docs", True), ("docs/**", "doc", False), ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/xb", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("**", "x/y", True), ("a.b", "axb", False), ("**/**/c", "x/c", True), ("*/c", "x/c", True), ("*/c", "c", False),
    ],
)
def test_glob(glob, path, ok):
    import re

    assert bool(re.match(text.glob_regex(glob), path)) == ok


def test_split_chunks(spark):
    rows = [("a.md", "intro paragraph\n\n# First\nbody\n# Second\nmore\n"), ("a.yaml", "a: 1\n---\nb: 2\n---\nc: 3\n"), ("a.yml", "a: 1\n"), ("a.txt", "# x\n# y"), ("a.txt", "0123456789\n" * 9), ("b.txt", "x" * 80)]
    got = values(spark, rows, "p string, c string", text.split_chunks(F.col("p"), F.col("c"), 50))
    assert got[0] == ["intro paragraph\n\n", "# First\nbody\n", "# Second\nmore\n"] and got[1] == ["a: 1\n", "b: 2\n", "c: 3\n"] and got[2] == ["a: 1\n"] and got[3] == ["# x\n# y"]
    assert "".join(got[4]) == rows[4][1] and all(len(x) <= 50 for x in got[4]) and len(got[4]) == 3 and got[5] == ["x" * 80 + "\n"]


def test_small_text_functions(spark):
    rows = [("https://github.com/o/r.git",), ("https://github.com/o/r",), ("git@github.com:o/r.git",), ("https://github.com/o",), ("git@h:a/b/c",)]
    assert values(spark, rows, "u string", text.parse_remote(F.col("u"))) == ["o/r", "o/r", "o/r", "", ""]
    assert values(spark, [("AQID",), ("!!",), ("",)], "u string", text.base64_to_hex(F.col("u"))) == ["010203", "!!", ""]
    assert values(spark, [("How does it work? fix it",), ("hello",), ("please review",)], "u string", text.detect_intents(F.col("u"))) == [["research", "build"], ["build"], ["review"]]
    assert values(spark, [("x <patch>\n a\nb </patch> <patch>c</patch>",), ("none",)], "u string", text.extract_patch(F.col("u"))) == ["a\nb", ""]
    long = "word " * 100
    got = values(spark, [("# T\n\n## U\nfirst  line\nsecond\n\nthird",), ("# only\n# heads",), (long,), ("",)], "u string", text.condense(F.col("u")))
    assert got[0] == "first line second" and got[1] == "# only\n# heads" and got[2] == ("word " * 56).rstrip() + "…" and got[3] == ""
    assert values(spark, [("svc", "op", 0, 2_999_999, 2)], "s string, n string, a long, b long, c int", text.span_text(*(F.col(c) for c in "snabc"))) == ["[svc] span: op duration=2ms status=ERROR"]


def test_scores_and_dates(spark):
    at = F.lit("2024-01-01 01:00:00").cast("timestamp")
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    row = spark.range(1).select(scores.time_score(at, now, 1.0).alias("a"), scores.time_score(at, now, 1.0, "power").alias("b"), scores.valence_score(F.lit(-0.5)).alias("c")).first()
    assert row.a == pytest.approx(0.368063, abs=1e-5) and row.b == pytest.approx(0.9995) and row.c == pytest.approx(-0.0375)
    got = values(spark, [({"created_at": "2024-01-15T12:00:00Z", "source": "x"},), ({"created_at": "not-a-date"},), ({"a": "b"},)], "m map<string,string>", replies.backdate(F.col("m")))
    assert str(got[0].created_at) == "2024-01-15 12:00:00" and got[0].attrs == {"source": "x"} and got[1].bad and not got[2].bad and not got[0].bad


def test_hash_embedder_starts_from_fnv_1():
    # FNV-1 (32 bits) of "" and "a" are the fixed values 0x811c9dc5 and 0x050c5d7e
    for t, h in (("", 0x811C9DC5), ("a", 0x050C5D7E)):
        first = (h * 1664525 + 1013904223) & 0x7FFFFFFF
        v = models.hash_embedder(2)([t])[0]
        second = (first * 1664525 + 1013904223) & 0x7FFFFFFF
        a, b = first % 1000 / 500 - 1, second % 1000 / 500 - 1
        assert v == pytest.approx([a / (a * a + b * b) ** 0.5, b / (a * a + b * b) ** 0.5])


def test_models(spark):
    def broken(texts):
        raise RuntimeError("too large")

    df = spark.createDataFrame([("a",), (None,)], "t string")
    out = df.select(models.embed(F.col("t"), models.hash_embedder(8)).alias("e"), models.complete(F.col("t"), models.const_completer("ok")).alias("c"), models.complete(F.col("t"), broken).alias("b")).collect()
    assert sum(x * x for x in out[0].e.v) == pytest.approx(1, abs=1e-5) and out[0].c.text == "ok" and "too large" in out[1].b.error and out[1].b.text is None
