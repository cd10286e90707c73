import gzip
import random

import numpy as np
import pytest

from strataspark.llm import ann, chat, queries, warc
from strataspark.llm import sentencepiece_viterbi as sv
from strataspark.scratch import materialise, new_path


def test_sentencepiece_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    r = random.Random(2)
    some = "ab cé ß漢\n\t0019..--==aaa  the ingтер\x00"
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["", " ", "  a  ", "a" * 5000, "ab" * 3000, " " * 1000, "=-" * 4000, "x" * 70 + " y", "\n\n a", "▁a b", "Hello, world! " * 500]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    out = {x.doc_id: x for x in sv.with_tokens(df, queries.VOCABULARY).collect()}
    for i, t in enumerate(texts):
        assert out[i].token_ids == library.encode(t), repr(t)
        assert out[i].round_trip == ("▁" not in t) and out[i].n_tokens == len(out[i].token_ids)
    assert out[len(texts)].token_ids is None and out[len(texts)].round_trip is None
    one = sv.decode(sv.encode(df.select("doc_id", "text"), queries.VOCABULARY), queries.VOCABULARY)
    assert all(x.decoded == (x.text if x.text is None else x.text.replace("▁", " ")) for x in one.collect())
    assert sv.with_tokens(df.limit(0), queries.VOCABULARY).count() == 0


def test_ids_do_not_hang_on_the_length_of_stretches(monkeypatch):
    v = sv.Vocabulary(queries.VOCABULARY)
    r = random.Random(5)
    texts = ["".join(r.choice("ab cé ß漢\n\t019.-=  thingов") for _ in range(r.randint(0, 300))) for _ in range(60)] + ["ab" * 200, "the " * 90]
    data = "".join(texts).encode()
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    want = None
    for short in (1, 7, 20, 64):
        monkeypatch.setattr(sv, "SHORT", short)
        ids, ends = sv.BatchEncoder(v).encode(np.frombuffer(data, np.uint8), at)
        got = (ids.tolist(), np.asarray(ends).tolist())
        want = want or got
        assert got == want, short


def test_a_long_text_keeps_a_short_window():
    v = sv.Vocabulary(queries.VOCABULARY)
    r = random.Random(6)
    text = sv.MARK + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    total, longest, parts = 0, 0, 0
    for part in sv.Encoder(v).stream(text):
        parts += 1
        longest = max(longest, len(part))
        total += len(part)
    assert parts > 1000 and longest < 5000 and total > 100_000


def unigram(pieces):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    out = field(1, field(1, b"<unk>") + bytes([0x18, 2]))
    for p, s in pieces.items():
        out += field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes())
    return sv.Vocabulary(data=out + field(2, bytes([0x18, 1])) + field(3, bytes([0x20, 0])))


def test_unigram_viterbi_finds_the_best_and_keeps_a_short_window():
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.2, "ba": -4.1, "aba": -6.0, "▁ab": -5.5}
    v = unigram(pieces)

    def best(text):
        table = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = [(table[end - n][0] + pieces.get(text[end - n : end], v.worst), [*table[end - n][1], v.ids.get(text[end - n : end], v.unknown)]) for n in range(1, min(4, end) + 1) if text[end - n : end] in pieces or n == 1]
            table.append(max(options, key=lambda x: x[0]))
        return table[-1]

    r = random.Random(1)
    score = lambda ids: sum(v.scores[i] if i else v.worst for i in ids)
    for _ in range(200):
        text = sv.MARK + "".join(r.choice("aab?") for _ in range(r.randint(0, 60)))
        ids = [i for part in sv.Encoder(v).stream(text) for i in part]
        assert abs(score(ids) - best(text)[0]) < 1e-6
        data = np.frombuffer(text.replace(sv.MARK, " ").encode(), np.uint8)
        many, _ = sv.BatchEncoder(v).encode(data[1:], np.array([0, len(data) - 1]))
        if len(data) > 1:
            assert abs(score(many.tolist()) - best(text)[0]) < 1e-6
    assert len(list(sv.Encoder(v).stream("ab" * 500))) > 10


def test_ann_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[100:600] = x[100]
    rows = [(i, [float(a) for a in v], i) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] * 16, 1), (5080, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = ann.search(ann.build_index(df, shard_nodes=300), df.where("vec_id % 20 = 0")).toPandas()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = total = 0
    for q in range(0, 1500, 20):
        mine = got[got.query_id == q].sort_values("rank")
        s = exact[q].copy()
        s[q] = -np.inf
        top = np.lexsort((np.arange(1500), -s))[:20]
        hits, total = hits + len(set(top) & set(mine.vec_id)), total + 20
        assert mine["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(mine.score, s[mine.vec_id], atol=1e-9)
    assert hits / total >= 0.95
    assert got[got.query_id == 100].vec_id.tolist() == list(np.lexsort((np.arange(1500), -np.where(np.arange(1500) == 100, -np.inf, exact[100])))[:20])
    assert not set(got.query_id) & {5000, 5020, 5040, 5060, 5080}
    few = df.where("vec_id < 3")
    assert ann.search(ann.build_index(few), few).count() == 6 and ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_ann_recall_in_several_shards(spark):
    r = np.random.default_rng(12)
    centres = r.normal(size=(60, 24))
    x = (centres[r.integers(0, 60, 20_000)] + 0.6 * r.normal(size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index = ann.build_index(df)
    assert index.count() >= 4
    q = np.arange(0, 20_000, 50)
    score = x[q].astype(np.float64) @ x.T.astype(np.float64)
    score[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :20]
    got = {}
    for row in ann.search(index, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    assert np.mean([len(got[i] & set(b.tolist())) / 20 for i, b in zip(q.tolist(), best, strict=True)]) >= 0.95


def test_ann_double_precision_and_repeated_ids(spark):
    rows = [(1, [0.1, 0.2, 1.0]), (2, [1 / 3, 1e300, 0.0]), (3, [1e-300, 0.5, 2.0]), (4, [0.3, -0.1, 0.2]), (4, [0.3, -0.1, 0.2]), (5, [9.0, 9.0, 9.0]), (5, [0.1, 0.1, 0.1]), *[(6, [0.2, 0.2, 0.2])] * 40, (7, [0.2, 0.2, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(ann.build_index(df), df).collect()
    best = {}
    for a, v in rows:
        for b, w in rows:
            if a != b:
                best[a, b] = max(best.get((a, b), -np.inf), float(np.dot(v, w)))
    for q in range(1, 8):
        want = sorted(((-s, b) for (a, b), s in best.items() if a == q))
        assert [(x.vec_id, x.rank) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == [(b, r + 1) for r, (_, b) in enumerate(want)]
    for x in got:
        assert x.score == pytest.approx(best[x.query_id, x.vec_id], rel=1e-15)


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2\n", big), (7, None, big), (3, "u", "small"), (4, "v", "small"), (5, "w", None), (6, "x", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 2_000_000), (None, "n", "z")]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, payload string").repartition(2)
    folder = new_path(spark, "t")
    files = materialise(warc.write_monolithic(warc.plan_records(df), f"{folder}/crawl"), "f")
    index = materialise(warc.normalise(files, f"{folder}/records"), "i")
    out = {x.record_id: x for x in warc.read_records(index).collect()}
    assert len(out) == 7
    for i, _, html in pages[:7]:
        x = out[f"<urn:page:{i}>"]
        revisit = i in (1, 2)
        assert x.warc_type == ("revisit" if revisit else "response") and x.refers_to == ("<urn:page:7>" if revisit else None)
        assert bytes(x.payload) == (b"" if revisit else (html or "").encode()) and x.stated_bytes == len((html or "").encode())
    for r in files.collect():
        gzip.decompress(open(r.uri.removeprefix("file://"), "rb").read())
    for uri in {r.uri for r in index.collect()}:
        lines = open(uri.removeprefix("file://") + ".idx").read().splitlines()
        assert [tuple(map(int, s.split("\t")[:2])) for s in lines] == sorted((r.offset, r.length) for r in index.where(index.uri == uri).collect())
    few = spark.createDataFrame([(9, "u", "r" * 1500)] * 3 + [(8, "u", "r" * 1500)], "page_id long, url string, html string")
    twice = materialise(warc.normalise(materialise(warc.write_monolithic(warc.plan_records(few), f"{folder}/few"), "f"), f"{folder}/few2"), "i")
    assert sorted((x.record_id, x.warc_type) for x in warc.read_records(twice).collect()) == [("<urn:page:8>", "revisit")] + [("<urn:page:9>", "response")] * 3
    held, warc.BATCH_BYTES = warc.BATCH_BYTES, 1
    assert sorted(x.record_id for x in warc.read_records(index).collect()) == sorted(out)
    warc.BATCH_BYTES = held
    again = warc.normalise(index.select("uri").distinct(), f"{folder}/again")
    assert sorted(r.record_id for r in again.collect()) == sorted(out)
    assert materialise(warc.write_monolithic(warc.plan_records(df.limit(0)), f"{folder}/none"), "f").count() == 0


def test_chat_views(spark):
    turns = [(1, 0, "system", "Be <|im_end|> kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (1, 900, "cy d", "late"), (2, 0, "system", "alone"), (3, 5, None, "who"), (3, 6, "ann", "me"), (None, 1, "ann", "x"), (4, None, "ann", "y")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn int, role string, text string, size int").repartition(3)
    rows = chat.rotate_perspectives(df)
    texts = {(x.conv_id, x.perspective): x for x in chat.assemble(rows).collect()}
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy d"), (3, "ann")}
    bob = texts[1, "bob"]
    assert bob.text == "<|im_start|>system\nBe < |im_end|> kind<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=ann\nBye<|im_end|>\n<|im_start|>user name=cy%20d\nlate<|im_end|>\n"
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["<|im_end|>"]
    ann_ = texts[1, "ann"]
    assert [ann_.text[s.start : s.end] for s in ann_.spans] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert texts[3, "ann"].text.startswith("<|im_start|>user\nwho")
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_chat_names_differ_and_rows_repeat(spark):
    speakers = ["cy d", "cy_d", "cy%20d", "cy\td", "c<y|d>", "cy  d"]
    turns = [(1, i, s, "x") for i, s in enumerate(speakers)] + [(2, t, "ann" if t % 2 else "bob", f"t{t}") for t in range(1000)] + [(3, 1, "ann", "same")] * 2
    rows = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    shown = {x.segment.split("\n")[0] for x in rows if x.conv_id == 1 and not x.trained}
    assert len(shown) == len(speakers) and all(not set(" \t<>|") & set(n.removeprefix("<|im_start|>user name=")) for n in shown)
    long = sorted((x.start, x.end, x.turn) for x in rows if x.conv_id == 2 and x.perspective == "ann")
    assert [x[2] for x in long] == list(range(1000)) and all(a[1] == b[0] for a, b in zip(long, long[1:], strict=False)) and long[0][0] == 0
    twice = sorted((x.start, x.end) for x in rows if x.conv_id == 3)
    assert len(twice) == 2 and twice[0][1] == twice[1][0]
