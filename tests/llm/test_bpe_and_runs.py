import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataspark.llm.bpe_transducer import Decoder, Merges, Transducer, decode_bpe, with_bpe
from strataspark.llm.periodic_runs import find_runs, strongest, with_runs
from strataspark.llm.queries import WORD_VOCABULARY

ATOMS = ["a", "the", "ing", "'", "'s", "'l", "l", "!", "...", "1", "½", " ", "\n", "\x85", "　", "é", "é", "́", "Σ", "İ", "<|endoftext|>", "<|endof", "<|", "<|startoftext|>", "각", "日本", "\x1c", "𝔸", "zzz", "'ve", "VE", "​"]


@pytest.fixture(scope="module")
def merges():
    return Merges(WORD_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


def test_any_steps_give_the_librarys_ids(merges, library):
    r, decoder = random.Random(1), Decoder(merges)
    for k in range(900):
        text = "".join(r.choice(ATOMS) for _ in range(r.randint(0, 60))) if k % 3 else "".join(r.choice("etaoinshr") for _ in range(r.randint(0, 3000)))
        want = library.encode(text, add_special_tokens=False).ids
        e = Transducer(merges, window=r.choice([1, 50, 1024]), hold=r.choice([4, 64]))
        step = r.choice([50, 1 << 16] if k % 3 == 0 else [1, 2, 7, 50])
        e.start()
        got = [x for i in range(0, max(1, len(text)), step) for x in e.feed(text[i : i + step], i + step >= len(text))]
        assert got == want, text
        assert decoder.decode(got, step) == library.decode(want, skip_special_tokens=False)


def test_state_stays_small(merges, library):
    r = random.Random(2)
    for text in ("".join(r.choice("etaoinshr") for _ in range(60_000)), "?" * 60_000, "日本" * 20_000, "the cat " * 20_000, "a" * 50_000, "1" * 20_000):
        e, got, most = Transducer(merges), [], 0
        for i in range(0, len(text), 500):
            got += e.feed(text[i : i + 500], i + 500 >= len(text))
            most = max(most, e.held())
        assert got == library.encode(text, add_special_tokens=False).ids
        assert most <= 1024 + merges.lookahead + 1500


def test_stable_tokens_stay_whatever_follows(merges):
    r = random.Random(3)
    pool = [t for t in merges.vocab if t.isascii() and t.isalpha()]
    for _ in range(200):
        known = "".join(r.choice(pool) for _ in range(250)).encode()
        sure = []
        for tail in (b"", b"x", "".join(r.choice(pool) for _ in range(40)).encode()):
            done, own = 0, []
            for x in merges.merge([merges.inner[b] for b in known + tail]):
                done += merges.size[x]
                if done > len(known) - merges.lookahead:
                    break
                own.append(x)
            sure.append(own)
        assert sure[0] == sure[1] == sure[2] and sum(merges.size[x] for x in sure[0]) > len(known) - merges.lookahead - merges.longest


def test_rules_that_no_lookahead_bounds_are_refused():
    pieces = [*"abc"]
    from strataspark.llm.bpe_transducer import BYTES, NORMAL, WORDS, byte_alphabet

    vocab = {t: i for i, t in enumerate([*byte_alphabet(), *(c + "</w>" for c in byte_alphabet()), "ab", "abc"])}
    data = {"normalizer": {"normalizers": NORMAL}, "pre_tokenizer": {"pretokenizers": [WORDS, BYTES]}, "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": ["ab c", "a b"]}}
    with pytest.raises(ValueError, match="later rule"):
        Merges(data=data)
    data["model"]["merges"] = ["a b", "ab c"]
    assert Merges(data=data).lookahead == 2 and pieces


def test_with_bpe_rows(spark, merges, library):
    texts = [None, "", "Hello  World's <|endoftext|>", "Σ é", "same", "same", "x" * 200_000, " \n "]
    rows = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, TOKEN_IDS int").repartition(3)
    got = {x.doc_id: x for x in with_bpe(rows, WORD_VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == want and got[i].n_tokens == len(want) and got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert with_bpe(rows.limit(0), WORD_VOCABULARY).count() == 0
    back = {x.doc_id: x.decoded for x in decode_bpe(with_bpe(rows, WORD_VOCABULARY, decode=False), WORD_VOCABULARY).collect()}
    assert back[2] == "hello world 's <|endoftext|> " and back[3] == "σ é " and back[0] == ""
    nulls = spark.createDataFrame([(1, None), (2, [256 + 200])], "doc_id long, token_ids array<int>")
    assert {x.doc_id: x.decoded for x in decode_bpe(nulls, WORD_VOCABULARY).collect()}[1] == ""


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(24, 3 * q) and not any(words[s : e + q - k] == words[s + k : e + q] for k in range(1, q)):
                out.append((s, e - s + q, q))
            s = e + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(r):
    alphabet = list("abcdefghijklmnop"[: r.choice([1, 2, 3, 16])])
    out = []
    while len(out) < r.randint(0, 260):
        piece = [r.choice(alphabet) for _ in range(r.choice([1, 2, 5, 8, 9, 15, 16, 17, 18, 31, 33, 40]))]
        whole = piece * r.randint(1, 6)
        out += whole[: len(whole) - r.randint(0, len(piece) - 1)]
        if r.random() < 0.3:
            out += out[r.randrange(len(out)) :]
    return out[:400]


def test_runs_equal_brute_force():
    r = random.Random(4)
    for _ in range(400):
        words = some_words(r)
        number = {w: i for i, w in enumerate(sorted(set(words)))}
        assert find_runs(np.array([number[w] for w in words], np.int64)) == brute_runs(words)


def test_runs_of_long_texts():
    assert find_runs(np.zeros(2_000_000, np.int64)) == [(0, 2_000_000, 1)]
    block = np.random.default_rng(5).integers(0, 1000, 70_000)
    assert find_runs(np.concatenate([[5000], np.tile(block, 4), [5001]])) == [(1, 280_000, 70_000)]
    assert find_runs(np.arange(500_000)) == []


def test_with_runs_rows(spark):
    r = random.Random(6)
    texts = [None, "", " \t\n", "one two", "x " * 24, "x " * 23, " a  b\n" * 30 + "tail", "é " * 40] + [" ".join(some_words(r)) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(4, texts[4], "own")], "doc_id long, text string, Runs string").repartition(3)
    got = with_runs(rows).select("*", strongest().alias("best")).collect()
    assert len(got) == len(texts) + 1 and with_runs(rows.limit(0)).count() == 0
    for x in got:
        words = (texts[x.doc_id] or "").split()
        runs = brute_runs(words)
        assert [tuple(v) for v in x.runs] == runs and x.n_words == len(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert x.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (tuple(x.best) if x.best else None) == (min(runs, key=lambda v: (-v[1] / v[2], v[0], v[2])) if runs else None)
    assert with_runs(rows).where(F.size("runs") > 0).count() > 5
