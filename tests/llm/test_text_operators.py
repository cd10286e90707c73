import functools
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import decontaminate, license_scan, line_dedup, quality, toxicity
from strataspark.llm.batches import LIMIT, SPARKS_OWN, map_texts
from strataspark.llm.words import LETTERS_ONLY, chunks, shingles


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_words_and_shingles():
    texts = ["The  cat\nsat", None, "", "É cat", "the cat sat"]
    (i, j, w), = chunks(pa.array(texts))
    assert (i, j, np.diff(w.first).tolist()) == (0, 5, [3, 0, 0, 2, 3])
    h, at = shingles(w, 2)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 2] and (h[:2] == h[-2:]).all()
    whole, at = shingles(w, 9)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 1] and whole[0] == whole[2]


@pytest.mark.parametrize("least, least_edit", [(0, 0), (10, 20)])
def test_lines_equal_brute_force(spark, least, least_edit):
    r = random.Random(3)
    base = ["".join(r.choice("abcde ") for _ in range(n)) for n in (12, 19, 20, 21, 25, 25, 33, 48, 64, 100, 301)] + ["short", "", "éü" * 14]
    lines = []
    for line in base * 5:
        k = r.randrange(4)
        at = r.randrange(len(line) + 1)
        lines.append([line, line[:at] + "x" + line[at:], line[:at] + line[at + 1 :], line[: max(0, at - 1)] + "z" + line[at:]][k])
    r.shuffle(lines)
    docs, k = [], 0
    for i in range(20):
        n = r.randint(1, 5)
        docs.append((i * 7 % 20, "\n".join(lines[k : k + n])))
        k += n
    docs += [(50, None), (51, ""), (52, docs[3][1])]
    df = spark.createDataFrame([(i, t, "l", "k") for i, t in docs], "doc_id long, text string, line string, first string").repartition(5)
    seen, want = [], {}
    for i, t in sorted(docs):
        out = []
        for line in (t or "").split("\n"):
            again = len(line) >= max(1, least) and (line in seen or (len(line) >= least_edit and any(s and len(s) >= least_edit and abs(len(s) - len(line)) < 2 and edit(line, s) == 1 for s in set(seen))))
            seen.append(line)
            if not again:
                out.append(line)
        want[i] = None if t is None else "\n".join(out)
    how = {"min_chars": least, "min_chars_edit": least_edit} if least else {}
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df, **how).collect()}
    assert got == want
    assert set(line_dedup.drop_repeated_lines(df, **how).columns) == {"doc_id", "text", "line", "first"}
    assert 51 in {x.doc_id for x in line_dedup.drop_repeated_lines(df, **how).collect()} and 52 not in {x.doc_id for x in line_dedup.drop_repeated_lines(df, **how).collect()}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df, **how).collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_lines_of_any_length_and_clashing_names(spark):
    r = random.Random(4)
    short = ["", "a", "b", "ab", "abc", "xbc", "abcd", "qqqq", "a", "zz top", "zz tap", "ab"]
    long = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (900, 1100, 20_000)]
    near = []
    for x in long:
        for _ in range(3):
            k = r.randrange(len(x))
            near.append(r.choice([x[:k] + "X" + x[k:], x[:k] + x[k + 1 :], x[:k] + "Y" + x[k + 1 :]]))
    lines = short + long + near + ["Z" + long[0], long[1] + "Z", long[2][1:], "Q" + long[2][1:], "12" + long[0]]
    docs = [(i, t) for i, t in enumerate(lines)]
    schema = "doc_id long, text string, n_lines int, gone int, gone_id int, line string"
    df = spark.createDataFrame([(i, t, 77, 1, 2, "l") for i, t in docs], schema)
    edit_one = lambda a, b: abs(len(a) - len(b)) <= 1 and _one_edit(a, b)
    want = {i for i, t in docs if t and any(u and (t == u or edit_one(t, u)) for _, u in docs[:i])}
    out = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(df.select("doc_id", "text", "gone")).collect()}
    assert {i for i, n in out.items() if n} == want
    kept = line_dedup.drop_repeated_lines(df)
    assert kept.columns == df.columns and {(x.doc_id, x.n_lines, x.gone) for x in kept.collect()} == {(i, 77, 1) for i, _ in docs if i not in want}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def test_contamination(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 15, 12, 7, 5, 4, 50))] + [(90, None), (91, "")]
    text = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i, item in items[:7]:
        w = item.split()
        docs.append((i, f"{text(40)} {item.upper()}, {text(9)}"))
        if i != 5:
            want.add((i, i))
        if len(w) >= 12:
            some = [word() if k % 7 == 3 else x for k, x in enumerate(w)]
            docs.append((i + 10, text(3) + " " + " ".join(some)))
            want.add((i + 10, i))
        docs.append((i + 20, text(100)))
    docs += [(60, None), (61, ""), (62, " ".join(items[6][1].split()[20:34])), (None, items[0][1])]
    want.add((62, 6))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(df.drop("item_id"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in out} == want
    hit = next(x for x in out if x.doc_id == 0)
    assert (hit.start_word, hit.end_word, hit.equal_words) == (40, 70, 30)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs if i is not None} - {a for a, _ in want}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_masks_hit_every_allowed_overlap():
    for low, high, masks in decontaminate.FAMILIES:
        hits = lambda n: [sum(1 << (o + j) for j, b in enumerate(m) if b == "1") for m in masks for o in range(n - len(m) + 1)]  # noqa: B023, E731
        for n in range(low, min(high, 23) + 1):
            at = hits(n)
            for other in combinations([1 << k for k in range(n)], n // 5):
                assert any(not h & sum(other) for h in at), (n, other)


def test_contamination_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(n, [word() for _ in range(n)]) for n in range(4, 26)]
    docs, lies = [], []
    for i, w in items:
        for _ in range(60):
            k = r.randint(min(12, len(w)), len(w))
            part = w[(at := r.randint(0, len(w) - k)) : at + k]
            for x in r.sample(range(k), min(k, k // 5 + r.choice((0, 0, 1)))):
                part[x] = word()
            front = [word() for _ in range(r.choice((0, 3)))]
            docs.append((len(docs), " ".join(front + part + [word() for _ in range(r.choice((0, 3)))])))
            lies.append((i, w, len(front) - at))
    want = set()
    for (d, t), (i, w, lie) in zip(docs, lies, strict=True):
        t = t.split()
        same = {j: t[j] == w[j - lie] for j in range(max(0, lie), min(len(t), lie + len(w)))}
        for a in same:
            for b in range(a + min(len(w), 12), max(same) + 2):
                if len(w) >= 5 and 5 * sum(same[j] for j in range(a, b)) >= 4 * (b - a):
                    want.add((d, i))
    want |= {(d, i) for d, t in docs for i, w in items if len(w) < 5 and t.split() == w}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in out} == want and 0 < len(want) < len(docs)


def test_contamination_of_repeated_rows_and_one_word_texts(spark):
    import time

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    a, b = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(15))
    bench = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, "the " * 60, "x")], "item_id long, text string, doc_id string")
    docs = [(1, a, 0), (1, a, 0), (1, word() + " " + b, 1), (2, "the " * 20_000, 2), (3, b, 3), (4, b, 3), (None, b, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, t1 int").repartition(3)
    start = time.time()
    out = sorted((x.doc_id, x.item_id, x.equal_words, x.start_word, x.end_word) for x in decontaminate.contaminated(df, bench).collect())
    assert out == [(1, 1, 20, 0, 20), (2, 2, 60, 0, 60), (3, 1, 15, 0, 15), (4, 1, 15, 0, 15)] and time.time() - start < 30
    assert decontaminate.drop_contaminated(df, bench).count() == 0 and decontaminate.drop_contaminated(df, bench).columns == df.columns


def test_items_of_a_few_words_are_compared_with_whole_texts(spark, monkeypatch):
    items = [(1, "Red fox jumps high"), (2, "word"), (3, "two words"), (4, "--"), (5, None), (6, "a b c d e f g"), (7, "red FOX, jumps high!")]
    docs = [(1, "red fox -- jumps HIGH."), (2, "the red fox jumps high today"), (3, " Word "), (4, "two words"), (5, "two words more"), (6, ""), (7, None), (8, "x a b c d e f g y"), (9, "words two"), (4, "two words")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 4, 0, 4), (1, 7, 4, 0, 4), (3, 2, 1, 0, 1), (4, 3, 2, 0, 2), (8, 6, 7, 1, 8)}
    assert {tuple(x) for x in decontaminate.contaminated(d, b).collect()} == want
    assert {x.doc_id for x in decontaminate.drop_contaminated(d, b).collect()} == {2, 5, 6, 7, 9}
    short = b.where("item_id in (2, 3)")
    assert {tuple(x)[:2] for x in decontaminate.contaminated(d, short).collect()} == {(3, 2), (4, 3)}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    clashing = d.withColumns({"t1": F.lit(1), "t2": F.lit("x"), "item": F.lit(None).cast("int"), "words": F.lit(2)})
    left = decontaminate.drop_contaminated(clashing, b)
    assert left.columns == clashing.columns and left.count() == 5


def test_many_items_take_several_passes(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    docs = [(i, "some words before " + t) for i, t in items] + [(1000, "nothing of the kind here at all")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_FILTER", 18)
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, bench).collect()} == {(i, i) for i in range(200)}


def labelled(spark, bad, n=300):
    r = random.Random(4)
    calm = ["table", "green", "walk", "river", "stone", "light", "paper", "cloud"]
    rows = []
    for i in range(n):
        s = [" ".join(r.choices(calm, k=8)) for _ in range(r.randint(1, 9))]
        y = int(i % 3 == 0)
        if y:
            s[r.randrange(len(s))] += " " + r.choice(bad)
        rows.append((i, ". ".join(s) + ".", y))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    data = labelled(spark, ["vilexa", "vilexon", "Gruntz", "gruntz"])
    labels = data.select("doc_id", "toxic")
    model = toxicity.fit_toxicity(toxicity.labelled_sample(data.drop("toxic"), toxicity.training_labels(labels)))
    more = spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "green walk. you vilexum! river", 1), (903, "river " * 100_000, 0)], "doc_id long, text string, toxic int")
    out = {x.doc_id: x for x in toxicity.score_toxicity(data.union(more), model).collect()}
    truth = {x.doc_id: x.toxic for x in data.union(more).collect()}
    assert sum((out[i].score >= 0.7) == bool(truth[i]) for i in truth) >= 0.98 * len(truth)
    assert out[900].score == out[901].score == 0 and out[902].score >= 0.7 and out[903].score < 0.3
    (span,) = out[902].offending
    assert span.sentence == " you vilexum!" and (span.start, span.end) == (11, 24)
    kept = toxicity.drop_toxic(data.union(more), labels)
    assert kept.columns == data.columns and 902 not in {x.doc_id for x in kept.collect()} and 903 in {x.doc_id for x in kept.collect()}
    none = toxicity.fit_toxicity(data.limit(0).select("text", "toxic"))
    assert all(x.score < 0.01 for x in toxicity.score_toxicity(more, none).collect())


def test_toxicity_is_the_noisy_or_of_distinct_evidence(spark):
    import re

    from strataspark.llm.words import Words

    @functools.cache
    def features(word):
        data = np.frombuffer(word.encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), space=LETTERS_ONLY)
        return {int(w.hashes[0]), *(int(w.prefixes(k)[0]) for k in toxicity.PREFIXES)}

    bad = {"vile": 7.0, "grun": 4.5, "mean": 2.0}
    hashes = {min(features(k)): v for k, v in bad.items()}
    order = sorted(hashes)
    model = toxicity.ToxicityModel(np.array(order, np.uint64), np.array([hashes[h] for h in order]), -6.0)
    r = random.Random(7)
    texts = [" ".join(r.choice(["calm", "Vile", "grun", "mean", "tree", "a", "b.", "c!", "d\n", "...", "é"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["", None, "The river runs.\n" * 100_000, "." * 100_000, "mean tree. " * 50_000, "calm. " * 20_000 + "you vile grun"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    out = {x.doc_id: x for x in toxicity.score_toxicity(df, model).collect()}
    for i, t in enumerate(texts):
        seen = {frozenset(h for w in re.findall(r"[^\W_]+", s) for h in features(w.lower()) if h in hashes) for s in re.split(r"[.!?\n]+", t or "")}
        none = np.prod([1 - 1 / (1 + np.exp(6.0 - sum(hashes[h] for h in s))) for s in seen if s])
        assert abs(out[i].score - (1 - none)) < 1e-9, t[:80]
    n = len(texts)
    assert out[n - 4].score == out[n - 3].score == 0 and out[n - 2].score < 0.02 and out[n - 1].score > 0.9
    assert [s.sentence for s in out[n - 1].offending] == [" you vile grun"]


def test_toxicity_without_limits_of_features(spark):
    docs = [(i, f"fine words here{i % 3}" + (f" vilebad{i % 6}" if i % 2 else ""), i % 2) for i in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    some, every = toxicity.fit_toxicity(rows, max_features=2), toxicity.fit_toxicity(rows, max_features=None, min_docs=1)
    assert len(some.features) <= 2 < len(every.features)
    same = toxicity.fit_toxicity(rows, max_features=10**6, min_docs=1)
    assert (same.features == every.features).all() and (same.weights == every.weights).all()


def test_models_with_clashing_names_and_repeated_rows(spark):
    data = labelled(spark, ["vilexa", "vilexon"], 150)
    labels = data.select("doc_id", "toxic", F.col("toxic").alias("quality")).union(spark.createDataFrame([(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int"))
    docs = data.select("doc_id", F.col("text").alias("body"), *(F.lit("x").alias(c) for c in ("_label", "_id", "_picked", "label", "id", "text", "picked")))
    docs = docs.union(docs.limit(40))
    kept = toxicity.drop_toxic(docs, labels, text_col="body")
    assert kept.columns == docs.columns and kept.count() < docs.count()
    sample = quality.labelled_sample(docs, quality.training_labels(labels), text_col="body")
    model = quality.fit_quality(docs, sample, "body")
    out = quality.score_quality(docs, model, text_col="body").toPandas()
    assert len(out) == docs.count() and out.groupby("doc_id").score.nunique().max() == 1
    more = spark.createDataFrame([(1, "word " * 300_000), (2, None), (None, "x"), (4, "x")], "doc_id long, body string")
    assert all(0 <= x.score <= 1 for x in quality.score_quality(more, model, text_col="body").collect())
    assert toxicity.drop_toxic(docs.limit(0), labels, text_col="body").count() == 0


def test_quality_equals_brute_force(spark):
    """Votes of the nearest labelled vectors, ties among them included, worked out without blocks."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(["river", "stone", "tree"] if i % 2 else ["@@x", "##y", "$$z"], k=r.randint(3, 30))), i % 2) for i in range(80)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(data, data.select("text", "quality"), neighbours=200)
    got = {x.doc_id: x.score for x in quality.score_quality(data, model).collect()}
    x = np.concatenate(list(quality._blocks(pa.array([t for _, t, _ in rows]), model.idf)))
    unit = (x - model.centre) @ model.axes.T
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    weight = np.maximum(unit @ model.vectors.T, 1e-6)
    good, bad = ((weight * (model.labels == v)).sum(1) / (model.labels == v).sum() for v in (1, 0))
    for (i, _, _), want in zip(rows, good / (good + bad), strict=True):
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_quality_on_held_out(spark):
    r = random.Random(2)
    calm = ["the", "river", "runs", "past", "old", "stones", "and", "trees"]
    rows = []
    for i in range(240):
        good = i % 3 != 0
        w = r.choices(calm, k=40)
        text = " ".join(w) if good else " ".join([w[0]] * 40) if i % 2 else " | ".join(x + "$$$" for x in w)
        rows.append((i, text, int(good)))
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = data.select("doc_id", "quality")
    docs = data.drop("quality").union(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string"))
    model = quality.fit_quality(docs, quality.labelled_sample(docs, quality.training_labels(labels)))
    out = {x.doc_id: x.score for x in quality.score_quality(docs, model).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == 242
    assert sum((out[i] >= 0.3) == bool(y) for i, _, y in rows) >= 235
    assert quality.score_quality(docs, quality.fit_quality(docs, data.limit(0).select("text", "quality"))).first().score == 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0


def license_shingles(t):
    import re

    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses_equal_containment_in_the_whole_text(spark):
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "the", "license", "under", "work", "is"]) for _ in range(n))
    docs = []
    for i in range(110):
        w = license_scan.NOTICES[i % len(license_scan.NOTICES)][1].split()
        if i % 4 == 1 and len(w) > 20:
            w[-1] = "changed"
        if i % 4 == 2:
            w = w[: len(w) // 2]
        docs.append((i, f"{filler(r.randint(0, 40))}\n{' '.join(w).upper() if i % 3 else ' '.join(w)}\n{filler(r.randint(0, 300))}"))
    docs += [(200, None), (201, ""), (202, "MIT"), (203, filler(60_000)), (204, filler(20_000) + " Released under the MIT License. " + filler(10)), (0, docs[0][1])]
    want = {}
    for i, t in docs:
        own = license_shingles(t)
        numbers = lambda full: {x for x in full if any(w.isdigit() for w in x)}
        shares = [(len(own & (full := license_shingles(n))) / len(full) * (numbers(full) <= own), name, full) for name, n in license_scan.NOTICES]
        for share, name, full in shares:
            # a sibling that shares these shingles and has more of its own is the better one
            better = any(other > share and len(full & its) * 2 > len(full) for other, _, its in shares)
            if share >= 0.8 and not better:
                want[i, name] = max(want.get((i, name), 0), share)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, sh string, at int")
    got = {(x.doc_id, x.license_id): x.containment for x in license_scan.scan_licenses(df).collect()}
    assert got == want and len(want) > 50 and got[204, "MIT"] == 1.0
    assert got.get((11, "GPL-2.0")) == 1.0 and (11, "GPL-3.0") not in got
    assert license_scan.scan_licenses(df, license_scan.notices(spark).limit(0)).count() == 0
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_versions_are_told_apart(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 4.", "This work is licensed under the GNU Lesser General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 2.1!",
        "work is licensed under the gnu general public license version 3", "This work is licensed under a Creative Commons Attribution 2.0 International License.", "Licensed under the Apache License, Version 1.1.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2]), (9, (texts[3] + " filler ") * 2)], "doc_id long, text string")
    got = {(x.doc_id, x.license_id) for x in license_scan.scan_licenses(df).collect()}
    assert got == {(2, "LGPL-2.1"), (3, "GPL-3.0"), (9, "GPL-3.0")}
    same = spark.createDataFrame([("A", "one two three four five six"), ("B", "one two three four five six")], "license_id string, text string")
    assert {x.license_id for x in license_scan.scan_licenses(spark.createDataFrame([(1, "x one two three four five six y")], "doc_id long, text string"), same).collect()} == {"A", "B"}


def test_full_license_texts_in_blocks(spark):
    r = random.Random(2)
    texts = {f"L{k}": " ".join(f"w{r.randrange(5000)}" for _ in range(3000)) for k in range(4)}
    templates = spark.createDataFrame(list(texts.items()) + [("none", None), ("few", "a b c")], "license_id string, text string")
    docs = [(k, "before " * 50 + t + " after") for k, t in enumerate(texts.values())] + [(9, " ".join(texts["L1"].split()[:2000])), (10, " ".join(w if i % 40 else "x" for i, w in enumerate(texts["L2"].split())))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (20_000, 4000):
        got = {(x.doc_id, x.license_id): x.containment for x in license_scan.scan_licenses(df, templates, block_words=block).collect()}
        assert set(got) == {(k, f"L{k}") for k in range(4)} | {(10, "L2")} and got[0, "L0"] == 1.0


def test_batches_are_of_bounded_bytes_unless_the_session_says_otherwise(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 1000) AS text").union(spark.range(1).selectExpr("repeat('y', 300000) AS text"))
    own = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, SPARKS_OWN)
    sizes = [x.n for x in map_texts(docs, rows, "n long", 1 << 17).collect()]
    assert sum(sizes) == 3001 and max(sizes) < 200
    spark.conf.set(LIMIT, "16777216")
    assert [x.n for x in map_texts(docs, rows, "n long", 1 << 17).collect()] == [3000, 1]
    spark.conf.set(LIMIT, own)
