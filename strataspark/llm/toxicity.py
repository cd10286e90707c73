"""Toxic documents and sentences by multiple-instance learning.

Labels are of documents, scores of sentences: a sentence has a logistic score of its words, a document the noisy-or
of its sentences, ``1 - prod(1 - p)``. Weights are fitted to document labels through the noisy-or, so they learn which
sentences make a document toxic, and the same scores then locate them. Only sentences with a feature of the model are evidence, and sentences of the same
features are one piece of it: neither a text's length nor repetition makes it toxic. Features are words (runs of letters
and digits, A-Z lower-cased) and their first 4, 5 and 6 bytes, which catch inflected forms; only features that labelled toxic documents
have notably more often than others enter the model. They are told apart by 64-bit hashes, so other words don't collide with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.batches import map_texts
from strataspark.llm.words import LETTERS_ONLY, STEP, Words, chunks, mix
from strataspark.scratch import materialise

PREFIXES = (4, 5, 6)
#: Where the bias of a sentence starts and is drawn to, and what it can't exceed: a sentence needs features of some weight.
BIAS, HIGHEST_BIAS = -7.0, -6.0
#: Bytes that end a sentence.
ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass(frozen=True)
class ToxicityModel:
    """``bias`` of a sentence and a weight for each feature hash, in ascending order of hashes."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _features(w: Words) -> np.ndarray:
    return np.stack([w.hashes, *(w.prefixes(k) for k in PREFIXES)]) if len(w.hashes) else np.zeros((1 + len(PREFIXES), 0), np.uint64)


def _sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence of each word, first sentence of each text, and byte offsets where sentences begin (and the last ends). A run of end marks ends one sentence."""
    n = len(w.data)
    cut = np.zeros(n + 1, bool)
    end = ENDS[w.data]
    cut[1:] = end
    cut[1:n] &= ~end[1:]
    cut[w.text_at] = True
    begins = np.flatnonzero(cut[:n]) if n else np.zeros(0, np.int64)
    return np.searchsorted(begins, w.start, "right") - 1, np.searchsorted(begins, w.text_at), np.append(begins, n)


def _seen(batches):
    """Distinct features of each text."""
    for batch in batches:
        out = []
        for i, j, w in chunks(batch.column(0), space=LETTERS_ONLY):
            f = _features(w)
            out += [np.unique(f[:, w.first[t] : w.first[t + 1]]).astype(np.int64) for t in range(j - i)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), batch.column(1)], ["seen", "toxic"])


def _hits(features: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have which of the model's features."""
    at = np.searchsorted(features, f)
    at[at == len(features)] = 0
    kind, word = np.nonzero(features[at] == f) if len(features) else (np.zeros(0, int), np.zeros(0, int))
    return word, at[kind, word] if len(word) else np.zeros(0, int)


def _evidence(w: Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pieces of evidence of each text, ``(text, sentence)`` where each occurs first, and their (piece, feature) pairs."""
    of, first, _ = _sentences(w)
    word, at = _hits(features, _features(w))
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    pair = np.unique(of[word].astype(np.int64) * len(features) + at)
    sent, feat = pair // len(features), pair % len(features)
    sent, begin = np.unique(sent, return_index=True)
    text = np.searchsorted(first, sent, "right") - 1
    kind = mix(np.add.reduceat(mix(feat.astype(np.uint64) + np.uint64(1)), begin) + STEP * text.astype(np.uint64))
    _, one = np.unique(kind, return_index=True)
    one = np.sort(one)
    size = np.diff(np.append(begin, len(feat)))[one]
    row = np.repeat(begin[one] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return text[one], sent[one], np.repeat(np.arange(len(one)), size), feat[row]


def _instances(features: np.ndarray):
    """For training: the (piece, feature) pairs of each text's evidence."""

    def run(batches):
        for batch in batches:
            sent, feat = [], []
            for i, j, w in chunks(batch.column(0), space=LETTERS_ONLY):
                text, _, piece, own = _evidence(w, features)
                cut = np.searchsorted(text[piece] if len(piece) else piece, np.arange(j - i + 1))
                sent += [piece[cut[t] : cut[t + 1]].astype(np.int32) for t in range(j - i)]
                feat += [own[cut[t] : cut[t + 1]].astype(np.int32) for t in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(sent, pa.list_(pa.int32())), pa.array(feat, pa.list_(pa.int32())), batch.column(1)], ["sent", "feat", "toxic"])

    return run


def fit_toxicity(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_features: int | None = 20_000, min_docs: int = 5, rounds: int = 400
) -> ToxicityModel:
    """Fit on ``labelled(text_col, label_col 0/1)``, which :func:`labelled_sample` bounds.

    A feature needs ``min_docs`` toxic texts (in fewer it can't be told from chance); the ``max_features`` with the most to say bound the model's size. None and 1 take every feature of the sample that tells the labels apart. Rows with a null label are left out, null texts
    count as empty, repeated rows count as often as they come. Without toxic rows the model has no features and all scores are 0.
    """
    sample = materialise(
        labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null"), "toxic-sample"
    )
    totals = sample.agg(F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic <> 1"))).first()
    many, few = max(1, totals[0]), max(1, totals[1])
    counts = map_texts(sample, _seen, "seen array<long>, toxic int").select("toxic", F.explode("seen").alias("f"))
    counts = counts.groupBy("f").agg(F.count_if(F.expr("toxic = 1")).alias("yes"), F.count_if(F.expr("toxic <> 1")).alias("no"))
    gain = F.log((F.col("yes") + 0.5) / (many + 1.0)) - F.log((F.col("no") + 0.5) / (few + 1.0))
    # two standard errors below the log ratio must still be a factor of five: else noise in the labels makes features
    sure = gain - 2 * F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    chosen = counts.where((F.col("yes") >= min_docs) & (sure > 1.6))
    chosen = chosen if max_features is None else chosen.orderBy((gain * F.col("yes")).desc(), "f").limit(max_features)
    features = np.sort(np.array([r.f for r in chosen.select("f").collect()], np.int64).astype(np.uint64))
    rows = map_texts(sample, _instances(features), "sent array<int>, feat array<int>, toxic int").toPandas()
    return _train(rows, features, rounds)


def _train(rows, features: np.ndarray, rounds: int) -> ToxicityModel:
    n = len(rows)
    if not n or not len(features):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), BIAS)
    y = rows["toxic"].to_numpy() == 1
    lengths = np.array([len(x) for x in rows["sent"]])
    doc = np.repeat(np.arange(n), lengths)
    piece, feat = np.concatenate(rows["sent"].to_list()).astype(np.int64), np.concatenate(rows["feat"].to_list()).astype(np.int64)
    key, sent = np.unique(doc * (1 << 32) + piece, return_inverse=True)
    sent_doc = key >> 32
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    w, b = np.zeros(len(features)), BIAS
    gw, gb = np.full(len(features), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(sent, w[feat], minlength=len(key))
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        pull = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0) * share  # d loss / d sum of p
        dz = pull[sent_doc] * p
        dw = np.bincount(feat, dz[sent], minlength=len(features)) + 2e-6 * w
        db = dz.sum() + 2e-4 * (b - BIAS)
        gw, gb = gw + dw**2, gb + db**2
        w -= 0.5 * dw / np.sqrt(gw)
        b = min(HIGHEST_BIAS, b - 0.2 * db / np.sqrt(gb))
    keep = np.abs(w) > 1e-3
    return ToxicityModel(features[keep], w[keep], float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", per_class: int = 4000) -> DataFrame:
    """``(text_col, label_col)`` of at most ``per_class`` labelled documents of either label, picked by a hash of their id.

    The bound is for fitting only. The ids are few enough to broadcast (at most twice ``per_class``), so the texts are not shuffled. Of an id labelled more than once the larger label counts; null ids and labels are left out.
    """
    key = labels.select(F.col(id_col).alias("picked"), F.col(label_col).cast("int").alias("label")).where("picked is not null").groupBy("picked").agg(F.max("label").alias("label"))
    both = [key.where(F.col("label") == v).orderBy(F.xxhash64("picked"), "picked").limit(per_class) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(materialise(both[0].union(both[1]), "labelled")), F.col("id") == F.col("picked"))
    return texts.select(F.col("text").alias(text_col), F.col("label").alias(label_col))


def _scores(model: ToxicityModel, report: float):
    def run(batches):
        for batch in batches:
            score, spans = [], []
            for i, j, w in chunks(batch.column(1), space=LETTERS_ONLY):
                text, _, piece, feat = _evidence(w, model.features)
                p = 1 / (1 + np.exp(-model.bias - np.bincount(piece, model.weights[feat], minlength=len(text))))
                none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=j - i)
                score += np.abs(np.expm1(none)).tolist()
                if report <= 1:
                    spans += _offending(w, model, report, j - i)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]))
            spans = pa.array(spans, kind) if report <= 1 else pa.nulls(len(batch), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), spans], ["id", "score", "offending"])

    return run


def _offending(w: Words, model: ToxicityModel, report: float, n: int) -> list[list[dict]]:
    """All sentences of each text that score ``report`` or more, repeated ones too."""
    of, first, begins = _sentences(w)
    word, at = _hits(model.features, _features(w))
    if not len(word):
        return [[] for _ in range(n)]
    pair = np.unique(of[word].astype(np.int64) * len(model.features) + at)
    sent, begin = np.unique(pair // len(model.features), return_index=True)
    p = 1 / (1 + np.exp(-model.bias - np.add.reduceat(model.weights[pair % len(model.features)], begin)))
    hot = p >= report
    out = [[] for _ in range(n)]
    for s, score, t in zip(sent[hot].tolist(), p[hot].tolist(), (np.searchsorted(first, sent[hot], "right") - 1).tolist(), strict=True):
        a, b, base = int(begins[s]), int(begins[s + 1]), int(w.text_at[t])
        out[t].append({"start": a - base, "end": b - base, "score": score, "sentence": w.data[a:b].tobytes().decode("utf-8", "replace")})
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", report: float = 0.5) -> DataFrame:
    """``(id_col, score, offending)`` for every row of ``docs``, over whole texts.

    ``score`` is the noisy-or in [0, 1]; ``offending`` lists the sentences that score ``report`` or more, with UTF-8 byte offsets.
    Null and empty texts have no sentences and score 0, as do texts without a feature of the model, however long. Repeated rows come back as often; a null id stays null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, score double, offending array<struct<start: long, end: long, score: double, sentence: string>>"
    return map_texts(rows, _scores(model, report), schema).withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: those with crc32(id as text) mod 3 other than 1; the rest is held out."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 3 != 1)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more under a model fitted to ``labels``. Columns may have any names; null texts stay."""
    model = fit_toxicity(labelled_sample(docs, training_labels(labels, id_col), id_col, text_col=text_col), text_col)

    def clean(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), text], ["id", "text"])
            score = np.concatenate([x.column(1).to_numpy() for x in _scores(model, 2.0)([rows])])
            yield batch.filter(pa.array(score < threshold))

    return map_texts(docs, clean, docs.schema)
