"""Text quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of hashed terms: words, weighted by tf-idf with document frequencies counted over all documents, and pairs of neighbouring bytes (case and signs included), weighted by tf.
A truncated singular value decomposition of labelled documents gives the latent space. The labelled vectors are broadcast (their number is a parameter); every document
takes exact cosine products with all of them, in blocks, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.batches import map_texts
from strataspark.llm.words import LETTERS_ONLY, Words, chunks, mix
from strataspark.scratch import materialise

#: Buckets of words and of byte pairs, and the texts that are worked on at once.
WORD_TERMS, PAIR_TERMS, BLOCK = 2048, 1024, 256
_PAIR = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_TERMS)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """The latent space and the labelled vectors in it (unit length), with a label each."""

    idf: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int


def _word_counts(w: Words, n: int) -> np.ndarray:
    word = w.text_of_word() * WORD_TERMS + (w.hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    return np.bincount(word, minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)


def _pair_counts(w: Words, n: int) -> np.ndarray:
    if len(w.data) < 2:
        return np.zeros((n, PAIR_TERMS), np.int64)
    pair = _PAIR[w.data[:-1].astype(np.int64) * 256 + w.data[1:]]
    of = np.repeat(np.arange(n), np.diff(w.text_at))
    within = of[:-1] == of[1:]
    return np.bincount(of[:-1][within] * PAIR_TERMS + pair[within], minlength=n * PAIR_TERMS).reshape(n, PAIR_TERMS)


def _document_counts(batches):
    """In how many texts each word term occurs; one row a task and term, and one of the texts in all."""
    total, texts = np.zeros(WORD_TERMS, np.int64), 0
    for batch in batches:
        for i, j, w in chunks(batch.column(0), space=LETTERS_ONLY):
            key = np.unique(w.text_of_word() * WORD_TERMS + (w.hashes % np.uint64(WORD_TERMS)).astype(np.int64))
            total += np.bincount(key % WORD_TERMS, minlength=WORD_TERMS)
            texts += j - i
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WORD_TERMS)), pa.array(np.concatenate(([texts], total)))], ["term", "texts"])


def _blocks(column, idf):
    """Term vectors of the texts, at most BLOCK at a time: words and byte pairs of length 1 each, or 0 where a text has none."""
    for k in range(0, len(column), BLOCK):
        for i, j, w in chunks(column.slice(k, BLOCK), space=LETTERS_ONLY):
            parts = [np.log1p(_word_counts(w, j - i)) * idf, np.log1p(_pair_counts(w, j - i))]
            yield np.concatenate([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in parts], axis=1).astype(np.float32)


def _leading_axes(x: np.ndarray, axes: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    width = min(axes + 8, *x.shape)
    basis = np.random.Generator(np.random.PCG64(1)).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (right @ basis.T)[: min(axes, width)].astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", per_class: int = 1500) -> DataFrame:
    """``(text_col, label_col)`` of at most ``per_class`` documents of either label, picked by a hash of their id (the bound of the model's size).

    Of an id labelled more than once the larger label counts; null ids and labels are left out.
    """
    key = labels.select(F.col(id_col).alias("picked"), F.col(label_col).cast("int").alias("label")).where("picked is not null").groupBy("picked").agg(F.max("label").alias("label"))
    both = [key.where(F.col("label") == v).orderBy(F.xxhash64("picked"), "picked").limit(per_class) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(materialise(both[0].union(both[1]), "labelled")), F.col("id") == F.col("picked"))
    return texts.select(F.col("text").alias(text_col), F.col("label").alias(label_col))


def fit_quality(
    docs: DataFrame, labelled: DataFrame, text_col: str = "text", label_col: str = "quality", axes: int = 16, neighbours: int = 15
) -> QualityModel:
    """Document frequencies from all of ``docs``, the latent space and its labelled vectors from ``labelled`` (bounded by :func:`labelled_sample`). Null texts count as empty, rows with a null label don't count."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = map_texts(texts, _document_counts, "term long, texts long").groupBy("term").agg(F.sum("texts").alias("texts")).collect()
    count = {r.term: r.texts for r in counted}
    total = count.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + count.get(t, 0))) for t in range(WORD_TERMS)], np.float32)

    def vectors(batches):
        for batch in batches:
            rows = [x for block in _blocks(batch.column(0), idf) for x in block]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), batch.column(1)], ["v", "label"])

    sample = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    sample = map_texts(sample, vectors, "v array<float>, label int").toPandas()
    if not len(sample):
        return QualityModel(idf, np.zeros(1), np.zeros((0, 0)), np.zeros((0, 0), np.float32), np.zeros(0), neighbours)
    x, y = np.stack(sample["v"].to_numpy()), sample["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x[:, :8].T, x.sum(1), y))  # the same rows in any order give the same model
    x, y = x[order], y[order]
    centre = x.mean(0)
    latent = _leading_axes((x - centre).astype(np.float32), axes)
    return QualityModel(idf, centre, latent, _unit(x, centre, latent).astype(np.float32), y, neighbours)


def _unit(x: np.ndarray, centre: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """Directions in the latent space; a text at the centre has none and is the zero vector."""
    out = (x - centre) @ latent.T
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row: the share of label 1 among the nearest labelled documents, in [0, 1], each weighted by its similarity.

    Votes of a label are divided by how many labelled vectors it has, so that both count alike, however often either was drawn. Null and empty texts are the
    zero vector of terms and are scored like any other. Without labelled documents all scores are 0.5. Repeated rows come back as often, a null id stays null, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out = []
            for block in _blocks(batch.column(1), model.idf) if len(model.labels) else ():
                near = _unit(block, model.centre, model.axes) @ model.vectors.T
                k = min(model.neighbours, near.shape[1])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64)
                good, bad = ((weight * (model.labels[top] == v)).sum(1) / max(1, (model.labels == v).sum()) for v in (1, 0))
                out.append(good / (good + bad))
            score = np.concatenate(out) if out else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "id long, score double").withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: those with crc32(id as text) mod 5 other than 0; the rest is held out."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
