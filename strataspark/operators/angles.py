"""Exact joins of vectors by a least cosine, without the full product and without a row for every pair of a dense group.

The angle between vectors is a metric. Some vectors, far apart from each other, are pivots; every vector belongs to the cell of its nearest one, and a cell is cut into chunks of bounded rows by the angle to its pivot.
A chunk knows its least and greatest angle to every pivot, so by the triangle inequality two chunks have bounds of the angles between their members: a pair of chunks whose least is too wide is skipped, one whose
greatest is narrow enough is full (all its pairs are links, without a look at them), and only what is between is multiplied out.

Only pivots travel with the tasks, at most ``PIVOTS`` of them. Chunks are compared in blocks, pairs of tiles of a few chunks are one group each, of bounded numbers, so no task depends on how many rows are near each other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataspark.operators.knn_cells import matrix
from strataspark.operators.scan import number_rows
from strataspark.scratch import materialise

#: Vectors that pivots are picked from, pivots at most, rows of a chunk, chunks that are compared in one task.
SAMPLE, PIVOTS, CHUNK_ROWS, COMPARED = 1024, 128, 2048, 512
#: Chunks to a tile, and numbers of their vectors; pairs of tiles are one task's group, to which a vector is copied once for all pairs of chunks.
TILE_CHUNKS, TILE_NUMBERS = 8, 1 << 20
#: Cosines count as floats, unless doubles are asked for; bounds leave this much room for either and for rounding of angles.
_MARGIN = 1e-6


class Links(NamedTuple):
    """All pairs of rows at or over a cosine: those of ``pairs``, and of each row ``(a, b)`` of ``full`` every member of the one chunk with every member of the other (with ``a = b``: every two of the chunk). No pair is in both.

    ``report`` is one row: ``pairs`` that there are, ``computed`` cosines, ``given`` as full.
    """

    pairs: DataFrame  #: (a, b, cosine), a < b
    members: DataFrame  #: (id, chunk) of the chunks that ``full`` names
    full: DataFrame  #: (a, b), a <= b
    report: DataFrame


def usable_vectors(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, embedding) of the rows whose vector isn't null, empty or zero."""
    have = rows.where("embedding is not null and size(embedding) > 0").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return have.where(F.exists("embedding", lambda x: x != 0))


def _units(column: pa.Array, size: int) -> np.ndarray:
    x = matrix(column, size)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _far_apart(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Up to ``most`` of these unit vectors, each the farthest from those before, none nearer to another than ``apart``."""
    picked = [0]
    near = _angles(x, x[:1])[:, 0]
    while len(picked) < most and near.max() > apart:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _angles(x, x[picked[-1:]])[:, 0])
    return x[picked]


def _pivots(vectors: DataFrame, most: int, apart: float) -> dict[int, np.ndarray]:
    """Pivots by length of vector, picked from ``SAMPLE`` vectors of smallest hash. A length that isn't among them has none, and its chunks have no bounds."""
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    sizes = np.diff(picked.offsets.to_numpy()) if len(picked) else np.empty(0, int)
    out = {}
    for size in np.unique(sizes).tolist():
        x = _units(picked.take(pa.array(np.flatnonzero(sizes == size))), size)
        x = x[np.isfinite(x).all(1)]
        if len(x):
            out[size] = _far_apart(x, max(1, most * len(x) // len(sizes)), apart)
    return out


class _Chunks(NamedTuple):
    rows: DataFrame  #: (id, embedding, chunk)
    pairs: DataFrame  #: (a, b, full, load) of the pairs of chunks that aren't skipped
    total: DataFrame  #: (pairs) one row
    id_kind: object
    chunk_rows: int


def _chunked(rows: DataFrame, threshold: float, chunk_rows: int, pivots: int | None) -> _Chunks:
    vectors = materialise(usable_vectors(rows), "vectors")
    id_kind = vectors.schema["id"].dataType
    limit = float(np.float32(threshold))
    wide = float(np.arccos(np.clip(limit - _MARGIN, -1, 1))) + _MARGIN
    narrow = float(np.arccos(np.clip(limit + _MARGIN, -1, 1))) - _MARGIN
    if pivots is None:  # as many as there are chunks
        pivots = min(PIVOTS, max(1, vectors.count() // chunk_rows))
    centres = _pivots(vectors, pivots, max(narrow, 0.0) / 4)

    def to_cell(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            cell, angle = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                if size in centres:
                    at = np.flatnonzero(sizes == size)
                    d = _angles(_units(column.take(pa.array(at)), size), centres[size])
                    cell[at], angle[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    placed = vectors.mapInArrow(to_cell, f"id {id_kind.simpleString()}, embedding array<float>, cell int, angle double").withColumn("size", F.size("embedding"))
    ring = F.floor((F.col("pos") - 1) / chunk_rows)
    # length, cell and ring of a chunk in one number
    name = F.shiftleft(F.col("size").cast("long"), 40) + F.shiftleft(F.col("cell").cast("long"), 32) + ring
    dealt = materialise(number_rows(placed, ["size", "cell"], ["angle", "id"]).select("id", "embedding", name.alias("chunk")), "chunks")

    def bounds(part: pa.Table) -> pa.Table:
        chunk = part["chunk"][0].as_py()
        low = high = np.empty(0)
        if (size := chunk >> 40) in centres:
            d = _angles(_units(part["embedding"], size), centres[size])
            low, high = d.min(0), d.max(0)
        kind = pa.list_(pa.float64())
        return pa.table([pa.array([chunk]), pa.array([part.num_rows]), pa.array([low.tolist()], kind), pa.array([high.tolist()], kind)], ["chunk", "n", "low", "high"])

    known = materialise(dealt.groupBy("chunk").applyInArrow(bounds, "chunk long, n long, low array<double>, high array<double>"), "bounds")
    blocks = max(1, -(-known.count() // COMPARED))
    each = known.withColumn("blk", F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.select("chunk", "n", "low", "high", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        for _, same in part.groupby(part["chunk"] // (1 << 40)):
            chunk, n, blk = same["chunk"].to_numpy(), same["n"].to_numpy(), same["blk"].to_numpy()
            low, high = np.stack(same["low"].to_numpy()), np.stack(same["high"].to_numpy())
            others = np.flatnonzero(blk == hi)
            for i in np.flatnonzero(blk == lo):
                js = others[chunk[others] >= chunk[i]] if lo == hi else others
                if not len(js):
                    continue
                least, most = np.zeros(len(js)), np.full(len(js), np.pi)
                if low.shape[1]:
                    least = np.maximum(low[i] - high[js], low[js] - high[i]).max(1)
                    most = (high[i] + high[js]).min(1)
                full, self_ = most <= narrow, js == i
                load = np.where(self_, n[i] * (n[i] - 1) // 2, n[i] * n[js])
                keep = ~(least > wide) & (load > 0)
                a, b = np.minimum(chunk[i], chunk[js]), np.maximum(chunk[i], chunk[js])
                out.append(pd.DataFrame({"a": a[keep], "b": b[keep], "full": full[keep], "load": load[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "full": [], "load": []})

    pairs = materialise(each.groupBy("lo", "hi").applyInPandas(compare, "a long, b long, full boolean, load long"), "chunk-pairs")
    n = F.coalesce(F.sum("n"), F.lit(0))
    return _Chunks(dealt, pairs, known.agg(F.floor(n * (n - 1) / 2).cast("long").alias("pairs")), id_kind, chunk_rows)


def _multiplied(chunks: _Chunks, pairs: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(a, b, cosine) of the rows of these pairs of chunks at or over the threshold, both as ``kind``."""
    ids_kind = to_arrow_type(chunks.id_kind)
    most = pairs.agg(F.max("b")).first()[0] or 0
    together = max(1, min(TILE_CHUNKS, TILE_NUMBERS // (chunks.chunk_rows * max(1, most >> 40))))
    named = pairs.select(F.explode(F.array("a", "b")).alias("chunk")).distinct()
    tile = F.floor((F.row_number().over(Window.orderBy("chunk")) - 1) / together)  # a row for each chunk
    tiles = materialise(named.select("chunk", tile.alias("tile")), "tiles")
    tiled = pairs.join(tiles.select(F.col("chunk").alias("a"), F.col("tile").alias("ta")), "a").join(tiles.select(F.col("chunk").alias("b"), F.col("tile").alias("tb")), "b")
    sides = tiled.select("ta", "tb", F.col("a").alias("chunk"), F.col("b").alias("other")).union(tiled.select("ta", "tb", "b", F.lit(None)))
    sides = sides.groupBy("ta", "tb", "chunk").agg(F.collect_set("other").alias("others")).join(chunks.rows, "chunk")

    def meet(held):
        part = pa.Table.from_batches(held)
        chunk, all_ids = part["chunk"].to_numpy(), part["id"].to_numpy()
        names, begins = np.unique(chunk, return_index=True)
        ends = [*begins[1:], len(chunk)]
        x, ids, others = {}, {}, {}
        for c, begin, end in zip(names.tolist(), begins, ends, strict=True):
            x[c], ids[c] = _units(part["embedding"].slice(begin, end - begin).combine_chunks(), c >> 40), all_ids[begin:end]
            others[c] = part["others"][int(begin)].as_py()
        for first in x:
            for last in others[first]:
                for k in range(0, len(x[first]), 512):
                    s = x[first][k : k + 512] @ x[last].T
                    i, j = np.nonzero(s >= threshold - _MARGIN)
                    a, b, v = ids[first][k + i], ids[last][j], s[i, j]
                    if first == last:
                        keep = a < b
                        a, b, v = a[keep], b[keep], v[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b), ids_kind), pa.array(np.where(a < b, b, a), ids_kind), pa.array(v)], ["a", "b", "cosine"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            ta, tb = batch.column("ta").to_numpy(), batch.column("tb").to_numpy()
            cuts = (np.flatnonzero((np.diff(ta) != 0) | (np.diff(tb) != 0)) + 1).tolist()
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if (ta[begin], tb[begin]) != key:
                    if held:
                        yield from meet(held)
                    key, held = (ta[begin], tb[begin]), []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from meet(held)

    dealt = sides.select("ta", "tb", "chunk", "others", "id", "embedding").repartition("ta", "tb").sortWithinPartitions("ta", "tb", "chunk")
    found = dealt.mapInArrow(run, f"a {chunks.id_kind.simpleString()}, b {chunks.id_kind.simpleString()}, cosine double")
    return found.where(F.col("cosine").cast(kind) >= F.lit(threshold).cast(kind))


def cosine_pairs(rows: DataFrame, threshold: float, chunk_rows: int = CHUNK_ROWS, pivots: int | None = None, kind: str = "float") -> DataFrame:
    """``(a, b, cosine)`` with a < b for all pairs of ``rows(id, embedding)`` whose cosine is ``threshold`` or more, compared as ``kind`` (``float`` or ``double``). Ids are unique.

    Null, empty and zero vectors, those with non-finite numbers, and vectors of different lengths have no pairs. The result is as large as the pairs are many; :func:`cosine_links` writes dense groups shorter.
    """
    chunks = _chunked(rows, threshold, chunk_rows, pivots)
    return _multiplied(chunks, chunks.pairs, threshold, kind)


def cosine_links(rows: DataFrame, threshold: float, chunk_rows: int = CHUNK_ROWS, pivots: int | None = None, kind: str = "float") -> Links:
    """The pairs of :func:`cosine_pairs`, with those of chunks near enough throughout as one row for each two chunks (see :class:`Links`).

    A group of n rows within a fourth of the threshold's angle around a pivot takes at most ``(n / chunk_rows)^2`` rows instead of ``n^2 / 2``.
    """
    chunks = _chunked(rows, threshold, chunk_rows, pivots)
    full = chunks.pairs.where("full").select("a", "b")
    named = full.select(F.explode(F.array("a", "b")).alias("chunk")).distinct()
    members = chunks.rows.select("id", "chunk").join(named, "chunk", "left_semi")
    load = lambda c: F.coalesce(F.sum(F.when(c, F.col("load"))), F.lit(0))
    report = chunks.total.crossJoin(chunks.pairs.agg(load(~F.col("full")).alias("computed"), load(F.col("full")).alias("given")))  # one row each
    return Links(_multiplied(chunks, chunks.pairs.where("not full"), threshold, kind), members, full, report)


def link_counts(links: Links) -> DataFrame:
    """``(id, links)``: how many rows each row is linked with; rows without links don't come. Chunks hand on their sizes, so the work is that of the shorter form."""
    one = links.pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    sizes = links.members.groupBy("chunk").agg(F.count("*").alias("n"))
    ways = links.full.union(links.full.where("a <> b").select("b", "a")).join(sizes.withColumnRenamed("chunk", "b"), "b")
    # a row isn't its own link
    given = ways.groupBy(F.col("a").alias("chunk")).agg((F.sum("n") - F.count_if(F.col("a") == F.col("b"))).alias("links"))
    both = one.unionByName(links.members.join(given, "chunk").select("id", "links"))
    return both.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")
