"""Exact nearest-neighbour joins of tables, without the full product.

Some vectors, picked by a hash of their id, are pivots; every vector belongs to the cell of its nearest one. A cell is cut into chunks of bounded bytes by the distance to its pivot, so a chunk is a ring. By the
triangle inequality nothing in a ring of distances [a, b] lies nearer to q than ``max(a - d(q, pivot), d(q, pivot) - b)``, and, as the members are nearer to their pivot p than to the query's own h, nothing nearer than
``(d(q, p)^2 - d(q, h)^2) / (2 d(p, h))``. Each query is first compared with the chunk around it; the k-th distance found is its reach, and then it goes only to chunks that can hold something within that reach.

Queries meet a chunk in blocks of bounded size, so a chunk that all queries need takes many tasks. Only the pivots are broadcast, at most ``PIVOTS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataspark.operators.scan import number_rows
from strataspark.scratch import materialise

#: Pivots at most, bytes of doubles in a chunk, queries that meet a chunk at once, and cells of a distance matrix worked on at once.
PIVOTS, CHUNK_BYTES, MEET, CELLS = 128, 1 << 18, 1024, 1 << 20


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column without nulls, all of ``size`` numbers, as rows of doubles; taken from the flat buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences (products would lose digits of small ones)."""
    out = np.empty((len(x), len(y)))
    step = max(1, CELLS // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - y[None]) ** 2).sum(2))
    return out


def _usable(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(name, v) of the vectors that take part: of ``size`` finite numbers."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.select(F.col(name), v.alias("v")).where((F.size("v") == size) & ~F.exists("v", bad))


def _k_best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each row, ties to the smaller id; columns come in the order of ids."""
    return np.argsort(dist, axis=1, kind="stable")[:, :k]


def knn_join_cells(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, pivots: int = PIVOTS, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(query_id, id, distance, rank)``: of each query the ``k`` nearest rows by Euclidean distance, exactly; ties to the smaller id. And a report of one row, ``(pairs, computed)``: pairs of
    queries and vectors, and those whose distance was computed.

    ``vectors(id, embedding)``, ``queries(query_id, embedding)``. Vectors that are null, of another length than the queries' longest, or hold null or non-finite numbers take no part. Ids repeat only with their vectors;
    ``exclude_self`` leaves out rows whose id is the query's.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    stored, asked = _usable(vectors, "id", size), _usable(queries, "query_id", size)
    id_kind, query_kind = stored.schema["id"].dataType, asked.schema["query_id"].dataType
    schema = f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, distance double"
    picked = stored.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], schema + ", rank int"), spark.createDataFrame([(0, 0)], "pairs long, computed long")
    centres = np.unique(matrix(picked["v"], size), axis=0)
    between = distances(centres, centres)

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(1), size), centres)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    placed = stored.mapInArrow(to_cell, f"id {id_kind.simpleString()}, v array<double>, cell int, d double")
    per_chunk = max(1, chunk_bytes // (8 * size))
    rings = number_rows(placed, ["cell"], ["d", "id"]).withColumn("ring", F.floor((F.col("pos") - 1) / per_chunk)).drop("pos")
    rings = materialise(rings, "rings")
    chunks = materialise(rings.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")), "chunks")

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each query with all pivots: its distance to them, and how near a cell's members can be for their lying on the pivot's side
        for batch in batches:
            q = matrix(batch.column(1), size)
            step = max(1, CELLS // len(centres))
            for i in range(0, len(q), step):
                d = distances(q[i : i + step], centres)
                home = d.argmin(1)
                apart = np.maximum(between[home], 1e-300)
                side = np.where(between[home] > 0, (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * apart), 0.0)
                m = len(d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, m), pa.array(home, pa.int32()), pa.array(list(d), pa.list_(pa.float64())), pa.array(list(side), pa.list_(pa.float64()))], ["query_id", "home", "dq", "side"]
                )

    near = asked.dropDuplicates(["query_id"]).mapInArrow(to_cells, f"query_id {query_kind.simpleString()}, home int, dq array<double>, side array<double>")
    near = materialise(near, "query-cells")
    gap = F.greatest(F.col("low") - F.col("dq"), F.col("dq") - F.col("high"), F.lit(0.0))
    own = near.select("query_id", F.col("home").alias("cell"), F.get("dq", F.col("home")).alias("dq")).join(chunks, "cell").withColumn("gap", gap)
    around = Window.partitionBy("query_id").orderBy("gap", "ring")
    # the rings around it, as few as hold k rows and one
    ahead = own.withColumn("_before", F.sum("n").over(around.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("_before", F.lit(0)) < k + 1).select("query_id", "cell", "ring", "n")
    ahead = materialise(ahead, "first-pairs")

    def best(pairs: DataFrame) -> DataFrame:
        load = pairs.groupBy("cell", "ring").agg(F.count("*").alias("_q")).select("cell", "ring", F.ceil(F.col("_q") / MEET).cast("int").alias("parts"))
        asks = pairs.join(load, ["cell", "ring"]).select("query_id", "cell", "ring", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")).join(asked.dropDuplicates(["query_id"]), "query_id")
        members = rings.join(load, ["cell", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "ring", "part", "id", "v")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.take(pa.compute.sort_indices(right["id"]))
            q, x = matrix(left["v"], size), matrix(right["v"], size)
            out = []
            step = max(1, CELLS // max(1, len(x)))
            for i in range(0, len(q), step):
                d = distances(q[i : i + step], x)
                names = left["query_id"].slice(i, len(d))
                if exclude_self:
                    same = np.array(names.to_pylist(), object)[:, None] == np.array(right["id"].to_pylist(), object)[None]
                    d[same] = np.inf
                top = _k_best(d, x, k)
                r, c = np.nonzero(np.take_along_axis(d, top, 1) < np.inf)
                out.append(pa.table([names.take(pa.array(r)), right["id"].take(pa.array(top[r, c])), pa.array(d[r, top[r, c]])], ["query_id", "id", "distance"]))
            if not out:
                return pa.table([pa.array([], to_arrow_type(query_kind)), pa.array([], to_arrow_type(id_kind)), pa.array([], pa.float64())], ["query_id", "id", "distance"])
            return pa.concat_tables(out)

        met = asks.groupBy("cell", "ring", "part").cogroup(members.groupBy("cell", "ring", "part")).applyInArrow(meet, schema)
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return met.dropDuplicates(["query_id", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialise(best(ahead), "first-nearest")
    reach = first.where(F.col("rank") == k).select("query_id", (F.col("distance") * (1 + 1e-9) + 1e-9).alias("reach"))
    open_ = near.join(reach, "query_id", "left").select("query_id", "reach", F.posexplode(F.arrays_zip("dq", "side")).alias("cell", "x")).where(F.col("reach").isNull() | (F.col("x.side") <= F.col("reach")))
    open_ = open_.select("query_id", "reach", "cell", F.col("x.dq").alias("dq")).join(chunks, "cell").where(F.col("reach").isNull() | (gap <= F.col("reach")))
    rest = materialise(open_.join(ahead.select("query_id", "cell", "ring"), ["query_id", "cell", "ring"], "left_anti").select("query_id", "cell", "ring", "n"), "open-pairs")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    out = first.drop("rank").unionByName(best(rest).drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    computed = ahead.select("n").unionByName(rest.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("computed"))
    pairs = chunks.agg(F.sum("n").alias("_n")).crossJoin(near.agg(F.count("*").alias("_q"))).select((F.col("_n") * F.col("_q")).alias("pairs"))
    return out, pairs.crossJoin(computed)  # one row each
