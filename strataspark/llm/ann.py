"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in every shard.

Vectors that are equal are one node, with as many of their smallest ids as a result can hold. Nodes are dealt to shards by a hash of the vector; shards grow with the root of the number of nodes, so that the lists that are merged (queries times
shards) grow less than with its square; each shard builds its graph in one task: a greedy search from
the centre proposes neighbours for every new node, and relaxed distance pruning keeps those that no kept neighbour is much closer to, so that edges stay few and diverse. The largest inner product becomes the least
distance by one more coordinate that gives all nodes of a shard the same length. Queries go to every shard, whose task opens it once and lets them stream past: the index is moved once, however many queries there are. A beam search
visits the graph, the nodes found are scored in double precision on the original vectors, and the shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.scratch import materialise

#: Nodes of a shard at least and at most (about: between them 17 times the root of all) and bytes of its vectors at most, edges of a node, beam when building and when searching, pruning slack.
SHARD_NODES, MAX_SHARD_NODES, MAX_SHARD_BYTES, DEGREE, BUILD_BEAM, SEARCH_BEAM, SLACK = 4096, 1 << 20, 64 << 20, 32, 64, 128, 1.2
_ROOTS = 17
_STEP = 4


def _beam(x, norms, graph, queries, starts, width, lengths=True):
    """Ids and distances (n, width) of a beam search for each query, nearest first; -1 where fewer are reached. Without ``lengths`` the distance is minus the inner product."""
    n, count = len(queries), len(x)
    width = min(width, count)
    seen = np.zeros((n, count + 1), bool)
    seen[:, count] = True

    def distance(ids):
        dots = np.einsum("bkd,bd->bk", x[ids], queries)
        return norms[ids] - 2 * dots if lengths else -dots

    rows = np.arange(n)[:, None]
    ids = np.broadcast_to(starts, (n, len(starts))).copy()
    dist = distance(ids)
    seen[rows, ids] = True
    pad = max(0, width - ids.shape[1])
    ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=count)
    dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    open_ = dist < np.inf
    while True:
        best = np.argsort(np.where(open_, dist, np.inf), axis=1)[:, :_STEP]
        take = np.take_along_axis(open_ & (dist < np.inf), best, 1)
        act = np.flatnonzero(take.any(1))
        if not len(act):
            break
        np.put_along_axis(open_, best, False, 1)
        from_ = np.where(take[act], np.take_along_axis(ids[act], best[act], 1), count)
        near = np.sort(graph[from_].reshape(len(act), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = count
        near[seen[act[:, None], near]] = count
        seen[act[:, None], near] = True
        fresh = near != count
        keep = max(1, int(fresh.sum(1).max()))
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :keep]
        near = np.take_along_axis(near, order, 1)
        safe = np.where(near == count, 0, near)
        dots = np.einsum("bkd,bd->bk", x[safe], queries[act])
        d = np.where(near == count, np.inf, norms[safe] - 2 * dots if lengths else -dots)
        all_ids, all_dist = np.concatenate([ids[act], near], 1), np.concatenate([dist[act], d], 1)
        all_open = np.concatenate([open_[act], near != count], 1)
        w = ids.shape[1]
        part = np.argpartition(all_dist, w - 1, axis=1)[:, :w] if all_dist.shape[1] > w else np.broadcast_to(np.arange(w), (len(act), w))
        ids[act], dist[act], open_[act] = (np.take_along_axis(a, part, 1) for a in (all_ids, all_dist, all_open))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _prune(x, norms, nodes, candidates, degree, slack):
    """Robust pruning: of each node's candidates (-1: none) at most ``degree``, nearest first; one goes if a kept one is closer to it by the slack than the node is."""
    count = len(x)
    bad = (candidates < 0) | (candidates >= count) | (candidates == nodes[:, None])
    c = np.where(bad, 0, candidates)
    c_sorted = np.sort(np.where(bad, count, candidates), axis=1)
    c_sorted[:, 1:][c_sorted[:, 1:] == c_sorted[:, :-1]] = count
    bad = c_sorted == count
    c = np.where(bad, 0, c_sorted)
    xc = x[c]
    d = norms[nodes][:, None] + norms[c] - 2 * np.einsum("bkd,bd->bk", xc, x[nodes])
    d = np.where(bad, np.inf, np.maximum(d, 0))
    between = norms[c][:, :, None] + norms[c][:, None, :] - 2 * (xc @ xc.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmin(d, axis=1)
        live = d[rows, best] < np.inf
        if not live.any():
            break
        out[live, k] = c[rows, best][live]
        near = slack * slack * between[rows, best] <= d
        d = np.where(near & live[:, None], np.inf, d)
        d[rows, best] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK) -> np.ndarray:
    """Out-edges (n, degree) of a shard's nodes, -1 where fewer; the nodes' first is where searches start."""
    n = len(vectors)
    length = np.einsum("nd,nd->n", vectors, vectors)
    x = np.concatenate([vectors, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], 1).astype(np.float32)
    norms = np.einsum("nd,nd->n", x, x)
    graph = np.full((n + 1, degree), n, np.int32)
    done, size = 1, 1
    while done < n:
        batch = np.arange(done, min(n, done + size))
        if done <= beam:
            found = np.broadcast_to(np.arange(done), (len(batch), done))
        else:
            # only nodes below ``done`` have edges yet, so only they are reached
            found, _ = _beam(x, norms, graph, x[batch], np.zeros(1, np.int64), beam)
        own = _prune(x, norms, batch, np.where(found >= n, -1, found), degree, slack)
        graph[batch] = np.where(own < 0, n, own)
        to, source = own[own >= 0], np.repeat(batch, (own >= 0).sum(1))
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (graph[node] < n).sum(1)
        fits = have + count <= degree
        slot = np.repeat(have, count) + np.arange(len(to)) - np.repeat(first, count)
        easy = np.repeat(fits, count)
        graph[to[easy], slot[easy]] = source[easy]
        full = np.flatnonzero(~fits)
        for some in np.array_split(full[np.argsort(count[full])], max(1, len(full) // 256)):
            if len(some):
                wide = np.full((len(some), degree + int(count[some].max())), -1, np.int64)
                wide[:, :degree] = np.where(graph[node[some]] == n, -1, graph[node[some]])
                for r, k in enumerate(some):
                    wide[r, degree : degree + count[k]] = source[first[k] : first[k] + count[k]]
                cut = _prune(x, norms, node[some], wide, degree, slack)
                graph[node[some]] = np.where(cut < 0, n, cut)
        done += len(batch)
        size = min(256, max(1, done // 2))
    return np.where(graph[:n] == n, -1, graph[:n]).astype(np.int32)


def _index(table: pa.Table) -> pa.Table:
    """The shard of one group as one row."""
    v = table.column("v").combine_chunks()
    dim = len(v[0])
    full = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    # the graph is built in single precision, on vectors of a size that can't overflow there
    x = (full / np.abs(full).max()).astype(np.float32)
    length = np.einsum("nd,nd->n", x, x)
    # searches start at the node that lies most centrally: it goes first, the others follow in a fixed random order
    order = np.random.Generator(np.random.PCG64(3)).permutation(np.lexsort((table.column("h1").to_numpy(),)))
    centre = int(np.argmax(x @ x.mean(0) - 0.5 * length))
    order = np.concatenate(([centre], order[order != centre]))
    x, full = x[order], full[order]
    ids = table.column("ids").combine_chunks().take(pa.array(order))
    graph = build_graph(x)
    row = {
        "shard": [table.column("shard")[0].as_py()], "dim": [dim], "nodes": [len(x)], "x": [full.tobytes()], "graph": [graph.tobytes()],
        "ids": [ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], "ends": [np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64).tobytes()],
    }
    return pa.table(row, schema=_INDEX_ARROW)


_INDEX = "shard long, dim int, nodes int, x binary, graph binary, ids binary, ends binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("nodes", pa.int32()), *((c, pa.binary()) for c in ("x", "graph", "ids", "ends"))])
_FOUND = "h1 long, h2 long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: (vec_id, v, h1, h2). Vectors of floats stay so, others become double."""
    kind = "array<float>" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where("vec_id is not null and v is not null")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(ok).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def build_index(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_nodes: int | None = None) -> DataFrame:
    """The index of all vectors for searches of ``k``: one row per shard with its vectors, edges and ids.

    A node keeps its ``k + 1`` smallest ids: others of equal vectors can't be among ``k`` results that exclude one row, as ties go to smaller ids. They are cut
    before the shuffle, so a vector that very many rows share costs no more than others. Null, zero and non-finite vectors are left out; vectors of different lengths go to different shards. Rows that repeat an id and its vector count once;
    an id with several vectors is found by each of them and comes back with the best. ``shard_nodes`` sets the size of shards.
    """
    rows = _nodes(vectors, id_col, vector_col)
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    nodes = materialise(ranked.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids")), "nodes")
    count, longest = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    size = shard_nodes or min(MAX_SHARD_NODES, max(1, MAX_SHARD_BYTES // (8 * (longest or 1))), max(SHARD_NODES, round(_ROOTS * count**0.5)))
    shards = max(1, -(-count // size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.size("v"), F.pmod("h1", F.lit(shards))), F.lit(2**62)))
    return materialise(dealt.groupBy("shard").applyInArrow(_index, _INDEX), "ann-index")


def _opened(batch: pa.RecordBatch) -> tuple:
    """The arrays of a shard's row."""
    row = {c: batch.column(c)[0].as_py() for c in ("nodes", "dim", "x", "graph", "ids", "ends")}
    n, dim = row["nodes"], row["dim"]
    full = np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * n * dim else np.float64).reshape(n, dim)
    graph = np.frombuffer(row["graph"], np.int32).reshape(n, -1)
    graph = np.concatenate([np.where(graph < 0, n, graph), np.full((1, graph.shape[1]), n, np.int32)])
    return full, (full / np.abs(full).max()).astype(np.float32), graph, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def _searched(shard: tuple, batch: pa.RecordBatch, k: int, beam: int) -> pa.RecordBatch:
    """The ``k + 1`` best of a shard for each query of a batch."""
    full, x, graph, ids, ends = shard
    n, dim = x.shape
    asked = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    q = (asked / np.abs(asked).max(1, keepdims=True)).astype(np.float32)
    starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
    found, _ = _beam(x, np.zeros(n, np.float32), graph, q, starts, max(beam, k + 1), lengths=False)
    r, c = np.nonzero(found < n)
    node = found[r, c]
    score = np.einsum("nd,nd->n", full[node].astype(np.float64), asked[r].astype(np.float64))
    many = np.diff(ends, prepend=0)[node]
    at = np.repeat(ends[node] - np.cumsum(many), many) + np.arange(many.sum())
    r, score, own = np.repeat(r, many), np.repeat(score, many), ids[at]
    order = np.lexsort((own, -score, r))
    r, score, own = r[order], score[order], own[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) <= k
    h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
    return pa.RecordBatch.from_arrays([pa.array(a) for a in (h1[r[top]], h2[r[top]], own[top], score[top])], schema=_FOUND_ARROW)


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query its ``k`` nearest found, without the row of its own id.

    Nearest means the largest inner product, in double precision, ties to the smaller id. Equal queries are searched once. Queries that are null, zero or not finite have no rows; fewer candidates give fewer rows.
    """
    asked = _nodes(queries, id_col, vector_col)
    once = materialise(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    kind = once.schema["v"].dataType

    def run(batches):
        row = shard = None
        for batch in batches:
            opens = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            for lo, hi in zip([0, *opens.tolist()], [*opens.tolist(), len(batch)], strict=True):
                if lo in opens and hi > lo:
                    row, shard, lo = batch.slice(lo, 1), None, lo + 1
                for i in range(lo, hi, 256):
                    shard = shard or _opened(row)
                    yield _searched(shard, batch.slice(i, min(256, hi - i)), k, beam)

    # of each shard the index comes first, then all queries of its length
    own = index.select("shard", F.lit(True).alias("first"), "dim", "nodes", "x", "graph", "ids", "ends", *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2")), F.lit(None).cast(kind).alias("v"))
    binary = lambda c: F.lit(None).cast("binary").alias(c)
    asks = once.join(index.select("shard", "dim"), "dim").select("shard", F.lit(False).alias("first"), "dim", F.lit(None).cast("int").alias("nodes"), *map(binary, ("x", "graph", "ids", "ends")), "h1", "h2", "v")
    placed = own.unionByName(asks).repartition("shard").sortWithinPartitions("shard", F.col("first").desc())
    found = placed.mapInArrow(run, _FOUND)
    nearest = Window.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id")
    merged = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).drop("place")
    each = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(merged, ["h1", "h2"]).where("query_id <> vec_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
