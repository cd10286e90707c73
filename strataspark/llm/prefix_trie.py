"""A prefix trie of conversations, from extents in the sorted order.

Conversations are sorted as sequences of turn digests, and neighbours' longest common prefixes (LCPs) are taken. A prefix of d turns is an interval of that order: as far to the left and to the right
as no LCP is under d. Each candidate prefix searches both extents for itself, by binary search in a sparse table of range minima; nothing is kept on a stack, and what a node needs
(members, children, leaves, bytes) are range minima and differences of prefix sums.

The order is dealt by ranges over partitions. A partition knows the last conversation before it and the first behind it; prefixes that cross such a border (at most the LCP there) come out as
pieces, whose sums and minima add up by the digest of the prefix. So a common first turn, or a conversation that very many repeat, takes many tasks.

Only what conversations can share is sorted: from the first turn on that no other conversation has in this place, a conversation is a chain of its own, whose nodes come from its rows. So a
very long conversation is not gathered, but for the part that others may share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.operators.scan import PART, PLACE, number_rows, ranged
from strataspark.scratch import materialise

#: Shared turns to a partition of the sorted order; ids of a long list of members passed on at once.
PART_TURNS, CHUNK_IDS = 1 << 18, 4096
DIGEST_BYTES = 16
_OUT = "kind string, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string, part long, seq long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[c.split()[1]] for c in _OUT.split(", ")]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text; nulls count as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST_BYTES))


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, digest, n_bytes``: turns numbered from 1 within their conversation, by ``turn_col`` (null first), turns of one number by their digests. Repeated rows are repeated turns; rows without
    a conversation are left out. Other columns are ignored."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return number_rows(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"]).select("conv_id", "pos", "digest", "n_bytes")


class _Extents:
    """Range minima over an array, in a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of ``values[lo:hi]``, of at least one value each."""
        k = np.frexp(np.maximum(hi - lo, 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][lo[at]], self.levels[level][hi[at] - (1 << int(level))])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row r with no value of at + 1 ... r under ``depth``; value i lies between rows i - 1 and i, the first counts for none."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = at + 1 < len(level)
            ok[ok] = level[at[ok] + 1] >= depth[ok]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row l with no value of l + 1 ... at under ``depth``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, start = self.levels[k], at - (1 << k) + 1
            ok = start >= 1
            ok[ok] = level[start[ok]] >= depth[ok]
            at[ok] -= 1 << k
        return at


def _common(tokens: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens sequences a and b (numbers into ``first``) begin with in common."""
    size = np.minimum(first[a + 1] - first[a], first[b + 1] - first[b])
    out = size.copy()
    some = np.flatnonzero(size)
    if len(some):
        starts = np.cumsum(size[some]) - size[some]
        within = np.arange(size[some].sum()) - np.repeat(starts, size[some])
        equal = tokens[np.repeat(first[a[some]], size[some]) + within] == tokens[np.repeat(first[b[some]], size[some]) + within]
        out[some] = np.minimum(size[some], np.minimum.reduceat(np.where(equal, np.iinfo(np.int64).max, within), starts))
    return out


def _prefix_keys(digests: list[bytes]) -> list[bytes]:
    """A key for each prefix of a sequence, the empty one first."""
    state, out = hashlib.sha256(), []
    for d in [b"", *digests]:
        state.update(d)
        out.append(state.digest()[:DIGEST_BYTES])
    return out


def _part_of_trie(table: pa.Table) -> pa.Table:
    """Nodes of one range of the sorted order, with pieces of those that cross its borders (see the module's text)."""
    table = table.sort_by([("side", "ascending"), (PLACE, "ascending")]).combine_chunks()
    side, part = table["side"].to_numpy(), table[PART][0].as_py()
    lists = table["digests"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
    tokens = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = np.flatnonzero(side == 0)
    n, lo = len(rows), int(rows[0])
    conv, tail = table["conv_id"].to_numpy()[rows], table["tail"].to_numpy(zero_copy_only=False)[rows].astype(bool)
    size = np.diff(first)[rows]
    ids = np.arange(lo, lo + n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _common(tokens, first, ids[:-1], ids[1:])
    one = lambda a, b: int(_common(tokens, first, np.array([a]), np.array([b]))[0])
    before = one(lo - 1, lo) if lo else -1
    behind = one(lo + n - 1, lo + n) if len(side) > lo + n else -1
    lcp[0], lcp[n] = before, behind
    at = first[lo : lo + n] - first[lo]  # where each row's turns begin
    total = np.concatenate(([0], np.cumsum(np.nan_to_num(table["sizes"].combine_chunks().slice(lo, n).flatten().to_numpy(zero_copy_only=False)).astype(np.int64))))
    upto = lambda i, d: total[at[i] + d] - total[at[i]]  # noqa: E731  bytes of the first d turns of row i
    every = np.arange(n)
    own = upto(every, size)
    sums = np.concatenate(([0], np.cumsum(own)))
    fresh = own - upto(every, np.maximum(lcp[:n], 0))  # bytes of the nodes that begin with a row
    fresh_sums = np.concatenate(([0], np.cumsum(fresh)))
    leaf_sums = np.concatenate(([0], np.cumsum(tail | (lcp[1:] < size))))
    shared, least_conv = _Extents(lcp[:n]), _Extents(conv)
    branch = np.flatnonzero((size > lcp[:n]) | tail)
    branch = branch[branch > 0]
    branches = np.sort(lcp[branch] * (n + 1) + branch)
    repeat = np.zeros(n, bool)
    repeat[1:] = (lcp[1:n] == size[1:]) & (size[1:] == size[:-1]) & (tail[1:] == tail[:-1])
    starts = np.flatnonzero(~repeat)
    run_end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))

    # candidates: each row's prefixes that the row before it hasn't; of the first row all, the root among them
    low = np.where(every == 0, 0, lcp[:n] + 1)
    count = size - low + 1
    i = np.repeat(every, count)
    d = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[i]

    def around(i, d):
        return shared.left(i, d), shared.right(i, d)

    left, right = around(i, d)
    up_left, up_right = around(i, np.maximum(d - 1, 0))
    from_left, to_right = (left == 0) & (d <= before), (right == n - 1) & (d <= behind)
    up_cross = (d > 0) & (((up_left == 0) & (d - 1 <= before)) | ((up_right == n - 1) & (d - 1 <= behind)))
    above = np.maximum(d - 1, 0)
    members = right - left + 1
    saved = sums[right + 1] - sums[left] - members * upto(left, above)
    top = np.where(from_left, own[left] - upto(left, np.maximum(lcp[left], 0)), own[left] - upto(left, above))
    saved -= fresh_sums[right + 1] - fresh_sums[left + 1] + top
    key = lambda row: np.searchsorted(branches, d * (n + 1) + row, "right")
    opens = (size[left] > d) | tail[left]
    children = key(right) - key(left) + np.where(from_left, (lcp[left] == d) & opens, opens)
    leaves = leaf_sums[right + 1] - leaf_sums[left]
    least = least_conv.least(left, right + 1)
    up_least = least_conv.least(up_left, up_right + 1)
    ended = np.where((size[left] == d) & ~tail[left], np.minimum(run_end[left], right + 1) - left, 0)

    head = _prefix_keys(lists[lo].as_py()) if before >= 0 else []
    last = _prefix_keys(lists[lo + n - 1].as_py()) if behind >= 0 else []

    def key_of(crosses, at_left, depth):
        out = np.full(len(crosses), None, object)
        for k in np.flatnonzero(crosses):
            out[k] = (head if at_left[k] and depth[k] <= before else last)[depth[k]]
        return out

    crosses = from_left | to_right
    keys, up_keys = key_of(crosses, left == 0, d), key_of(up_cross, up_left == 0, d - 1)
    hashes = np.full(len(i), None, object)
    chunks = []
    for k in np.flatnonzero(ended):
        block = conv[left[k] : left[k] + ended[k]].tolist()
        if crosses[k]:
            chunks += [(keys[k], ",".join(map(str, block[j : j + CHUNK_IDS])), j) for j in range(0, len(block), CHUNK_IDS)]
        else:
            hashes[k] = hashlib.sha256(",".join(map(str, block)).encode()).hexdigest()
    hashes[~crosses & (ended == 0)] = _EMPTY_SHA
    kinds = np.where(crosses, "piece", "node")
    none = lambda m: [None] * m
    up_conv = [None if c or not x else int(v) for c, x, v in zip(up_cross, d, up_least, strict=True)]
    nodes = [kinds, keys, up_keys, d, least, up_conv, members, children, leaves, saved, hashes, none(len(i)), none(len(i)), none(len(i))]

    t = np.flatnonzero(tail)  # what a tail hangs on
    t_left, t_right = around(t, size[t])
    t_cross = ((t_left == 0) & (size[t] <= before)) | ((t_right == n - 1) & (size[t] <= behind))
    t_keys, t_least = key_of(t_cross, t_left == 0, size[t]), least_conv.least(t_left, t_right + 1)
    m = len(t)
    tails = [["tail"] * m, none(m), t_keys, size[t], conv[t], [None if c else int(v) for c, v in zip(t_cross, t_least, strict=True)], *(none(m) for _ in range(8))]
    m = len(chunks)
    lists_of_ids = [["ids"] * m, [c[0] for c in chunks], *(none(m) for _ in range(9)), [c[1] for c in chunks], [part] * m, [c[2] for c in chunks]]
    columns = [pa.chunked_array([pa.array(list(x), ty) for x in (a, b, c)]) for a, b, c, ty in zip(nodes, tails, lists_of_ids, _TYPES, strict=True)]
    return pa.table(columns, names=_NAMES)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash) of lists of ids that come in chunks, sorted; one chunk is held at a time."""
    key, state, done = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > CHUNK_IDS:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], ty) for j, ty in ((0, pa.binary()), (1, pa.string()))], names=["key", "sha"])
            done = []
    if state:
        done.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], ty) for j, ty in ((0, pa.binary()), (1, pa.string()))], names=["key", "sha"])


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations' turns, the empty one (the root, depth 0) among them.

    ``turns(conv_id, pos, digest, n_bytes)`` have each conversation's turns at 1, 2, ... without gaps; ``members(conv_id)`` names each conversation once, also those without turns. Result:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree, itself included), ``saved_tokens``
    (over the subtree: members beyond the first, times the bytes of the node's last text), ``ends_sha256`` (of the ids of members that end here, ascending, joined by commas). Turns that differ
    in anything have different digests; conversations that repeat each other share all nodes. Without members there are no rows.
    """
    turns = materialise(turns.select("conv_id", "pos", "digest", "n_bytes"), "turns")
    alone = turns.groupBy("pos", "digest").agg(F.count("*").alias("_n"), F.min("conv_id").alias("conv_id")).where("_n = 1").groupBy("conv_id").agg(F.min("pos").alias("_first"))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("size"))
    info = members.select("conv_id").join(sizes, "conv_id", "left").join(alone, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("_first") - 1, "size", F.lit(0)).alias("shared"))
    info = materialise(info, "conversations")
    shared = turns.join(info.where("shared > 0"), "conv_id").where("pos <= shared")
    listed = shared.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("_t"))
    row = info.join(listed, "conv_id", "left").select(
        "conv_id", (F.col("size") > F.col("shared")).alias("tail"), F.coalesce(F.transform("_t", lambda x: x["digest"]), F.array().cast("array<binary>")).alias("digests"), F.coalesce(F.transform("_t", lambda x: x["n_bytes"]), F.array().cast("array<long>")).alias("sizes")
    )
    wanted = info.agg(F.sum(F.col("shared") + 1)).first()[0] or 0
    rows = ranged(row, [], ["digests", "tail", "conv_id"], max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wanted // PART_TURNS)))
    # halos: each range also gets the last sequence before it and the first behind it; a row a range
    ends = rows.groupBy(PART).agg(F.min_by("digests", PLACE).alias("_low"), F.max_by("digests", PLACE).alias("_high"))
    order = Window.orderBy(PART)
    near = rows.groupBy(PART).agg(F.lit(1)).select(PART, F.lag(PART).over(order).alias("_prev"), F.lead(PART).over(order).alias("_next"))
    low = near.join(ends.select(F.col(PART).alias("_prev"), F.col("_high").alias("digests")), "_prev").select(PART, F.lit(-1).alias("side"), "digests")
    high = near.join(ends.select(F.col(PART).alias("_next"), F.col("_low").alias("digests")), "_next").select(PART, F.lit(1).alias("side"), "digests")
    halos = low.unionByName(high).select(PART, "side", "digests", F.array().cast("array<long>").alias("sizes"), F.lit(0).cast("long").alias("conv_id"), F.lit(False).alias("tail"), F.lit(0).cast("long").alias(PLACE))
    dealt = rows.withColumn("side", F.lit(0)).select(halos.columns).unionByName(halos)
    out = materialise(dealt.groupBy(PART).applyInArrow(_part_of_trie, _OUT), "trie")

    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    pieces = out.where("kind = 'piece'").groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    ids = out.where("kind = 'ids'").select("key", "ids", "part", "seq").repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids")
    crossing = materialise(pieces.join(ids.mapInArrow(_hash_lists, "key binary, sha string"), "key", "left"), "crossing")
    above = crossing.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    crossed = crossing.join(above, "parent_key", "left").select("conv_id", "depth", F.col("_up").alias("parent_conv_id"), *sums, F.coalesce("sha", F.lit(_EMPTY_SHA)).alias("ends_sha256"))

    def under(kind: str) -> DataFrame:
        own = out.where(F.col("kind") == kind)
        return own.where("parent_key is null").unionByName(own.drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("_up", "parent_conv_id"))

    tails = under("tail").select("conv_id", F.col("parent_conv_id").alias("_up"))
    chain = turns.join(info.where("size > shared").join(tails, "conv_id"), "conv_id").where("pos > shared")
    ends_here = F.col("pos") == F.col("size")
    long = lambda x: F.lit(x).cast("long")
    chain = chain.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("shared") + 1, F.col("_up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), long(1).alias("n_convs"),
        F.when(ends_here, long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(ends_here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )
    return under("node").select(columns).unionByName(crossed.select(columns)).unionByName(chain.select(columns))
