"""Near-duplicate documents by b-bit MinHash.

Plan. One pass over the texts makes, per document, the count of its distinct word shingles, a 128-bit fingerprint of the set, ``BANDS * ROWS`` band values and a packed signature of the low bits of all minima. Documents of equal
sets form a class, and only its smallest id goes on. Classes that share a band meet in a bucket. Within buckets nothing is compared pair by pair: members are compared with a pivot (first the smallest of all their buckets, then those that it has left apart), then those outside the largest component with
a few of its members. A candidate pair first needs an estimate near the threshold (from counted equal bits, corrected for chance collisions), then the exact similarity on full sets. Buckets whose members are all one
component are closed. Documents in buckets that are still open are joined on the rare ends of their sets, which every similar pair shares, so that no link is lost to the choice of pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.batches import map_texts
from strataspark.llm.components import connected_components
from strataspark.llm.names import unused
from strataspark.llm.words import chunks, mix, shingles
from strataspark.scratch import materialise

#: 42 bands of 6 rows: a pair of similarity 0.8 misses all bands with probability (1 - 0.8**6)**42 = 3e-6.
BANDS, ROWS, MINIMA, LOW_BITS = 42, 6, 256, 2
#: A pair at the threshold t is estimated below t - 0.16 (five standard deviations) with probability under 1e-6.
SLACK = 0.16
#: Pivots of a bucket in the second round, taken from its largest component; the first round has one.
PIVOTS = 8
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTOR = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_PER_LONG = 64 // LOW_BITS


def _minima(sets: np.ndarray) -> np.ndarray:
    """MINIMA minima of 32-bit permutations of the set's hashes."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(best, (_FACTOR[:, None] * low[None, i : i + 1024]).min(axis=1), out=best)
    return best


def _signatures(words: int):
    at_bit = np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for i, j, w in chunks(batch.column(1)):
                count, k1, k2, packed, bands = [], [], [], [], []
                runs, at = shingles(w, words)
                for t in range(j - i):
                    own = np.unique(runs[at[t] : at[t + 1]])
                    count.append(len(own))
                    k1.append(own.sum(dtype=np.uint64).astype(np.int64))
                    k2.append(mix(own ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64))
                    if not len(own):
                        packed.append(None)
                        bands.append(None)
                        continue
                    low = _minima(own)
                    # the factors are odd, so the last bits of a product say little: fold higher ones in
                    bits = ((low ^ (low >> np.uint32(15))) & np.uint32(2**LOW_BITS - 1)).astype(np.uint64).reshape(-1, _PER_LONG)
                    packed.append(np.bitwise_or.reduce(bits << at_bit, axis=1).astype(np.int64))
                    key = salt.copy()
                    for row in low[: BANDS * ROWS].reshape(BANDS, ROWS).T.astype(np.uint64):
                        key = mix(key + row)
                    bands.append(key.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n", "k1", "k2", "packed", "bands"],
                )

    return run


def _sets(words: int):
    """Shingle sets, chunk by chunk: those of a whole batch are several times its texts."""

    def run(batches):
        for batch in batches:
            for i, j, w in chunks(batch.column(1)):
                runs, at = shingles(w, words)
                own = [np.unique(runs[at[t] : at[t + 1]]).astype(np.int64) for t in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["id", "items"])

    return run


def _estimate():
    """The similarity that two packed signatures show: equal codes counted, chance collisions taken out."""
    equal = F.lit(0)
    low = F.lit(0x5555555555555555)
    for i in range(MINIMA // _PER_LONG):
        x = F.col("pa")[i].bitwiseXOR(F.col("pb")[i])
        equal = equal + F.lit(_PER_LONG) - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    chance = 2.0**-LOW_BITS
    return (equal / MINIMA - chance) / (1 - chance)


class _Confirm:
    """Links among candidate pairs: first by the estimate, then by the exact similarity on full sets."""

    def __init__(self, texts: DataFrame, packed: DataFrame, words: int, threshold: float):
        self.texts, self.packed, self.words, self.threshold, self.percent = texts, packed, words, threshold, round(threshold * 100)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
        one, other = (self.packed.select(F.col("id").alias(c), F.col("packed").alias(f"p{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        near = pairs.join(one, "a").join(other, "b")
        near = near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (_estimate() >= self.threshold - SLACK)).select("a", "b")
        near = materialise(near, "near")
        wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        sets = materialise(map_texts(self.texts.join(wanted, "id", "left_semi"), _sets(self.words), "id long, items array<long>"), "sets")
        shared = F.size(F.array_intersect("ia", "ib"))
        sure = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
        return materialise(sure.where(shared * 100 >= (F.size("ia") + F.size("ib") - shared) * self.percent).select("a", "b"), "links")


def _open_rows(rows: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """``(key, id, c)`` of the buckets of ``least`` members or more that are of several components."""
    named = rows.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    ends = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where(f"lo < hi and m >= {least}")
    return materialise(named.join(ends.select("key"), "key"), "open")


def _all_pairs(left: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, other)`` for all pairs of documents in open buckets that can be similar enough and aren't one component.

    Sets are ordered from rare to frequent items. Of two similar sets of size n, the first ``n - ceil(t * n) + 1`` items of either must meet (else too few items are left to be shared), so only those prefixes are joined.
    Documents that share a frequent passage and little else don't meet, however many they are.
    """
    ids = materialise(left.select("id", "c").distinct(), "open-ids")
    sets = map_texts(texts.join(ids.select("id"), "id", "left_semi"), _sets(words), "id long, items array<long>").dropDuplicates(["id"])
    items = materialise(sets.select("id", F.explode("items").alias("item")), "items")
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    ranked = items.join(often, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("s"))
    size = F.size("s")
    prefix = ranked.join(ids, "id").select("id", "c", size.alias("n"), F.posexplode(F.slice("s", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)).alias("pos", "x")).where("x.often > 1")
    prefix = materialise(prefix.select("id", "c", "n", (F.col("n") - F.col("pos")).alias("rest"), F.col("x.item").alias("item")), "prefixes")
    there = prefix.select("item", F.col("id").alias("other"), F.col("c").alias("oc"), F.col("n").alias("on"), F.col("rest").alias("orest"))
    # what two sets share lies behind their first common item: too little left behind it on either side rules a pair out
    enough = F.least("rest", "orest") * (100 + percent) >= (F.col("n") + F.col("on")) * percent
    return prefix.join(there, "item").where((F.col("c") < F.col("oc")) & enough).select("id", "other")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` once these links are added: only components that a new link touches are worked on."""
    of = labels.select(F.col("id").alias("x"), F.col("component_id").alias("cx"))
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("x")).join(of, "x", "left").select("a", "b", "x", F.coalesce("cx", "x").alias("c"))
    ends = materialise(ends, "ends")
    roots = connected_components(ends.groupBy("a", "b").agg(F.max("c").alias("hi"), F.min("c").alias("lo")).select(F.col("hi").alias("a"), F.col("lo").alias("b"))).select(F.col("id").alias("component_id"), F.col("component_id").alias("root"))
    ids = labels.select("id", "component_id").union(ends.where("x = c").select("x", "c")).distinct()
    return materialise(ids.join(roots, "component_id", "left").select("id", F.coalesce("root", "component_id").alias("component_id")), "labels")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8
) -> DataFrame:
    """One row per document: ``(id_col, n_shingles, component_id, kept)``.

    Documents whose shingle sets have a Jaccard similarity of ``threshold`` or more are linked; components are
    the transitive closure and carry their smallest id; ``kept`` marks that id's row. Null texts and texts without words have
    no shingles and are linked with nothing; a text of fewer than ``words`` words is one shingle. Rows that repeat an id count once: the
    id is the key. Ids are whole numbers, not null (rows with a null id are left out). Other columns are ignored, whatever they are called.
    """
    percent = round(threshold * 100)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    made = map_texts(texts, _signatures(words), "id long, n long, k1 long, k2 long, packed array<long>, bands array<long>")
    made = materialise(made, "signatures")
    full = made.where("n > 0")
    classes = materialise(full.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    # only the rows of buckets with two members or more are of use
    rows = materialise(rows.join(buckets, "key").select("key", "id", "pivot"), "buckets")
    packed = materialise(full.join(rows.select("id").distinct(), "id", "left_semi").select("id", "packed", "n"), "packed")
    confirm = _Confirm(texts, packed, words, threshold)
    # buckets of one group differ in their pivots: a member meets the smallest of its pivots, and others only where that hasn't linked them
    links = confirm(rows.where("pivot < id").groupBy("id").agg(F.min("pivot").alias("other")))
    labels = materialise(connected_components(links), "labels")
    left = _open_rows(rows, labels, 2)
    pivots = left.groupBy("key").agg(F.min(F.struct("id", "c")).alias("p"))
    labels = _merged(labels, confirm(left.join(pivots, "key").where("c <> p.c").select("id", F.col("p.id").alias("other"))))

    # buckets of two were compared in full with their pivot
    left = _open_rows(rows, labels, 3)
    sizes = left.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    left = left.join(sizes, "key")
    slot = left.where("c = main").withColumn("h", F.xxhash64("id")).groupBy("key", F.pmod("h", F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct("h", "id")).alias("p"))
    fresh = left.where("c <> main").join(slot.select("key", F.col("p.id").alias("other")), "key").select("id", "other")
    labels = _merged(labels, confirm(fresh))

    labels = _merged(labels, confirm(_all_pairs(_open_rows(rows, labels, 3), texts, words, percent)))
    named = made.select("id", "n", "k1", "k2").join(classes.drop("n"), ["k1", "k2"], "left")
    named = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    # an id met twice: its rows are one document with the smallest component of them
    out = named.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min(F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "rep"))).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that have a near-duplicate of smaller id in their component. Rows with null ids stay, and all rows of an id that stays."""
    (name,) = unused(docs.columns, "gone")
    gone = near_duplicates(docs, id_col, **how).where("not kept").select(F.col(id_col).alias(name))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
