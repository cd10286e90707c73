"""Benchmark passages in training texts, by spaced-seed hashing.

A mask such as ``1101011`` hashes the words at its ones and ignores the others, so a hit survives substituted words at the zeros. Hashes of all positions of the test items are a table; those of the training texts
are looked up in a Bloom filter of it where the texts lie, and what passes is joined with the table. A hit fixes how item and text lie against each other; around it words are compared one by one, and
the best local stretch must be long enough and equal enough. Texts don't move but for those with hits, and of these only the words around the hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.batches import map_texts
from strataspark.llm.names import unused
from strataspark.llm.words import LETTERS_ONLY, Words, chunks, mix
from strataspark.scratch import materialise

#: Masks by the words of an item (from, up to). Each family hits every overlap that :func:`contaminated` promises, wherever its substituted words are; the tests
#: go through all of them. Lengths up to 23 are enough: of a longer overlap one half is an overlap too, as both have 12 words and not both can have less than the whole's share of equal ones.
FAMILIES = (
    (5, 6, ("1111", "11011", "10111", "11101")),
    (7, 9, ("11111", "110111", "111011")),
    (10, 11, ("1111011", "11001111", "110110011", "11110101", "10101111")),
    (12, 2**31, ("1111011", "110010111", "1110100011", "1011111")),
)
MASKS = tuple((low, high, mask) for low, high, masks in FAMILIES for mask in masks)
#: Words that an item needs to be looked for within texts; shorter ones are compared with whole texts. An overlap's words, and its share of equal ones.
MIN_WORDS, MIN_STRETCH, MIN_EQUAL = 5, 12, 0.8
#: Bits of the filter for each seed and probes of it (one in 60,000 other positions passes), and the logarithm of its bits at most: 128 MB, enough for 8 million words of test items. More of them take more passes.
SEED_BITS, PROBES, MAX_FILTER = 32, 8, 30
#: Cells of the comparison matrix that are worked on at once.
CELLS = 1 << 20
_SALT = mix(np.arange(1, 65, dtype=np.uint64))


def _masked(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Seed hashes at every position where the mask fits."""
    k = max(0, len(h) - len(mask) + 1)
    out = np.full(k, _SALT[salt], np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + k]
    return mix(out)


def _probe(h: np.ndarray, k: int, log_bits: int) -> np.ndarray:
    """The bit that a hash has in the filter by probe ``k``."""
    return ((mix(h + np.uint64(k)) if k else h) >> np.uint64(64 - log_bits)).astype(np.int64)


def _items(batches):
    """(id, size, words, seeds) of the test items: seeds are (hash, place)."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
    for batch in batches:
        words, seeds = [], []
        for i, j, w in chunks(batch.column(1), space=LETTERS_ONLY):
            for t in range(j - i):
                own = w.hashes[w.first[t] : w.first[t + 1]]
                words.append(own.astype(np.int64))
                tables = [_masked(own, mask, m) for m, (low, high, mask) in enumerate(MASKS) if low <= len(own) <= high]
                seeds.append([{"h": h, "at": at} for table in tables for at, h in enumerate(table.astype(np.int64).tolist())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in words], pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, kind)], ["item", "size", "words", "seeds"])


def _filter(seeds: DataFrame, log_bits: int) -> np.ndarray:
    """The Bloom filter of a table of seeds, as bytes; built by Spark in buckets, of a size that ``log_bits`` fixes."""

    def bits(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_probe(h, k, log_bits) for k in range(PROBES)])) + 1)], ["bit"])

    made = seeds.select("h").mapInArrow(bits, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for row in made.collect():
        part = np.frombuffer(row.bits, np.uint8)
        at = (row.bucket - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _hits(w: Words, table: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, and seed hashes there, that the filter lets pass."""
    places, hashes = [], []
    of = w.text_of_word()
    for m, (_, _, mask) in enumerate(MASKS):
        h = _masked(w.hashes, mask, m)
        at = np.arange(len(h))
        for k in range(PROBES):
            bit = _probe(h[at], k, log_bits)
            at = at[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        at = at[at + len(mask) <= w.first[of[at] + 1]] if len(at) else at
        places.append(at)
        hashes.append(h[at])
    place, h = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    return place[order], h[order]


def _stretches(equal: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words, begin, end, equal words) for each row of ``equal``: the longest stretch within [low, high) with MIN_EQUAL of its words equal, the first of equals: its length, then what is left of it without other words at its ends."""
    n, k = equal.shape
    cost = round(MIN_EQUAL / (1 - MIN_EQUAL))
    at = np.arange(k + 1)
    inside = (at[:-1] >= low[:, None]) & (at[:-1] < high[:, None])
    equal = equal & inside
    total = np.zeros((n, k + 1), np.int64)
    np.cumsum(np.where(equal, 1, -cost) * inside, axis=1, out=total[:, 1:])
    least = -(cost + 1) * (k + 1)
    ends = np.where(at[None, :] > high[:, None], least, total)
    top = np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]  # the best total from here on
    # -top ascends within a row; rows are set apart, so that one search finds the last end of every begin
    apart = np.arange(n)[:, None] * (3 * (cost + 2) * (k + 1))
    last = np.searchsorted((apart - top).ravel(), (apart - total).ravel(), "right").reshape(n, k + 1) - 1 - np.arange(n)[:, None] * (k + 1)
    length = np.where((at >= low[:, None]) & (at <= high[:, None]), last - at, 0)
    begin = np.argmax(length, axis=1)
    size = length[np.arange(n), begin]
    own = equal & (at[:-1] >= begin[:, None]) & (at[:-1] < (begin + size)[:, None])
    count = own.sum(1)
    first, final = np.argmax(own, axis=1), k - np.argmax(own[:, ::-1], axis=1)
    return np.where(count > 0, size, 0), first, final, count


def _verify(batches):
    """The best overlap of each (text, item): rows (..., base, part, lies, words) to (..., equal_words, start_word, end_word). ``part`` are the text's words from ``base`` on, lies say where the item's first word lies."""
    for batch in batches:
        keep, best = [], []
        base, lies = batch.column("base").to_pylist(), batch.column("lies")
        for r in range(len(batch)):
            part, item = (np.asarray(batch.column(c)[r].values) for c in ("part", "words"))
            lie, k = np.unique(np.asarray(lies[r].values)) - base[r], len(item)
            step, top = max(1, CELLS // k), None
            for c in range(0, len(lie), step):
                some = lie[c : c + step]
                low, high = np.maximum(0, -some), np.minimum(k, len(part) - some)
                at = np.clip(some[:, None] + np.arange(k), 0, len(part) - 1)
                size, begin, end, equal = _stretches(part[at] == item, low, high)
                ok = np.flatnonzero(size >= min(k, MIN_STRETCH))
                if len(ok):
                    i = ok[np.lexsort((-(some + end)[ok], (some + begin)[ok], -equal[ok]))[0]]
                    mine = (int(equal[i]), -int(base[r] + some[i] + begin[i]), int(base[r] + some[i] + end[i]))
                    top = mine if top is None else max(top, mine)
            if top is not None:
                keep.append(r)
                best.append((top[0], -top[1], top[2]))
        out = batch.select(["t1", "t2", "item"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array([b[i] for b in best], pa.int32()) for i in range(3))], ["t1", "t2", "item", "equal_words", "start_word", "end_word"])


def _pass(texts: DataFrame, items: DataFrame, seeds: DataFrame, count: int, short: DataFrame | None = None) -> DataFrame:
    """The overlaps of the texts (t1, t2, text) with the items of one pass; with those of ``short``, which have too few words for a seed, texts of just these words."""
    log_bits = min(MAX_FILTER, max(20, int(np.ceil(np.log2(count * SEED_BITS)))))
    table = _filter(seeds, log_bits)
    hit = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
    whole = short is not None

    def scan(batches):
        for batch in batches:
            rows, words, hits = [], [], []
            for i, j, w in chunks(batch.column(2), space=LETTERS_ONLY):
                place, h = _hits(w, table, log_bits)
                cut = np.searchsorted(place, w.first)
                size = np.diff(w.first)
                for t in np.flatnonzero((np.diff(cut) > 0) | (whole & (size > 0) & (size < MIN_WORDS))).tolist():
                    rows.append(i + t)
                    words.append(w.hashes[w.first[t] : w.first[t + 1]].astype(np.int64))
                    own = slice(cut[t], cut[t + 1])
                    hits.append([{"h": a, "pos": b} for a, b in zip(h[own].astype(np.int64).tolist(), (place[own] - w.first[t]).tolist(), strict=True)])
            out = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(words, pa.list_(pa.int64())), pa.array(hits, hit)], ["t1", "t2", "words", "hits"])

    found = materialise(map_texts(texts, scan, "t1 long, t2 long, words array<long>, hits array<struct<h: long, pos: int>>"), "hits")
    met = found.select("t1", "t2", F.explode("hits").alias("x")).select("t1", "t2", "x.h", "x.pos").join(seeds, "h")
    # what is found depends on the text alone: copies of one are verified once
    lies = materialise(met.groupBy("t1", "t2", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("lies")), "lies")
    once = found.select("t1", "t2", "words").join(lies.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("words").alias("text_words"))
    both = lies.join(once, ["t1", "t2"]).join(items, "item")
    base = F.greatest(F.lit(0), F.array_min("lies"))
    part = F.slice("text_words", base + 1, F.array_max("lies") + F.col("size") - base)
    both = both.select("t1", "t2", "item", base.cast("int").alias("base"), part.alias("part"), "lies", "words")
    long = map_texts(both, _verify, "t1 long, t2 long, item string, equal_words int, start_word int, end_word int")
    if not whole:
        return long
    few = found.where(F.size("words") < MIN_WORDS).select("t1", "t2", "words").distinct().join(short.select("item", "words"), "words")
    return long.unionByName(few.select("t1", "t2", "item", F.size("words").alias("equal_words"), F.lit(0).alias("start_word"), F.size("words").alias("end_word")))


def overlaps(texts: DataFrame, benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(t1, t2, item_id, equal_words, start_word, end_word)`` for texts ``(t1, t2, text)``, where t1 and t2 are two hashes of the text; see :func:`contaminated`."""
    rows = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    # items of an id can have several texts
    rows = rows.select(F.concat_ws(":", "id", F.xxhash64("text")).alias("item"), "text")
    made = materialise(map_texts(rows, _items, "item string, size int, words array<long>, seeds array<struct<h: long, at: int>>").where("size > 0"), "items")
    short, made = made.where(F.col("size") < MIN_WORDS), made.where(F.col("size") >= MIN_WORDS)
    short = None if short.isEmpty() else short
    count = made.agg(F.sum(F.size("seeds"))).first()[0] or 0
    passes = max(1, -(-count * SEED_BITS // (1 << MAX_FILTER)))
    out = []
    for k in range(passes):
        own = made if passes == 1 else made.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        seeds = own.select("item", F.explode("seeds").alias("x")).select("item", "x.h", "x.at")
        out.append(materialise(_pass(texts, own.select("item", "size", "words"), seeds, max(1, count // passes), None if k else short), "overlaps"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.withColumn("item", F.substring_index("item", ":", 1).cast("long"))


def _hashed(text_col: str) -> tuple:
    text = F.col(text_col).cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(id_col, item_id_col, equal_words, start_word, end_word)`` for every document and test item that overlap.

    Words are runs of letters and digits, A-Z lower-cased. An overlap is a stretch of at least ``MIN_STRETCH`` words (of the whole item, if that is shorter) in which
    ``MIN_EQUAL`` of the words are equal; of an item's the one with most equal words is reported, the first of equals, without unequal words at its ends. An item of fewer than ``MIN_WORDS`` words, which common speech would hold,
    is matched by texts of exactly its words. Items without words, null items and null ids match nothing; null and empty texts hold nothing. A pair of ids comes back once, however often rows of docs or of the benchmark repeat them. Other columns are ignored.
    """
    t1, t2 = _hashed("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").withColumns({"t1": t1, "t2": t2})
    found = overlaps(rows.select("t1", "t2", "text"), benchmark, item_id_col, item_text_col)
    best = F.max(F.struct("equal_words", (-F.col("start_word")).alias("s"), "end_word")).alias("b")
    out = rows.select("id", "t1", "t2").join(found, ["t1", "t2"]).groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), F.col("b.equal_words").alias("equal_words"), (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a test item (see :func:`contaminated`); all columns stay, whatever their names, and rows with null ids or texts."""
    t1, t2 = _hashed(text_col)
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    a, b = unused(docs.columns, "t1", "t2")
    gone = overlaps(texts, benchmark, item_id_col, item_text_col).select(F.col("t1").alias(a), F.col("t2").alias(b)).distinct()
    return docs.join(gone, (t1 == F.col(a)) & (t2 == F.col(b)), "left_anti")
