"""Periodic runs of words within documents, by seeds that are extended along diagonals.

A run of smallest period q and length L >= max(SHORTEST, 3 q) has equal words q apart over L - q >= max(SHORTEST - q, 2 q) places. Periods fall into classes: up to 16 words, then from
each power of two to the next. In the class up to K every run guarantees an overlap of K words at least, so all K-grams of a document are indexed (by exact numbers, from doubling: a 2k-gram
is a pair of k-grams), and an occurrence is paired with the next one of the same K-gram if that lies at most K words on. The next one is enough: the lag to it is the smallest period
of the words from the first occurrence's start to the second one's end, and within a run of period q <= K two occurrences are a multiple of q apart, as they overlap in K >= q words. So
there are at most n pairs in a class, however often a gram repeats. A pair is extended along its diagonal in doubling steps; per lag a table holds how far diagonals are covered, and pairs that start in what
is covered are passed over.

All this is per document, in the task that holds it: no shuffle, and memory in proportion to the longest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strataspark.llm.batches import map_texts

#: The contract's bounds of a run: words at least, periods at least, and periods up to which one class reaches (the overlap of 16 that any short run guarantees).
SHORTEST, TIMES, FIRST_CLASS = 24, 3, 16
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def _pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _extend(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on (step 1) or before it (step -1) have equal words ``lag`` apart."""
    done, size, n = 0, 64, len(words) - lag
    while True:
        lo, hi = (at + done, min(n, at + done + size)) if step > 0 else (max(0, at - done - size), at - done)
        if lo >= hi:
            return done
        differ = np.flatnonzero(words[lo:hi] != words[lo + lag : hi + lag])
        if len(differ):
            return done + (int(differ[0]) if step > 0 else hi - lo - 1 - int(differ[-1]))
        done, size = done + hi - lo, size * 2


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of word numbers, by start, then period."""
    n, runs = len(words), []
    grams, size = words, 1
    while size < FIRST_CLASS and len(grams) > size:
        grams, size = _pair_names(grams[:-size], grams[size:]), size * 2
    while size >= FIRST_CLASS and n >= max(SHORTEST, TIMES * (size // 2 + 1) if size > FIRST_CLASS else 0):
        order = np.argsort(grams, kind="stable")
        again = grams[order[:-1]] == grams[order[1:]]
        if not again.any():
            break
        at, lag = order[:-1][again], np.diff(order)[again]
        near = (lag <= size) & (lag > (size // 2 if size > FIRST_CLASS else 0))
        at, lag = at[near], lag[near]
        by = np.lexsort((at, lag))
        at, lag = at[by], lag[by]
        edges = np.flatnonzero(np.diff(lag, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q, k, covered = int(lag[lo]), lo, 0
            while k < hi:
                seed = int(at[k])
                first = seed - _extend(words, seed, q, -1)
                covered = seed + _extend(words, seed, q, 1)  # the diagonal has equal words up to here
                if covered - first + q >= max(SHORTEST, TIMES * q):
                    runs.append((first, covered - first + q, q))
                k = lo + int(np.searchsorted(at[lo:hi], covered))
        if len(grams) <= size:
            break
        grams, size = _pair_names(grams[:-size], grams[size:]), size * 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _runs_of(text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    words = _WORD.findall(text)
    if len(words) < SHORTEST:
        return words, []
    known: dict[str, int] = {}
    return words, find_runs(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words long``, ``runs array<struct<start, length, period>>`` (by start, then period) and ``collapsed``: the words joined by one space, without those that some run repeats.

    Words are as :data:`WORD` says, numbered from 0. A run is as long as it can be with its smallest period, and has :data:`SHORTEST` words and :data:`TIMES` periods at least. A word is
    left out of ``collapsed`` if a run contains it behind the run's first period. Null and empty texts have no words and no runs, and collapse to an empty text. Repeated rows stay. Columns of
    ``docs`` with one of these names are replaced, all others stay.
    """
    made = [StructField("n_words", LongType(), False), StructField("runs", ArrayType(RUN, False), False), StructField("collapsed", StringType(), False)]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {m.name for m in made}]
    schema = StructType([*kept, *made])
    run_type = pa.struct([pa.field(c, pa.int64(), False) for c in RUN.fieldNames()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, ends, texts = [], [], [0], []
            for text in batch.column(text_col):
                words, own = _runs_of(text.as_py() or "")
                counts.append(len(words))
                runs.extend(own)
                ends.append(len(runs))
                if own:
                    change = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in own:
                        change[start + period] += 1
                        change[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                texts.append(" ".join(words))
            table = np.array(runs, np.int64).reshape(-1, 3)
            found = pa.StructArray.from_arrays([pa.array(table[:, k].copy()) for k in range(3)], fields=list(run_type))
            made = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=schema.fieldNames())

    return map_texts(docs, run, schema)


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length over period, compared exactly (by cross products); of equal ones that of smallest start, then period. Null without runs."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start, then period, so an equal one stays behind
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(F.col(runs), 2, F.size(runs)), F.col(runs)[0], lambda best, x: F.when(better(x, best), x).otherwise(best)))
