"""SentencePiece encoding and decoding by a streaming Viterbi search.

Every prefix of a text has one best last piece: for unigram models the one with the best summed score, for BPE models the only one that can follow
its predecessor (a pair of pieces is compatible if merging their text by priority gives the same two pieces; then a row of compatible pieces is what merging the whole text gives).
Backpointers are kept for a window of positions. When the paths of all positions that later pieces can still start from meet in one boundary, the ids
before it are committed and dropped, so memory is bounded by the longest piece and not by the text. Between two characters that no piece holds
side by side all paths meet anyway: the text is cut there, and short stretches between such cuts are remembered.

Only the vocabulary file is read; nothing of the library's own encoder is used.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from strataspark.llm.batches import map_texts
from strataspark.llm.words import _BYTE_ALL as _BYTE
from strataspark.llm.words import STEP, mix, powers, string_buffers

#: Fixed values of the file format: kinds of pieces, kinds of models, the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Stretches remembered per Python worker, and the longest of them.
REMEMBERED, SHORT = 300_000, 64
_POWER = powers(SHORT + 1)
_INVERSE = powers(SHORT + 1, np.uint64(pow(int(STEP), -1, 2**64)))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at):
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a model file, and how it treats spaces. ``path`` is read where this is made (the driver)."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.model, self.dummy_prefix, self.extra_spaces, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.dummy_prefix, self.extra_spaces = bool(own.get(3, 1)), not own.get(4, 1)
                charsmap = own.get(2, b"")
        if charsmap or not self.extra_spaces:
            raise ValueError("models that rewrite characters or drop spaces are not supported: their texts don't come back")
        if self.model not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.model} is neither unigram nor BPE")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        text = "".join(p + "\0" for p in self.ids)
        self.inner = {x for x in set(zip(text, text[1:], strict=False)) if "\0" not in x}
        self.spaced = all(b != MARK or a == MARK for a, b in self.inner)
        self.lines = not any("\n" in p for p in self.ids)
        order = sorted(set(self.scores), reverse=True)
        place = {s: i for i, s in enumerate(order)}
        self.rank = [place[s] for s in self.scores]
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


class Encoder:
    """The search itself, for one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        cut = "\n" if vocabulary.lines else ""
        self.stretch = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else "")) if vocabulary.spaced else None

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces that merge into piece i last; (-1, -1) for a single character, None if merging never makes it."""
        if i not in self.split:
            v, parts, last = self.v, list(self.v.pieces[i]), (-1, -1)
            while len(parts) > 1:
                merged = [v.ids.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                at = min((k for k, m in enumerate(merged) if m is not None), key=lambda k: (v.rank[merged[k]], k), default=None)
                if at is None:
                    break
                last = (v.ids.get(parts[at], -2), v.ids.get(parts[at + 1], -2))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[i] = last if len(parts) == 1 else None
        return self.split[i]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b, one after the other, stay apart: undo their merges, the latest first, and see whether a merge across the boundary would have come sooner."""
        if (a, b) in self.pair:
            return self.pair[a, b]
        v, x, y, limit, out = self.v, a, b, len(self.v.pieces) + 1, True
        while True:
            across = v.ids.get(v.pieces[x] + v.pieces[y])
            if across is not None and v.rank[across] < limit:
                out = False
                break
            hx, hy = self._halves(x), self._halves(y)
            leaf_x, leaf_y = hx[0] < 0, hy[0] < 0
            if leaf_x and leaf_y:
                break
            if leaf_y or (not leaf_x and v.rank[x] > v.rank[y]):
                limit, x = v.rank[x], hx[1]
            else:
                limit, y = v.rank[y] + 1, hy[0]
        self.pair[a, b] = out
        return out

    def _single(self, c: str) -> list[int]:
        """A character without a piece: its bytes, or the unknown piece."""
        return [self.v.bytes[b] for b in c.encode("utf-8", "replace")] if self.v.bytes else [self.v.unknown]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` (spaces already marked), in the order in which they are committed."""
        v, ids = self.v, self.v.ids
        bpe, longest, worst = v.model == BPE, v.longest, v.worst
        # per position of the window, from ``base``: last piece (-1: none, the character alone), its length, score up to here
        base, last, size, score = 0, [None], [0], [0.0]
        for end in range(1, len(text) + 1):
            best = None
            for n in range(1, min(longest, end - base) + 1):
                i = ids.get(text[end - n : end])
                at = end - n - base
                if i is None:
                    if n > 1 or (bpe and last[at] is None and at):
                        continue
                    i = -1
                before = last[at]
                if before is None and at:
                    continue
                if bpe:
                    if i >= 0 and (self._halves(i) is None or (before is not None and before >= 0 and not self._compatible(before, i))):
                        continue
                    best = (i, n, 0.0)
                    if i >= 0 and n > 1:
                        break
                else:
                    total = score[at] + (v.scores[i] if i >= 0 else worst)
                    if best is None or total > best[2]:
                        best = (i, n, total)
            last.append(best[0] if best else None)
            size.append(best[1] if best else 0)
            score.append(best[2] if best else 0.0)
            if end - base >= 4 * longest:
                # where the paths of all positions that a later piece can start from meet
                live = {k for k in range(end - base - longest + 1, end - base + 1) if last[k] is not None}
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(top - size[top])
                meet = live.pop()
                if meet > 0:
                    yield self._path(text, base, last, size, meet)
                    keep = last[meet]
                    base += meet
                    del last[:meet], size[:meet], score[:meet]
                    last[0], size[0] = keep, 0
        yield self._path(text, base, last, size, len(text) - base)

    def _path(self, text, base, last, size, at) -> list[int]:
        out = []
        while at > 0:
            out.append([last[at]] if last[at] >= 0 else self._single(text[base + at - 1]))
            at -= size[at]
        return [i for part in reversed(out) for i in part]

    def _ids(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            got = np.array([i for some in self.stream(part) for i in some], np.int32).tobytes()
            if len(part) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[part] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        marked = text.replace(" ", MARK)
        if self.v.dummy_prefix:
            marked = MARK + marked
        if self.stretch is None:
            return self._ids(marked)
        known, ids = self.known, self._ids
        return b"".join([known.get(p) or ids(p) for p in self.stretch.findall(marked)])


class BatchEncoder:
    """The same search for many short stretches at once: all of them advance one byte together.

    Stretches are the parts between sure cuts (before the first space of a run, around line ends); equal ones are sought once, by hash. Works on UTF-8 bytes with a
    space for the mark. Stretches of over SHORT bytes go through :meth:`Encoder.stream`, whose window is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.scalar = vocabulary, Encoder(vocabulary)
        raw = [(p.replace(MARK, " ").encode(), i) for p, i in vocabulary.ids.items()]
        self.longest = max((len(b) for b, _ in raw), default=1)
        by_hash = sorted((int(_hash_of(b)), i, len(b)) for b, i in raw)
        self.hashes = np.array([h for h, _, _ in by_hash], np.uint64)
        self.piece = np.array([i for _, i, _ in by_hash], np.int32)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.scores = np.array(vocabulary.scores, np.float64)
        # what is known of pairs, by a hash of 22 bits; a pair may push out another, which is then worked out again
        self.pairs, self.verdict = np.full(1 << 22, -1, np.int64), np.zeros(1 << 22, bool)
        self._forget()

    def _forget(self):
        self.seen, self.at, self.len, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """:meth:`Encoder._compatible` of many pairs."""
        key = before.astype(np.int64) << 32 | piece
        slot = (mix(key.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)
        out = self.verdict[slot]
        other = np.flatnonzero(self.pairs[slot] != key)
        if len(other):
            more, which = np.unique(key[other], return_inverse=True)
            fits = np.array([self.scalar._halves(k & 0xFFFFFFFF) is not None and self.scalar._compatible(k >> 32, k & 0xFFFFFFFF) for k in more.tolist()], bool)
            self.scalar.pair.clear()
            out[other] = fits[which]
            slot = (mix(more.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)
            self.pairs[slot], self.verdict[slot] = more, fits
            clash = self.pairs[slot] != more  # another pair took the slot
            self.pairs[slot[clash]] = -1
        return out

    def _search(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them for each stretch) for stretches of at most SHORT bytes."""
        n, width = len(start), int(size.max())
        cell = np.arange(width)
        inside = cell < size[:, None]
        text = np.where(inside, data[np.minimum(start[:, None] + cell, len(data) - 1)], 0)
        lead = inside & ((text & 0xC0) != 0x80)
        lead = np.concatenate([lead, np.zeros((n, 1), bool)], 1)
        lead[np.arange(n), size] = True  # a character ends where the next begins
        value = _BYTE[text] * _POWER[:width]
        total = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(value, axis=1, dtype=np.uint64)], 1)
        bpe = self.v.model == BPE
        # all pieces that occur anywhere: their length, row, end and id
        found = []
        for long in range(1, min(self.longest, width) + 1):
            h = mix((total[:, long:] - total[:, :-long]) * _INVERSE[: width + 1 - long] + np.uint64(long))
            row, begin = np.nonzero(self.quick[(h >> np.uint64(44)).astype(np.int64)])
            h = h[row, begin]
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            sure = (self.hashes[at] == h) & (begin + long <= size[row]) & lead[row, begin] & lead[row, begin + long]
            row = row[sure]
            found.append((np.full(len(row), long, np.int32), row, begin[sure] + long, self.piece[at[sure]]))
        longs, rows, ends, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        by_end = np.argsort(ends, kind="stable")
        longs, rows, ends, pieces = longs[by_end], rows[by_end], ends[by_end], pieces[by_end]
        cut = np.searchsorted(ends, np.arange(width + 2))
        # where the character before each position begins
        before_it = np.maximum.accumulate(np.where(lead[:, :-1], cell, -1), axis=1)
        last = np.full((n, width + 1), -2, np.int32)  # -2: not reached, -1: a character without a piece
        back = np.zeros((n, width + 1), np.int32)
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0
        last[:, 0] = -1
        if bpe:
            makes = np.unique(pieces)
            makes = makes[[self.scalar._halves(i) is not None for i in makes.tolist()]]
        for end in range(1, width + 1):
            row, long, piece = (x[cut[end] : cut[end + 1]] for x in (rows, longs, pieces))
            begin = end - long
            bare = lead[:, end] & (size >= end)
            bare[row[begin == before_it[row, end - 1]]] = False
            bare = np.flatnonzero(bare)
            if len(bare):
                long_one = end - before_it[bare, end - 1]
                ok = last[bare, end - long_one] != -2
                bare, long_one = bare[ok], long_one[ok]
                last[bare, end], back[bare, end], score[bare, end] = -1, long_one, score[bare, end - long_one] + self.v.worst
            before = last[row, begin]
            if bpe:
                fits = before != -2
                check = np.flatnonzero(before >= 0)
                fits[check] = self._compatible(before[check], piece[check])
                check = np.flatnonzero(before == -1)
                fits[check] = np.isin(piece[check], makes)
                worth = np.zeros(len(row))
            else:
                worth = score[row, begin] + self.scores[piece]
                fits = worth > score[row, end]
            put = np.flatnonzero(fits)
            put = put[np.argsort(worth[put], kind="stable")]  # of several for a row the best is written last
            last[row[put], end], back[row[put], end], score[row[put], end] = piece[put], long[put], worth[put]
        out, owner, place = [], [], []
        row, end = np.arange(n), size.copy()
        while len(row):
            piece, long = last[row, end], back[row, end]
            whole = piece >= 0
            out.append(piece[whole])
            owner.append(row[whole])
            place.append(end[whole] - long[whole])
            for k in range(4):
                bare = np.flatnonzero(~whole & (long > k))
                if len(bare):
                    byte = text[row[bare], end[bare] - long[bare] + k]
                    if self.v.bytes or k == 0:
                        out.append(self._byte_ids()[byte])
                        owner.append(row[bare])
                        place.append(end[bare] - long[bare] + k)
            end = end - long
            row, end = row[end > 0], end[end > 0]
        out, owner, place = np.concatenate(out), np.concatenate(owner), np.concatenate(place)
        return out[np.lexsort((place, owner))], np.bincount(owner, minlength=n)

    def _byte_ids(self) -> np.ndarray:
        return np.array([self.v.bytes.get(b, self.v.unknown) for b in range(256)], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        texts = len(offsets) - 1
        full = np.diff(offsets) > 0
        if self.v.dummy_prefix:
            at = offsets[:-1][full]
            data = np.insert(data, at, 32)
            offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        line = data == 10
        begins |= line
        begins[1:] |= line[:-1]
        begins[offsets[:-1][full]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, n))
        within = np.arange(n) - np.repeat(start, size)
        short = size <= SHORT
        key = np.zeros(len(start), np.uint64)
        value = _BYTE[data] * _POWER[np.minimum(within, SHORT)]
        key = mix(np.add.reduceat(value, start) + size.astype(np.uint64))
        kinds, one, which = np.unique(key[short], return_index=True, return_inverse=True)
        picked = np.flatnonzero(short)[one]
        fresh = np.flatnonzero(~np.isin(kinds, self.seen, assume_unique=True))
        if len(fresh):
            if len(self.seen) + len(fresh) > REMEMBERED:
                self._forget()
                fresh = np.arange(len(kinds))
            ids, counts = [], []
            order = fresh[np.argsort(size[picked[fresh]], kind="stable")]  # alike lengths together: little padding
            for k in range(0, len(order), 8_000):
                some = picked[order[k : k + 8_000]]
                got, count = self._search(data, start[some], size[some])
                ids.append(got)
                counts.append(count)
            counts = np.concatenate(counts)
            into = np.searchsorted(self.seen, kinds[order])
            place = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, *ids])
            by = np.argsort(kinds[order])
            self.seen = np.insert(self.seen, into[by], kinds[order][by])
            self.at, self.len = np.insert(self.at, into[by], place[by]), np.insert(self.len, into[by], counts[by])
        slot = np.searchsorted(self.seen, kinds)[which]
        at, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        at[short], length[short] = self.at[slot], self.len[slot]
        pool = self.pool
        extra = []
        for k in np.flatnonzero(~short):
            part = data[start[k] : start[k] + size[k]].tobytes().decode().replace(" ", MARK)
            got = np.concatenate([np.array(i, np.int32) for i in self.scalar.stream(part)])
            at[k], length[k] = len(pool) + sum(map(len, extra)), len(got)
            extra.append(got)
        if extra:
            pool = np.concatenate([pool, *extra])
        ends = np.cumsum(length)
        out = pool[np.repeat(at - ends + length, length) + np.arange(ends[-1])]
        total = np.concatenate(([0], ends))
        return out, np.diff(total[np.searchsorted(start, offsets)])


_ENCODERS: dict[int, BatchEncoder] = {}


def _encoder(vocabulary: Vocabulary) -> BatchEncoder:
    """One for each vocabulary and Python worker, so that later tasks find what earlier ones have worked out."""
    key = hash((vocabulary.model, tuple(vocabulary.pieces), tuple(vocabulary.scores)))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BatchEncoder(vocabulary)
    return _ENCODERS[key]


def _hash_of(b: bytes) -> np.uint64:
    x = np.frombuffer(b, np.uint8)
    return mix(np.array([(_BYTE[x] * powers(len(b))).sum(dtype=np.uint64) + np.uint64(len(b))], np.uint64))[0]


#: Bytes of text that are encoded together, and rows that leave a task together.
TEXT_BYTES, ROWS = 1 << 19, 1000


def _encoded(batches, vocabulary: Vocabulary, text_col: str):
    """(batch of at most ROWS rows, its ids as a list column)."""
    many = _encoder(vocabulary)
    one = many.scalar
    batched = vocabulary.spaced and vocabulary.lines and vocabulary.dummy_prefix
    for whole in batches:
        for k in range(0, len(whole), ROWS):
            batch = whole.slice(k, ROWS)
            column = batch.column(batch.schema.get_field_index(text_col))
            ids, sizes = [], []
            data, offsets = string_buffers(column)
            i = 0
            while i < len(column):
                j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT_BYTES, "right")) - 1))
                part = data[offsets[i] : offsets[j]]
                if batched and MARK.encode() not in part.tobytes():
                    got, count = many.encode(part, offsets[i : j + 1] - offsets[i])
                else:  # a text that holds the mark itself, or a vocabulary without sure cuts
                    each = [np.frombuffer(one.encode(data[offsets[t] : offsets[t + 1]].tobytes().decode()), np.int32) for t in range(i, j)]
                    got, count = np.concatenate(each), np.array([len(x) for x in each])
                ids.append(got)
                sizes.append(count)
                i = j
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32) if sizes else np.zeros(1, np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            null = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
            yield batch, pa.ListArray.from_arrays(pa.array(ends, mask=null), values)


def _decoded(column, vocabulary: Vocabulary) -> pa.Array:
    """The texts of a list column of ids."""
    size = np.array([len(b) for b in vocabulary.text], np.int64)
    at = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(vocabulary.text), np.uint8)
    out = []
    for ids in column:
        if not ids.is_valid:
            out.append(None)
            continue
        own = ids.values.to_numpy(zero_copy_only=False)
        n = size[own]
        ends = np.cumsum(n)
        text = pool[np.repeat(at[own] - ends + n, n) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace") if len(own) else ""
        out.append(text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text)
    return pa.array(out, pa.string())


def encode(docs: DataFrame, model: str | Vocabulary, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with a column ``ids_col array<int>`` of piece ids; an existing column of that name is replaced.

    ``model`` is the path of a vocabulary file, read on the driver, or a Vocabulary. Null texts have null ids, empty texts an empty list. Texts are encoded whole.
    """
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary(model)
    rest = docs.drop(ids_col)

    def run(batches):
        for batch, ids in _encoded(batches, vocabulary, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return map_texts(rest, run, StructType([*rest.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, model: str | Vocabulary, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with a column ``text_col`` of the texts that ``ids_col`` encodes: ``encode`` undone.

    Null ids give null, an empty list the empty text. Bytes that are no UTF-8 become U+FFFD; the mark U+2581 in an original text comes back as a space. Ids outside the vocabulary raise.
    """
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary(model)
    rest = docs.drop(text_col)

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                batch = whole.slice(k, ROWS)
                text = _decoded(batch.column(batch.schema.get_field_index(ids_col)), vocabulary)
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, text_col])

    return map_texts(rest, run, StructType([*rest.schema.fields, StructField(text_col, StringType())]))


def with_tokens(docs: DataFrame, model: str | Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip`` (whether decoding gives the text again); all null for null texts. Columns of these names are replaced.

    Encoding and decoding are done in one pass, with one Python worker a task.
    """
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary(model)
    rest = docs.drop("token_ids", "n_tokens", "round_trip")

    def run(batches):
        for batch, ids in _encoded(batches, vocabulary, text_col):
            same = pa.compute.equal(_decoded(ids, vocabulary), batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.compute.list_value_length(ids), same], [*batch.schema.names, "token_ids", "n_tokens", "round_trip"])

    more = [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("round_trip", BooleanType())]
    return map_texts(rest, run, StructType([*rest.schema.fields, *more]))
