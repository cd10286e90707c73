"""BPE encoding by a transducer of bounded lookahead, and decoding by a state machine from bytes to text.

**Lookahead.** Merging applies the rules of the list in order. Take a text and any continuation of it: while both are merged, the tokens that end at or before some front are the same in
both. A rule (u, v) moves that front left, by the length of u, only where u is the last common token and v starts at the front. Had rule (u', v') moved the front there, u' is on the
left edge of v's tree of merges, and its rule is an earlier one. So no chain of moves is longer than the longest sum of |u| over such chains, which :class:`Merges` computes from the list
in one pass. A token that ends that many bytes before the end of what is known is stable: it is emitted, and what stands before it is forgotten.

**Transducer.** A text is fed in steps. Marks of special tokens, normalisation, words and merges each hold back what the next step may still change and pass on the rest, so the state
is bounded by :data:`WINDOW`, the lookahead and the longest row of combining marks, whatever the length of texts and words. Short words that are complete are remembered.

Only the vocabulary file is read; nothing of the library's own encoder is used.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from strataspark.llm.batches import map_texts

#: Characters of a text fed at once; bytes of a word emitted at once beyond the lookahead; characters of a word that may stay open before it is streamed.
STEP, WINDOW, OPEN = 1 << 16, 1 << 10, 64
#: Words remembered per Python worker, and bytes of the longest of them.
REMEMBERED, SHORT = 300_000, 64
#: Unicode white space; the words of this kind of vocabulary: contractions, letters, single numbers, the rest.
SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, the others count up from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@functools.lru_cache
def _classes() -> tuple[str, str, frozenset[str]]:
    """Letters and numbers as character ranges, and the characters that may combine with one before them (composition of two, Hangul vowels and finals, combining marks)."""
    kinds = {"L": [], "N": []}
    joins = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            if kinds[kind] and kinds[kind][-1][1] == code - 1:
                kinds[kind][-1][1] = code
            else:
                kinds[kind].append([code, code])
        if unicodedata.combining(c):
            joins.add(c)
        made = unicodedata.decomposition(c).split()
        if len(made) == 2 and "<" not in made[0]:
            joins.add(chr(int(made[1], 16)))
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LN")
    return letters, numbers, frozenset(joins)


class Merges:
    """A vocabulary file: symbols, rules, special tokens and the sufficient lookahead, in bytes. ``path`` is read where this is made (the driver); the object goes to the workers."""

    def __init__(self, path: str | None = None, data: dict | None = None):
        if data is None:
            with open(path, encoding="utf-8") as file:
                data = json.load(file)
        model = data["model"]
        split = data.get("pre_tokenizer") or {}
        if (data.get("normalizer") or {}).get("normalizers") != NORMAL or split.get("pretokenizers") != [WORDS, BYTES] or model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("this transducer reads word-end BPE over bytes: NFC, white space, lower case, then contractions, letters, numbers, the rest")
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or data.get("decoder"):
            raise ValueError("subword prefixes, dropout, whole-word lookup and decoders are not supported")
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.inner, self.final = [self.vocab[c] for c in alphabet], [self.vocab[c + end] for c in alphabet]
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.specials.values()]))
        for t, i in chain(self.vocab.items(), self.specials.items()):
            self.tokens[i] = t
        self.end, self.ranks, self.whole = end, {}, []
        made: dict[int, tuple[int, int]] = {}
        size = {i: 1 for i in chain(self.inner, self.final)}
        reach: dict[int, int] = {}  # by left part: the longest chain of moves that ends with a rule of that part
        self.lookahead = 1
        for rank, rule in enumerate(model["merges"]):
            u, v = (self.vocab[x] for x in (rule if isinstance(rule, list) else rule.split(" ")))
            whole = self.vocab[self.tokens[u] + self.tokens[v]]
            if u not in size or v not in size or whole in made:
                raise ValueError(f"rule {rank} uses a token that only a later rule makes, or makes one twice: the list has no bounded lookahead of this kind")
            left, before = v, 0
            while True:
                before = max(before, reach.get(left, 0))
                if left not in made:
                    break
                left = made[left][0]
            reach[u] = max(reach.get(u, 0), size[u] + before)
            self.lookahead = max(self.lookahead, reach[u])
            made[whole], size[whole] = (u, v), size[u] + size[v]
            self.ranks[u, v] = rank
            self.whole.append(whole)
        self.size = [size.get(i, 0) for i in range(len(self.tokens))]
        self.longest = max(self.size)
        self.letters, self.numbers, self.joins = _classes()

    def merge(self, parts: list[int]) -> list[int]:
        """``parts`` merged by priority, equal ones from the left; the list itself is used up."""
        return self._merge_few(parts) if len(parts) <= 48 else self._merge_many(parts)

    def _merge_few(self, parts: list[int]) -> list[int]:
        get, whole, none = self.ranks.get, self.whole, len(self.whole)
        ranks = [get(x, none) for x in zip(parts, parts[1:], strict=False)]
        ranks.append(none)
        while (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = made = whole[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], made), none)
            if i + 1 < len(parts):
                ranks[i] = get((made, parts[i + 1]), none)
        return parts

    def _merge_many(self, parts: list[int]) -> list[int]:
        n, whole, get = len(parts), self.whole, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i) for i in range(n - 1) if (p := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != best:
                continue
            parts[i], parts[j], after[i] = whole[best], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := get((parts[i], parts[after[j]]))) is not None:
                    heapq.heappush(heap, (p, i))
            if before[i] >= 0 and (p := get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (p, before[i]))
        return [x for x in parts if x >= 0]


class WordStream:
    """One word, byte by byte: what is stable goes to ``out``, at most ``WINDOW`` and the lookahead stay."""

    def __init__(self, merges: Merges, out: array, window: int = WINDOW):
        self.m, self.out, self.held = merges, out, []
        self.window = max(window, merges.longest)

    def feed(self, data: bytes) -> None:
        inner, span = self.m.inner, self.window + self.m.lookahead
        for at in range(0, len(data), span):
            self.held.extend(inner[b] for b in data[at : at + span])
            while len(self.held) > span:  # one byte more is known, so none of these is the word's last
                done = 0
                for x in self.m.merge(self.held[:span]):
                    if done + self.m.size[x] > self.window:
                        break
                    done += self.m.size[x]
                    self.out.append(x)
                del self.held[:done]

    def close(self) -> None:
        if self.held:
            last = self.m.inner.index(self.held[-1])
            self.out.extend(self.m.merge([*self.held[:-1], self.m.final[last]]))
            self.held = []


class _Remembered(dict):
    """The ids of short words."""

    def __init__(self, merges: Merges):
        self.m = merges

    def __missing__(self, word: str) -> array | list[int]:
        data = word.encode("utf-8", "replace")
        if len(data) > SHORT:
            out = array("i")
            stream = WordStream(self.m, out)
            stream.feed(data)
            stream.close()
            return out
        ids = self.m.merge([*(self.m.inner[b] for b in data[:-1]), self.m.final[data[-1]]])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids


class Transducer:
    """Feeds of a text in, ids out. One for a worker; :meth:`start` begins the next text."""

    def __init__(self, merges: Merges, window: int = WINDOW, hold: int = OPEN):
        self.m, self.known, self.window, self.hold = merges, _Remembered(merges), window, hold
        a, n = merges.letters, merges.numbers
        short = "|".join(map(re.escape, CONTRACTIONS))
        pattern = f"[{{0}}]+|{short}|[{{1}}]|[^{SPACE}{{0}}{{1}}]+"  # contractions start with no letter, so letters may come first
        self.word = re.compile(pattern.format(a, n))
        self.plain_word = re.compile(pattern.format(*(re.sub(r"\\U(?!0000).{8}-.{10}", "", x) for x in (a, n))))  # the same for texts of the basic plane, far faster
        self.run = {True: re.compile(f"[{a}]*"), False: re.compile(f"[^{SPACE}{a}{n}]*")}
        self.letter, self.special = re.compile(f"[{a}]"), re.compile("|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True))) or r"(?!)")
        self.last_space = re.compile(f"[{SPACE}](?=[^{SPACE}]*\\Z)")
        self.starts = {s[:k] for s in merges.specials for k in range(1, len(s))}
        self.start()

    def start(self) -> None:
        self.out = array("i")
        self.marks, self.raw, self.text, self.open, self.kind = "", "", "", None, None

    def feed(self, text: str, last: bool = False) -> array:
        """The ids that became stable."""
        text, at = self.marks + text, 0
        for found in self.special.finditer(text):
            self._normalise(text[at : found.start()], True)
            self.out.append(self.m.specials[found[0]])
            at = found.end()
        longest = 0 if last else next((k for k in range(min(len(text) - at, max(map(len, self.starts), default=0)), 0, -1) if text[-k:] in self.starts), 0)
        self.marks = text[len(text) - longest :]
        self._normalise(text[at : len(text) - longest], last)
        out, self.out = self.out, array("i")
        if self.open:
            self.open.out = self.out
        return out

    def held(self) -> int:
        """Characters and bytes that wait for what follows."""
        return len(self.marks) + len(self.raw) + len(self.text) + (len(self.open.held) if self.open else 0)

    def _normalise(self, text: str, last: bool) -> None:
        text = self.raw + text
        cut = len(text)
        if not last:
            while cut and (cut == len(text) or text[cut] in self.m.joins):
                cut -= 1
        self.raw, text = text[cut:], text[:cut]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look for the ends of words
        self._words(text.lower(), last)

    def _words(self, text: str, last: bool) -> None:
        if self.open:
            end = self.run[self.kind].match(text).end()
            self.open.feed(text[:end].encode("utf-8", "replace"))
            if end == len(text) and not last:
                return
            self.open.close()
            self.open, text = None, text[end:]
        text, cut = self.text + text, 0
        if not last:
            space = self.last_space.search(text)
            cut = space.end() if space else 0
        ready, self.text = (text, "") if last else (text[:cut], text[cut:])
        word = self.plain_word if len(ready.encode("utf-16-le", "replace")) == 2 * len(ready) else self.word
        self.out.extend(chain.from_iterable(map(self.known.__getitem__, word.findall(ready))))
        if len(self.text) > self.hold:  # a long stretch without a space: all but the last words are sure, and a long last one is streamed
            found = list(self.word.finditer(self.text))
            long = found[-1].end() - found[-1].start() > self.hold
            sure = found[:-1] if long else found[:-3]
            self.out.extend(chain.from_iterable(self.known[x[0]] for x in sure))
            self.text = self.text[sure[-1].end() :] if sure else self.text
            if long:
                self.kind, self.open = bool(self.letter.match(self.text)), WordStream(self.m, self.out, self.window)
                self.open.feed(self.text.encode("utf-8", "replace"))
                self.text = ""

    def encode(self, text: str, step: int = STEP) -> array:
        """All ids of a text, fed in steps."""
        self.start()
        if len(text) <= step:
            return self.feed(text, True)
        out = array("i")
        for at in range(0, len(text), step):
            out.extend(self.feed(text[at : at + step], at + step >= len(text)))
        return out


class Decoder:
    """Ids in, text out, as soon as its bytes are complete; what is left of a broken character becomes U+FFFD.

    ``spaced``: tokens as the file spells them with a space between, which is what the library's decode() gives for files without a decoder. Else the text
    itself: bytes for letters of the alphabet, a space for each end of a word.
    """

    def __init__(self, merges: Merges, spaced: bool = True):
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.between = b" " if spaced else b""
        if spaced:
            self.pieces = [t.encode() for t in merges.tokens]
        else:
            special = set(merges.specials)
            plain = [(t.removesuffix(merges.end), t.endswith(merges.end)) for t in merges.tokens]
            self.pieces = [t.encode() + b" " if t in special else bytes(back[c] for c in p) + b" " * e for t, (p, e) in zip(merges.tokens, plain, strict=True)]
        self.start()

    def start(self) -> None:
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids, last: bool = False) -> str:
        data = self.between.join(map(self.pieces.__getitem__, ids))
        if len(ids):
            data, self.first = (data if self.first else self.between + data), False
        return self.state.decode(data, last)

    def decode(self, ids, step: int = STEP) -> str:
        self.start()
        return "".join(self.feed(ids[at : at + step], at + step >= len(ids)) for at in range(0, max(1, len(ids)), step))


def _added(schema: StructType, fields: list[StructField]) -> tuple[StructType, list[str]]:
    names = {f.name.lower() for f in fields}
    kept = [f for f in schema.fields if f.name.lower() not in names]
    return StructType([*kept, *fields]), [f.name for f in kept]


def with_bpe(docs: DataFrame, path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``token_ids array<int>``, ``n_tokens long`` and, if ``decode``, ``decoded`` (the ids decoded again, spaced as :class:`Decoder` says).

    Null texts count as empty: no ids, an empty text. Texts of any length are fed in steps. Characters that Unicode has added since this Python's version may be taken for other
    kinds than the library takes them for. Columns of ``docs`` with one of these names are replaced, all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Merges(path))
    fields = [StructField("token_ids", ArrayType(IntegerType(), False), False), StructField("n_tokens", LongType(), False)] + [StructField("decoded", StringType(), False)] * decode
    schema, kept = _added(docs.schema, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Transducer(sent.value), Decoder(sent.value)
        for batch in batches:
            ids, ends, texts = array("i"), [0], []
            for text in batch.column(text_col):
                own = encoder.encode(text.as_py() or "")
                ids.extend(own)
                ends.append(len(ids))
                if decode:
                    texts.append(decoder.decode(own))
            at = np.array(ends, np.int64)
            made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))), pa.array(np.diff(at))]
            made += [pa.array(texts, pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.fieldNames())

    return map_texts(docs, run, schema)


def decode_bpe(rows: DataFrame, path: str, ids_col: str = "token_ids", spaced: bool = False) -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids in ``ids_col`` (null: empty). Not ``spaced``: lower-cased text with a space behind each word. An id that the vocabulary lacks fails the job."""
    sent = rows.sparkSession.sparkContext.broadcast(Merges(path))
    schema, kept = _added(rows.schema, [StructField("decoded", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value, spaced)
        for batch in batches:
            texts = [decoder.decode(x.values.to_numpy() if x.is_valid else []) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=schema.fieldNames())

    return map_texts(rows, run, schema)
