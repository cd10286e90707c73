"""Repeated lines across documents, equal or one edit apart, by a deletion-neighbourhood join.

Two lines are one edit apart exactly if they have equal deletion variants: the same position deleted in both (a substitution), or the shorter line itself
and a variant of the longer (an insertion). All lines with one substitution key are within one edit of each other, so the earliest of a key is found
by an aggregate, and no pairs are made.

A line of n characters has n variants of n characters, far too many to shuffle for every line. The same idea on blocks goes first: a line is cut into blocks, and an edit
touches one of them, so lines one edit apart agree on all but some block. Lines that agree with no other line in this way (first with 2 blocks, then with
16) have no partner and go no further; a block that is left is cut in 16 again until it is short, and only the variants within it are made, with what is around it as one hash. So the work on a line grows with its length, not
with its square, and no pair is left out. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.names import unused
from strataspark.scratch import materialise

#: Defaults: lines shorter than this stay, and lines shorter than that go for equal lines only. 0 compares all lines that hold anything.
MIN_CHARS, MIN_CHARS_EDIT = 0, 0
#: Blocks that a line or block is cut into, and the length of block whose variants are made.
BLOCKS, SPAN = 16, 64


def _block_keys(blocks: int, line: str = "line", size: str = "size"):
    """Hashes of a line without each of its blocks, for both lengths that the shorter of a pair can have (null for a length below 0).

    Items are structs (m, j, key): the shorter line's length, the block left out, the hash of what is before and behind it.
    """
    return F.expr(f"""
        flatten(transform(array({size}, {size} - 1), m -> transform(sequence(0, {blocks} - 1), j -> named_struct(
            'm', m, 'j', j, 'key', if(m < 0, null, xxhash64(m, j,
                substring({line}, 1, int(j * m div {blocks})),
                substring({line}, {size} - (m - int((j + 1) * m div {blocks})) + 1, m - int((j + 1) * m div {blocks}))))))))
    """)


def _open(keys: DataFrame) -> DataFrame:
    """The keys that two different lines have."""
    return keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, th, pos, line, h1, h2, size) of all lines that count; th tells texts of one id apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    lines = texts.select("id", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.withColumn("size", F.char_length("line")).where(F.col("size") >= max(1, min_chars))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _blocks(texts: DataFrame) -> DataFrame:
    """``(h1, m, key, b, e)``: the blocks [b, e) of at most SPAN characters that a line must differ in from some other line, where the shorter of the two has ``m``; ``key`` is the hash of all around."""
    bounds = {"b": F.expr(f"int(j * m div {BLOCKS})"), "e": F.expr(f"int((j + 1) * m div {BLOCKS})")}
    now = texts.select("h1", F.explode(_block_keys(BLOCKS)).alias("k")).select("h1", "k.*").where("key is not null").withColumns(bounds).drop("j")
    done = []
    while True:
        now = materialise(now.join(_open(now), "key"), "line-blocks")
        done.append(now.where(F.col("e") - F.col("b") <= SPAN))
        long = now.where(F.col("e") - F.col("b") > SPAN)
        if long.isEmpty():
            break
        inner = F.expr(f"""
            transform(sequence(0, {BLOCKS} - 1), s -> named_struct('b', b + int(s * (e - b) div {BLOCKS}), 'e', b + int((s + 1) * (e - b) div {BLOCKS})))
        """)
        parts = long.join(texts.select("h1", "line", "size"), "h1").withColumn("s", F.explode(inner))
        key = F.expr("xxhash64(key, s.b, substring(line, b + 1, s.b - b), substring(line, s.e + size - m + 1, e - s.e))")
        now = parts.select("h1", "m", key.alias("key"), "s.b", "s.e")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _near(distinct: DataFrame, lines: DataFrame, min_chars_edit: int) -> DataFrame:
    """h1 of the lines that an earlier line is one edit away from."""
    halves = distinct.where(F.col("size") >= min_chars_edit).select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    some = halves.join(_open(halves), "key").select("h1").distinct()
    some = materialise(distinct.join(some, "h1", "left_semi").select("h1", "first"), "line-candidates")
    first = some.select(F.col("h1").alias("g"), F.col("first.id").alias("fi"), F.col("first.pos").alias("fp"), F.col("first.th").alias("ft"))
    # the candidates grow with the lines: both sides are shuffled, at every size alike
    texts = lines.select("id", "th", "pos", "h1", "line", "size").join(first.hint("merge"), (F.col("h1") == F.col("g")) & (F.col("id") == F.col("fi")) & (F.col("pos") == F.col("fp")) & (F.col("th") == F.col("ft")))
    texts = materialise(texts.select("h1", F.struct("id", "pos", "th").alias("first"), "line", "size").dropDuplicates(["h1"]), "line-texts")
    # the text within the block, of which the longer line has one character more
    spans = texts.join(_blocks(texts), "h1").withColumns({"x": F.expr("substring(line, b + 1, e - b + size - m)"), "n": F.expr("e - b + size - m")})
    variants = F.expr("""
        concat(
          if(size = m, array(named_struct('sub', false, 'self', true, 'p', 0, 'v', xxhash64(key, x))), array()),
          if(n < 1, array(), transform(sequence(0, n - 1), i -> named_struct(
            'sub', size = m, 'self', false, 'p', b + i, 'v', if(size = m, xxhash64(key, i, substring(x, 1, i), substring(x, i + 2, n)), xxhash64(key, concat(substring(x, 1, i), substring(x, i + 2, n))))))))
    """)
    keys = spans.select("h1", "first", F.explode(variants).alias("y")).select("h1", "first", "y.*").groupBy("h1", "first", "sub", "self", "v").agg(F.min("p").alias("p"))
    keys = materialise(keys, "line-variants")
    line = F.struct("first", "h1", "p")
    met = keys.groupBy("v", "sub").agg(
        F.min(F.when(~F.col("self"), line)).alias("other"), F.min(F.when(F.col("self"), line)).alias("whole"), F.min("h1").alias("lo"), F.max("h1").alias("hi")
    )
    met = met.where("lo <> hi").drop("lo", "hi")
    partner = F.when(F.col("sub") | F.col("self"), F.col("other")).otherwise(F.col("whole"))
    pairs = keys.join(met, ["v", "sub"]).withColumn("o", partner).where("o.first < first")
    pairs = pairs.select("h1", F.col("o.h1").alias("earlier"), F.when(F.col("self"), F.col("o.p")).otherwise(F.col("p")).alias("p")).distinct()
    # hashes led here; the texts decide, by deleting the character where they differ (which tells one edit without a table of distances)
    pairs = pairs.join(texts.select("h1", "line"), "h1").join(texts.select(F.col("h1").alias("earlier"), F.col("line").alias("before")), "earlier")
    cut = lambda c: f"concat(substring({c}, 1, p), substring({c}, p + 2))"
    size, other = F.char_length("line"), F.char_length("before")
    one = F.when(size == other, F.expr(f"{cut('line')} = {cut('before')}")).when(size == other + 1, F.expr(f"{cut('line')} = before")).when(size + 1 == other, F.expr(f"line = {cut('before')}"))
    return pairs.where(one & (F.col("line") != F.col("before"))).select("h1").distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, min_chars_edit: int) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name is the second result) of the positions of lines that go; null where none does."""
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    lines = _lines(docs, id_col, text_col, min_chars)
    occurrence = F.struct("id", "pos", "th")
    made = lines.withColumn("k", _block_keys(2)) if edits else lines
    distinct = made.groupBy("h1", "h2").agg(
        F.min(occurrence).alias("first"), F.max(occurrence).alias("last"), F.min("size").alias("size"),
        *(F.min(F.col("k")[i]["key"]).alias(f"k{i}") for i in range(4 if edits else 0)),
    )
    distinct = materialise(distinct, "lines")
    decided = distinct.where("first <> last").select("h1", "h2", "first", F.lit(False).alias("near"))
    if edits:
        near = materialise(_near(distinct, lines, max(min_chars, min_chars_edit)), "near-lines")
        marked = distinct.join(near.withColumn("near", F.lit(True)), "h1", "left").where("first <> last or near")
        decided = marked.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    decided = materialise(decided, "line-decisions")
    at = lines.select("id", "pos", "th", "h1", "h2").join(decided.hint("merge"), ["h1", "h2"]).where(F.col("near") | (occurrence != F.col("first")))
    name, of, of_text = unused(docs.columns, "gone", "gone_id", "gone_th")
    gone = at.groupBy(F.col("id").alias(of), F.col("th").alias(of_text)).agg(F.collect_set("pos").alias(name))
    same = (F.col(id_col).cast("long") == F.col(of)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(of_text))
    return docs.join(gone, same, "left").drop(of, of_text), name


def _kept(columns: list[str], text_col: str, gone: str) -> list:
    """The columns, the text without the lines that go."""
    split = F.split(F.col(text_col).cast("string"), "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    return [F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c) for c in columns]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS, min_chars_edit: int = MIN_CHARS_EDIT) -> DataFrame:
    """``docs`` with later copies of lines cut out of ``text_col``, and columns ``n_lines`` and ``n_dropped`` (replaced where they exist).

    Lines are what ``\\n`` separates. The order is that of (id, position). A line goes if an earlier line anywhere is equal, or, with ``edits=1``, at a Levenshtein distance of
    one; this is decided on the input, so a line also goes if its earlier neighbour itself goes. Lines under ``min_chars`` characters always stay, those under ``min_chars_edit`` go for equal lines only; with 0, the default, all lines are compared.
    An empty line holds nothing that repeats: it stays, and no line is compared with it. A text without lines left is empty. Null texts stay null with 0 lines; an empty text is one empty line. Rows with a null id stay as they are. Rows that repeat id and text are one document and
    get the same result. ``edits=0`` compares for equality alone.
    """
    marked, gone = _marked(docs.drop("n_lines", "n_dropped"), id_col, text_col, edits, min_chars, min_chars_edit)
    text = F.col(text_col).cast("string")
    return marked.select(
        *_kept([c for c in marked.columns if c != gone], text_col, gone), F.coalesce(F.when(text.isNotNull(), F.size(F.split(text, "\n"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """What :func:`dedup_lines` leaves, with exactly the columns of ``docs``; a document of which nothing but copies was left goes as a whole."""
    marked, gone = _marked(docs, id_col, text_col, how.get("edits", 1), how.get("min_chars", MIN_CHARS), how.get("min_chars_edit", MIN_CHARS_EDIT))
    some = F.col(gone).isNull() | (F.size(gone) < F.size(F.split(F.col(text_col).cast("string"), "\n")))
    return marked.where(some).select(*_kept(docs.columns, text_col, gone))
