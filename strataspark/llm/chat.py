"""Chat formatting: every participant's view of a dialogue.

For each participant the dialogue is rendered with that speaker as the assistant and the others as named users; what the assistant says is what is
trained on. The result has a row for each turn and view, with character offsets into the rendered dialogue, so a conversation of any length stays spread
over tasks: offsets are sums over blocks of turns, then within blocks. :func:`assemble` puts rows together where a whole text is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: the marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers to a block.
BLOCK_TURNS = 256
#: Characters to a text that assemble() makes; a longer dialogue comes in several.
CHUNK_CHARS = 1 << 16


def _escaped(text: Column) -> Column:
    """Marks within a text lose their meaning: ``<|`` becomes ``< |``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


#: What can't stand in a name, with what stands for it. ``%`` is the first, so that different names stay different.
NAME_ESCAPES = (("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\x0b", "%0B"), ("\f", "%0C"), ("\r", "%0D"), ("<", "%3C"), ("|", "%7C"), (">", "%3E"))


def _name(speaker: Column) -> Column:
    """A name without spaces and marks; different speakers have different names."""
    for char, code in NAME_ESCAPES:
        speaker = F.replace(speaker, F.lit(char), F.lit(code))
    return speaker


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system"
) -> DataFrame:
    """One row for each turn of each participant's view.

    Columns: ``conv_id, perspective, turn, speaker, segment`` (the rendered turn), ``start, end`` (its characters in the rendered dialogue, from 0, end
    exclusive), ``trained`` and ``train_start, train_end`` (the characters trained on: text and closing mark of the assistant's turns; else null).

    Participants are the distinct speakers of a conversation but ``system``, whose turns stay system turns in every view. A turn without a speaker is an unnamed user's, in all views.
    A conversation without participants has no views. Null texts count as empty. Rows of one turn number follow one another by speaker, then text; repeated rows are repeated turns. Rows with a null
    conversation or turn are left out. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), F.col(text_col).cast("string").alias("text")
    ).where("conv_id is not null and turn is not null")
    body = F.concat(_escaped(F.col("text")), F.lit(CLOSE))
    name = F.when(F.col("speaker") == system, F.lit("system")).otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), _name(F.col("speaker"))), F.lit(""))))
    views = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).otherwise(name), F.lit("\n"))
    made = rows.join(views, "conv_id").select("conv_id", "perspective", "turn", "speaker", "text", own.alias("trained"), head.alias("head"), body.alias("body"))
    made = made.withColumns({"size": F.char_length("head") + F.char_length("body") + 1, "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    view = ["conv_id", "perspective"]
    blocks = made.groupBy(*view, "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy(*view).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*view, "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*view, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(blocks, [*view, "block"])
    start = F.col("base") + F.col("inside")
    own = F.col("trained")
    return made.select(
        *view, "turn", "speaker", F.concat("head", "body", F.lit("\n")).alias("segment"), start.alias("start"), (start + F.col("size")).alias("end"), "trained",
        F.when(own, start + F.char_length("head")).alias("train_start"), F.when(own, start + F.char_length("head") + F.char_length("body")).alias("train_end"),
    )


def assemble(segments: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``conv_id, perspective, chunk, text, spans``: the views as texts of about ``chunk_chars`` characters, cut between turns, with the trained spans in them."""
    chunk = F.floor(F.col("start") / chunk_chars)
    rows = segments.withColumn("chunk", chunk).groupBy("conv_id", "perspective", "chunk").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "train_start", "train_end"))).alias("s"))
    first = F.col("s")[0]["start"]
    spans = F.transform(F.filter("s", lambda x: x["train_start"].isNotNull()), lambda x: F.struct((x["train_start"] - first).alias("start"), (x["train_end"] - first).alias("end")))
    return rows.select("conv_id", "perspective", "chunk", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), spans.alias("spans"))
