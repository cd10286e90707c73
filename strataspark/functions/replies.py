"""Columns read from what models answer. Bad answers give null (or the stated default), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS, TOOL_RESULT_BYTES = 5, 10_240
#: The attribute that marks a row as classified.
CLASSIFIED = "classified"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clamp_valence(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def parse_valence(reply: Column) -> Column:
    """The reply as a number, else its first word that is one without ``.*:,()+`` around it; clamped to [-1, 1]; null if there is none."""
    whole = _trim(reply).try_cast("double")
    words = F.transform(F.split(_trim(reply), r"\s+"), lambda w: F.regexp_replace(w, r"^[.*:,()+]+|[.*:,()+]+$", "").try_cast("double"))
    return clamp_valence(F.coalesce(whole, F.get(F.filter(words, lambda x: x.isNotNull()), F.lit(0))))


def parse_importance(reply: Column) -> Column:
    """A whole number, else the first digit 1 to 9; clamped to 1..10; null if there is none."""
    whole = F.when(F.rlike(_trim(reply), F.lit(r"^[+-]?[0-9]+$")), _trim(reply).try_cast("long"))
    digit = F.nullif(F.regexp_extract(reply, "([1-9])", 1), F.lit("")).try_cast("long")
    number = F.coalesce(whole, digit)
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), number))).cast("int")


def strip_code_fence(reply: Column) -> Column:
    """Without a fence of three backticks (that may say ``json``) around it."""
    return _trim(F.regexp_replace(F.regexp_replace(_trim(reply), "^```(?:json)?(?:```)?", ""), "```$", ""))


def _strings(reply: Column) -> Column:
    """A JSON array of strings; null if it is anything else."""
    text = strip_code_fence(reply)
    return F.when(F.rlike(text, F.lit(r"(?s)^\[.*\]$")), F.from_json(text, "array<string>"))


def parse_tags(reply: Column) -> Column:
    """At most five tags of a JSON array, lower-cased and trimmed, joined by commas; empty on any error."""
    tags = F.filter(F.transform(_strings(reply), lambda t: F.lower(_trim(t))), lambda t: t != "")
    return F.coalesce(F.array_join(F.slice(tags, 1, MAX_TAGS), ","), F.lit(""))


def parse_facts(reply: Column) -> Column:
    """The array of strings; null on any error."""
    return _strings(reply)


def parse_rules_skills(reply: Column) -> Column:
    """Struct of ``rules`` and ``skills(content, tags)``; null on any error."""
    out = F.from_json(strip_code_fence(reply), "rules array<string>, skills array<struct<content: string, tags: string>>")
    return F.when(F.rlike(strip_code_fence(reply), F.lit(r"(?s)^\{.*\}$")) & (out["rules"].isNotNull() | out["skills"].isNotNull()), out)


def parse_wisdom(reply: Column) -> Column:
    """Struct of ``content`` and ``attrs`` (tags, domain, the mark that it is classified); null on any error or without a rule."""
    got = F.from_json(strip_code_fence(reply), "rule string, tags string, domain string")
    attrs = F.create_map(F.lit("tags"), F.coalesce(got["tags"], F.lit("")), F.lit("domain"), F.coalesce(got["domain"], F.lit("")), F.lit(CLASSIFIED), F.lit("1"))
    return F.when(_trim(got["rule"]) != "", F.struct(_trim(got["rule"]).alias("content"), F.map_filter(attrs, lambda k, v: v != "").alias("attrs")))


def parse_classification(reply: Column, attr: str, allowed: list[str], with_tags: bool = False) -> Column:
    """Map of the attribute (and up to three tags) that a reply gives, as a JSON string, an object, or bare with or without quotes; null if its value isn't allowed, whatever its case."""
    text = strip_code_fence(reply)
    got = F.from_json(text, "map<string,string>")
    quoted = F.when(F.startswith(text, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"])
    bare = F.when(~F.startswith(text, F.lit("{")), F.regexp_replace(text, "^[\"' ]+|[\"' ]+$", ""))
    value = F.lower(_trim(F.coalesce(got[attr], quoted, bare, F.lit(""))))
    names = {a.lower(): a for a in allowed}
    ok = value.isin(list(names)) if names else value != ""
    out = F.create_map(F.lit(attr), value)
    if with_tags:
        tags = F.filter(F.transform(F.from_json(F.get_json_object(text, "$.tags"), "array<string>"), lambda t: F.lower(_trim(t))), lambda t: t != "")
        joined = F.array_join(F.slice(tags, 1, 3), ",")
        out = F.when(F.coalesce(joined, F.lit("")) != "", F.map_concat(out, F.create_map(F.lit("tags"), joined))).otherwise(out)
    return F.when(ok, out)


BLOCKS = "array<struct<type: string, name: string, text: string, content: string, input: struct<file_path: string>, arguments: struct<path: string>>>"


def extract_content(raw: Column, tool_results: bool = True, text_limit: int | None = None) -> Column:
    """Text of a message's content as JSON text: a string itself, or its text blocks (and tool results of at most 10 KB) joined by line ends."""
    plain = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    blocks = F.from_json(raw, BLOCKS)

    def counts(b):
        text = (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")
        if text_limit:
            text = text & (F.octet_length(b["text"]) <= text_limit)
        return text | ((b["type"] == "tool_result") & (F.octet_length(F.coalesce(b["content"], F.lit(""))) <= TOOL_RESULT_BYTES)) if tool_results else text

    parts = F.transform(F.filter(blocks, counts), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(F.coalesce(b["content"], F.lit(""))))
    return F.when(F.startswith(raw, F.lit('"')), plain).when(F.startswith(raw, F.lit("[")), F.coalesce(F.array_join(parts, "\n"), F.lit(""))).otherwise("")


def extract_file_paths(raw: Column, dialect: str = "A") -> Column:
    """Paths that tool blocks read, write or edit; the two dialects name blocks and arguments differently."""
    blocks = F.from_json(raw, BLOCKS)
    if dialect == "A":
        own = F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isin("Read", "Write", "Edit") & (F.coalesce(b["input"]["file_path"], F.lit("")) != ""))
        paths = F.transform(own, lambda b: b["input"]["file_path"])
    else:
        own = F.filter(blocks, lambda b: (b["type"] == "toolCall") & b["name"].isin("read", "write", "edit") & (F.coalesce(b["arguments"]["path"], F.lit("")) != ""))
        paths = F.transform(own, lambda b: b["arguments"]["path"])
    return F.coalesce(paths, F.array().cast("array<string>"))


def backdate(attrs: Column) -> Column:
    """Struct of the attribute ``created_at`` as a timestamp (null without one), the other attributes, and whether it was bad."""
    text = attrs["created_at"]
    at = F.try_to_timestamp(text)
    return F.struct(at.alias("created_at"), F.map_filter(attrs, lambda k, v: k != "created_at").alias("attrs"), (text.isNotNull() & at.isNull()).alias("bad"))


def merge_source_attrs(attrs: Column, source: Column, agent: Column) -> Column:
    """Attributes with the source and agent columns, where not empty, put over them."""
    more = F.map_filter(F.create_map(F.lit("source"), F.coalesce(source, F.lit("")), F.lit("agent"), F.coalesce(agent, F.lit(""))), lambda k, v: v != "")
    base = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k)), more)
