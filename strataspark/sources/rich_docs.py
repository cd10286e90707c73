"""Rich documents (nested paragraphs, bullets, headings, tables) as markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _paragraph(p: dict) -> str:
    text = "".join(e.get("textRun", {}).get("content", "") for e in p.get("elements", [])).rstrip("\n")
    style = p.get("paragraphStyle", {}).get("namedStyleType", "")
    if not text.strip():
        return ""
    if style == "TITLE":
        return f"# {text}"
    if style.startswith("HEADING_") and style[8:].isdigit():
        return "#" * int(style[8:]) + " " + text
    if "bullet" in p:
        return "  " * p["bullet"].get("nestingLevel", 0) + f"- {text}"
    return text


def _blocks(content: list[dict]) -> Iterator[str]:
    for part in content or []:
        if "paragraph" in part:
            yield _paragraph(part["paragraph"])
        elif "table" in part:
            rows = [[" ".join(x for x in _blocks(cell.get("content", [])) if x) for cell in row.get("tableCells", [])] for row in part["table"].get("tableRows", [])]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                yield "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]])


def _markdown(text: str | None) -> str | None:
    try:
        doc = json.loads(text)
        body = doc.get("body", {}).get("content", [])
    except (TypeError, ValueError, AttributeError):
        return None
    return "\n\n".join(x for x in _blocks(body) if x)


@F.pandas_udf(StringType())
def rich_doc_markdown(docs: pd.Series) -> pd.Series:
    """Markdown of a document's JSON; null for anything else. Table cells nest, which column expressions can't follow."""
    return docs.map(_markdown)


def read_rich_docs(docs: DataFrame) -> DataFrame:
    """``(id, name, modified_time, content)`` of ``(id, name, modified_time, link, doc)``: the markdown below a header that tells where it is from."""
    head = F.format_string("---\ntitle: %s\nid: %s\nmodified: %s\nlink: %s\n---\n\n", F.col("name"), F.col("id"), F.col("modified_time"), F.col("link"))
    return docs.select("id", "name", "modified_time", F.concat(head, F.coalesce(rich_doc_markdown("doc"), F.lit(""))).alias("content"))
