"""The block of context for a prompt: principles, techniques and workspace for each intent of a query, and what is near them in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.models import Embedder
from strataspark.functions.text import condense, detect_intents
from strataspark.operators.filters import cwd_filter, domain_filter
from strataspark.operators.graph import related_of_queries
from strataspark.operators.retrieval import project_boost, rank_topk
from strataspark.plans.search import Search, embedded_queries, hybrid_search
from strataspark.scratch import materialise

#: Rows for principles, techniques and workspace by intent, and the layers of these sections.
SIZES = {"research": (2, 7, 5), "build": (5, 5, 5), "review": (4, 3, 7)}
SECTIONS = {"principles": (1, 2), "techniques": (3,), "workspace": (4,)}


def resolved_intents(queries: DataFrame, intent: str = "auto") -> DataFrame:
    """``(query_id, query, intent)``: a row per intent of each query; a named intent counts for all, an unknown name means ``build``."""
    if intent != "auto":
        return queries.withColumn("intent", F.lit(intent if intent in SIZES else "build"))
    return queries.withColumn("intent", F.explode(detect_intents(F.col("query"))))


def context_block(rows: DataFrame, edges: DataFrame, queries: DataFrame, now, intent: str = "auto", domain: str = "", project: str = "", cwd: str = "", embedder: Embedder | None = None) -> DataFrame:
    """``(query_id, intent, section, rank, id, layer, content, attrs, score)``: the sections of every intent, then ``related`` and ``observations`` by the graph, if it has edges.

    Every section is one search for all queries; sizes differ by intent, so the largest is searched and each intent cut to its own.
    """
    asked = embedded_queries(resolved_intents(queries, intent).select("query_id", "query").distinct(), embedder) if "embedding" not in queries.columns else queries
    intents = resolved_intents(queries, intent).select("query_id", "intent")
    out = None
    for i, (section, layers) in enumerate(SECTIONS.items()):
        pool = domain_filter(rows, domain) if section == "principles" else rows
        pool = cwd_filter(pool, cwd) if cwd and section == "workspace" else pool
        hits = hybrid_search(pool, asked, now, Search(top_k=max(s[i] for s in SIZES.values()), layers=layers))
        hits = rank_topk(project_boost(hits.drop("rank"), project), max(s[i] for s in SIZES.values()))
        size = F.create_map(*(F.lit(x) for k, s in SIZES.items() for x in (k, s[i])))
        part = hits.join(intents, "query_id").where(F.col("rank") <= size[F.col("intent")])
        part = part.select("query_id", "intent", F.lit(section).alias("section"), "rank", "id", "layer", "content", "attrs", "score")
        out = part if out is None else out.unionByName(part)
    if edges.isEmpty():
        return out
    out = materialise(out, "sections")
    more = graph_sections(rows, edges, out, project=project).join(rows.select("id", "layer", "content", "attrs"), "id").join(intents, "query_id")
    return out.unionByName(more.select(*out.columns))


def graph_sections(rows: DataFrame, edges: DataFrame, block: DataFrame, attrs: dict[str, str] | None = None, project: str = "") -> DataFrame:
    """``(query_id, section, rank, id, score)``: rows ``related`` to what a block shows for a query through the graph, and ``observations`` (layer 5) that its workspace rows point to."""
    found = materialise(block.select("query_id", "id", "layer").distinct(), "block")
    near = related_of_queries(edges, rows, found, attrs, project).select("query_id", F.lit("related").alias("section"), "rank", "id", "score")
    points = edges.select(F.col("from_id").alias("id"), "to_id").join(found.where("layer = 4").select("query_id", "id"), "id").select("query_id", F.col("to_id").alias("id")).distinct()
    seen = points.join(rows.where("layer = 5 and compacted_at is null").select("id", "created_at"), "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    newest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("created_at").desc(), "id"))
    return near.unionByName(seen.select("query_id", F.lit("observations").alias("section"), newest.alias("rank"), "id", F.lit(0.0).alias("score")))


def render_context(block: DataFrame, nested: bool = True) -> DataFrame:
    """``(query_id, text, ids, projects)``: the block as markdown, with headings of one level or by intent and section."""
    groups = block.groupBy("query_id", "intent", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "id", condense(F.col("content")).alias("text")))).alias("items"))
    place = F.when(F.col("section") == "principles", 0).when(F.col("section") == "techniques", 1).when(F.col("section") == "workspace", 2).when(F.col("section") == "related", 3).otherwise(4)
    head = F.concat(F.lit("### " if nested else "## "), F.initcap("section"))
    body = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    parts = groups.withColumns({"_p": place, "_t": F.concat(head, F.lit("\n"), body)})
    by_intent = parts.groupBy("query_id", "intent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n\n").alias("_t"))
    top = F.concat(F.lit("## "), F.initcap("intent"), F.lit("\n\n"), "_t") if nested else F.col("_t")
    texts = by_intent.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("intent", top.alias("_t")))), lambda x: x["_t"]), "\n\n").alias("text"))
    ids = block.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set(F.nullif(F.col("attrs")["project"], F.lit("")))).alias("projects"))
    return texts.join(ids, "query_id")
