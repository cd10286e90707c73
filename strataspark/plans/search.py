"""Hybrid search and what is made of it: for tables of queries, one plan for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.models import Completer, Embedder, complete, embed
from strataspark.functions.replies import parse_facts
from strataspark.functions.scores import ATTRIBUTE_BOOST, composite_score, default_weights
from strataspark.functions.text import prompt, truncate_ellipsis
from strataspark.functions.vectors import cosine
from strataspark.operators.aggregates import last_turns
from strataspark.operators.filters import matches_attrs
from strataspark.operators.retrieval import bm25_search, knn_join, merge_candidates, rank_topk
from strataspark.operators.text_index import TextIndex, indexed_search
from strataspark.scratch import materialise

TOP_K, DEPTH = 10, 3


@dataclass(frozen=True)
class Search:
    """How to search. Weights that are all 0 stand for the defaults; ``decay`` is ``exp`` or ``power``; ``each_layer`` gives the best of every layer; ``prefilter`` takes the nearest of the rows that qualify, not of all."""

    top_k: int = TOP_K
    layers: tuple[int, ...] = ()
    alpha: float = 0.0
    beta: float = 0.0
    gamma: float = 0.0
    min_valence: float | None = None
    max_valence: float | None = None
    attrs: tuple[tuple[str, str], ...] = ()
    decay: str = "exp"
    prefilter: bool = False
    each_layer: bool = False


def embedded_queries(queries: DataFrame, embedder: Embedder | None) -> DataFrame:
    """``(query_id, query, embedding)``; without an embedder, or where it fails, the vector is null and text search alone counts."""
    if embedder is None:
        return queries.select("query_id", "query", F.lit(None).cast("array<float>").alias("embedding"))
    return materialise(queries.withColumn("_e", embed(F.col("query"), embedder)).select("query_id", "query", F.col("_e.v").alias("embedding")), "queries")


def expand_queries(queries: DataFrame, completer: Completer) -> DataFrame:
    """The queries and other ways to ask them: ``(query_id, variant, query)`` with the original as variant 0."""
    asked = materialise(queries.withColumn("_r", complete(prompt("expand", F.col("query")), completer)), "expansions")
    more = F.coalesce(parse_facts(F.col("_r.text")), F.array().cast("array<string>"))
    return asked.select("query_id", F.posexplode(F.concat(F.array("query"), more)).alias("variant", "query"))


def candidates(rows: DataFrame, queries: DataFrame, how: Search, index: TextIndex | None = None) -> DataFrame:
    """``(query_id, id, distance, bm25)`` from both sides (the texts' from a stored index, if there is one), ``3 * top_k`` deep each; of several variants of a query all count, the best of each side."""
    variant = F.struct("query_id", F.col("variant") if "variant" in queries.columns else F.lit(0).alias("variant"))
    each = queries.select(F.to_json(variant).alias("_q"), "query_id", "query", "embedding")
    depth = DEPTH * how.top_k
    alive = rows.where("compacted_at is null")
    alive = alive.where(F.col("layer").isin(list(how.layers))) if how.layers else alive
    pool = (alive if how.prefilter else rows).where("embedding is not null").select("id", "embedding")
    near = knn_join(pool, each.select(F.col("_q").alias("query_id"), "embedding"), depth).join(alive.select("id"), "id", "left_semi")
    asked = each.select(F.col("_q").alias("query_id"), "query")
    if index is None:
        text = bm25_search(rows, asked, depth, list(how.layers) or None, each_layer=how.each_layer)
    else:
        text = indexed_search(index, asked, depth, rows, list(how.layers) or None, how.each_layer)[0]
    of = each.select("_q", "query_id")
    return merge_candidates(*(side.withColumnRenamed("query_id", "_q").join(of, "_q") for side in (near, text)))


def hybrid_search(
    rows: DataFrame, queries: DataFrame, now, how: Search = Search(), embedder: Embedder | None = None, completer: Completer | None = None, index: TextIndex | None = None
) -> DataFrame:
    """``(query_id, rank, id, score, parts, ...columns of rows)``: the ``top_k`` best rows for each query.

    ``queries(query_id, query)`` may carry vectors in ``embedding``; else ``embedder`` makes them. Candidates are the nearest vectors and the best texts; they are scored by age, importance, cosine with the query (the original, also where a completer adds
    variants) and valence; matching attributes multiply the total by 1.5; the valence range is applied after ranking, before the cut. Ties go to the smaller id.
    An ``index`` of all rows' texts saves the pass over them.
    """
    asked = queries if "embedding" in queries.columns else embedded_queries(queries, embedder)
    wide = asked.select("query_id", "query", "embedding")
    if completer is not None:
        variants = expand_queries(wide.select("query_id", "query"), completer)
        if embedder is not None:
            variants = materialise(variants.withColumn("_e", embed(F.col("query"), embedder)).select("query_id", "variant", "query", F.col("_e.v").alias("embedding")), "variants")
        else:
            variants = variants.withColumn("embedding", F.lit(None).cast("array<float>"))
        wide = variants.where("variant > 0").unionByName(wide.withColumn("variant", F.lit(0)))
    found = materialise(candidates(rows, wide, how, index).select("query_id", "id"), "candidates")
    alpha, beta, gamma = default_weights(how.alpha, how.beta, how.gamma)
    both = rows.join(found, "id").join(asked.select("query_id", F.col("embedding").alias("_q")), "query_id")
    at = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    parts = composite_score(F.col("created_at"), F.col("importance"), F.col("valence"), cosine(F.col("embedding"), F.col("_q")), at, alpha, beta, gamma, how.decay)
    scored = both.withColumn("parts", parts).drop("_q")
    boost = F.when(matches_attrs(F.col("attrs"), dict(how.attrs)), ATTRIBUTE_BOOST).otherwise(1.0) if how.attrs else F.lit(1.0)
    scored = scored.withColumn("score", F.round(F.col("parts.total") * boost, 9))
    if how.min_valence is not None:
        scored = scored.where(F.col("valence") >= how.min_valence)
    if how.max_valence is not None:
        scored = scored.where(F.col("valence") <= how.max_valence)
    return rank_topk(scored, how.top_k, keys=("query_id", "layer") if how.each_layer else ("query_id",))


def per_layer_search(rows: DataFrame, queries: DataFrame, now, k: int = 8, embedder: Embedder | None = None, index: TextIndex | None = None) -> DataFrame:
    """The best ``k`` of each layer for each query, as a search of its own per layer would give them, from one pass: candidates and ranks are kept by layer."""
    asked = queries if "embedding" in queries.columns else embedded_queries(queries, embedder)
    return hybrid_search(rows.where(F.col("layer").between(1, 5)), asked, now, Search(top_k=k, each_layer=True), index=index)


def merged_search(rows: DataFrame, queries: DataFrame, now, k: int = 20, embedder: Embedder | None = None, index: TextIndex | None = None) -> DataFrame:
    """What is shown beside :func:`per_layer_search`: the best ``k`` of all layers together."""
    return hybrid_search(rows, queries, now, Search(top_k=k), embedder, index=index)


def file_context(rows: DataFrame, paths: DataFrame, now, k: int = 5, embedder: Embedder | None = None) -> DataFrame:
    """What is known about files ``(path)``: a search in layers 3 to 5 for their folder and name."""
    parts = F.split("path", "/")
    name = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")
    return hybrid_search(rows, paths.select(F.col("path").alias("query_id"), name.alias("query")), now, Search(top_k=k, layers=(3, 4, 5)), embedder)


def rag_context(rows: DataFrame, questions: DataFrame, turns: DataFrame, now, k: int = 50, embedder: Embedder | None = None) -> DataFrame:
    """``(query_id, context)``: for questions ``(query_id, conv_id, query)`` the best rows with tags and source file, the conversation's last six turns, and the question."""
    hits = hybrid_search(rows, questions.select("query_id", "query"), now, Search(top_k=k), embedder)
    line = F.concat(F.lit("- "), F.col("content"), F.coalesce(F.concat(F.lit(" [tags: "), F.col("attrs")["tags"], F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(" [file: "), F.col("attrs")["source_file"], F.lit("]")), F.lit("")))
    known = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("_known"))
    said = last_turns(turns).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("l")))), lambda x: x["l"]), "\n").alias("_said"))
    out = questions.join(known, "query_id", "left").join(said, "conv_id", "left")
    return out.select("query_id", F.concat_ws("\n\n", F.concat(F.lit("Known:\n"), "_known"), F.concat(F.lit("Conversation:\n"), "_said"), F.concat(F.lit("Question: "), "query")).alias("context"))


def brief_results(results: DataFrame, completer: Completer) -> DataFrame:
    """Results with a ``brief``: the model's, or the text cut to 300 bytes where it gives none."""
    out = results.withColumn("_b", complete(prompt("brief", F.col("content")), completer))
    return out.withColumn("brief", F.coalesce(F.nullif(F.trim("_b.text"), F.lit("")), truncate_ellipsis(F.col("content"), 300))).drop("_b")
