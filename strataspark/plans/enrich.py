"""What models add to rows: vectors, importance, tags, valence, classes. Each result is a table of ops for the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.models import Completer, Embedder, complete, embed
from strataspark.functions.replies import CLASSIFIED, parse_classification, parse_importance, parse_tags, parse_valence
from strataspark.functions.text import prompt
from strataspark.operators.cluster import auto_link
from strataspark.operators.filters import active, list_unimportant, list_unscored
from strataspark.operators.joins import list_untagged, list_unembedded
from strataspark.operators.state import ops_of, soft_delete
from strataspark.scratch import materialise

#: Errors that will not go away: the row is taken out.
TOO_LARGE = "too large"


def _at(now):
    return F.lit(now).cast("timestamp")


def backfill_valence(rows: DataFrame, completer: Completer, now, limit: int | None = None) -> DataFrame:
    """Valence ops for all unscored rows; a null number is a failed parse, of which the third ends the attempts."""
    asked = materialise(list_unscored(rows, limit).select("id", complete(prompt("valence", F.col("content")), completer).alias("r")), "replies")
    return ops_of(asked, "valence", id="id", at=_at(now), number=parse_valence(F.col("r.text")))


def backfill_importance(rows: DataFrame, completer: Completer, now, limit: int | None = None) -> DataFrame:
    asked = materialise(list_unimportant(rows, limit).select("id", complete(prompt("importance", F.col("content")), completer).alias("r")), "replies")
    return ops_of(asked.withColumn("n", parse_importance(F.col("r.text"))).where("n is not null"), "importance", id="id", at=_at(now), number="n")


def backfill_tags(rows: DataFrame, attributes: DataFrame, completer: Completer, now, limit: int | None = None) -> DataFrame:
    asked = materialise(list_untagged(rows, attributes, limit).select("id", complete(prompt("tags", F.col("content")), completer).alias("r")), "replies")
    return ops_of(asked.withColumn("t", parse_tags(F.col("r.text"))).where("t <> ''"), "attr", id="id", at=_at(now), key=F.lit("tags"), value="t")


def backfill_embeddings(rows: DataFrame, vectors: DataFrame, embedder: Embedder, model: str, now, limit: int | None = None) -> DataFrame:
    """Vector ops for all rows without one of this model; texts that the model calls too large are tombstoned."""
    made = materialise(list_unembedded(rows, vectors, model, limit).select("id", embed(F.col("content"), embedder).alias("e")), "vectors")
    good = ops_of(made.where("e.v is not null"), "embed", id="id", at=_at(now), vector="e.v", value=F.lit(model))
    return good.unionByName(soft_delete(made.where(F.contains(F.lower(F.coalesce("e.error", F.lit(""))), F.lit(TOO_LARGE))), now))


def enrich(rows: DataFrame, new: DataFrame, edges: DataFrame, embedder: Embedder, completer: dict[str, Completer], model: str, now) -> tuple[DataFrame, DataFrame]:
    """(ops, edges) for new rows: vector, links to near rows, importance, tags, valence."""
    made = materialise(
        new.select("id", embed(F.col("content"), embedder).alias("e"), *(complete(prompt(k, F.col("content")), completer[k]).alias(k) for k in ("importance", "tags", "valence"))), "enriched"
    )
    vectors = made.where("e.v is not null").select("id", F.col("e.v").alias("embedding"))
    pool = rows.join(vectors.select("id"), "id", "left_anti").select("id", "embedding", "compacted_at")
    pool = pool.unionByName(vectors.withColumn("compacted_at", F.lit(None).cast("timestamp")))
    links = auto_link(pool, vectors, edges).withColumn("created_at", _at(now))
    ops = ops_of(vectors, "embed", id="id", at=_at(now), vector="embedding", value=F.lit(model))
    ops = ops.unionByName(ops_of(made.withColumn("n", parse_importance(F.col("importance.text"))).where("n is not null"), "importance", id="id", at=_at(now), number="n"))
    ops = ops.unionByName(ops_of(made.withColumn("t", parse_tags(F.col("tags.text"))).where("t <> ''"), "attr", id="id", at=_at(now), key=F.lit("tags"), value="t"))
    return ops.unionByName(ops_of(made, "valence", id="id", at=_at(now), number=parse_valence(F.col("valence.text")))), links


def classify_layer(rows: DataFrame, layer: int, attr: str, allowed: list[str], completer: Completer, now, overwrite: bool = False, with_tags: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ops, counts): the attribute of a layer's rows as a model gives it. Rows marked as classified, or that have the attribute unless ``overwrite``, are skipped; counts are total, tagged, skipped, failed."""
    own = active(rows).where(F.col("layer") == layer)
    done = F.coalesce(F.col("attrs")[CLASSIFIED] == "1", F.lit(False)) | ((F.coalesce(F.col("attrs")[attr], F.lit("")) != "") & F.lit(not overwrite))
    marked = own.select("id", "content", done.alias("skip"))
    asked = materialise(marked.where("not skip").select("id", complete(prompt("classify", F.col("content")), completer).alias("r")).withColumn("a", parse_classification(F.col("r.text"), attr, allowed, with_tags)), "classes")
    pairs = asked.where("a is not null").select("id", F.explode(F.map_concat("a", F.create_map(F.lit(CLASSIFIED), F.lit("1")))).alias("key", "value"))
    counts = marked.agg(F.count("*").alias("total"), F.count_if("skip").alias("skipped")).join(asked.agg(F.count_if(F.col("a").isNotNull()).alias("tagged"), F.count_if(F.col("a").isNull()).alias("failed")), F.lit(True))
    return ops_of(pairs, "attr", id="id", at=_at(now), key="key", value="value"), counts
