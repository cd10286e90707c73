"""Compaction: lower layers are clustered and rolled up into higher ones. Snapshot in, new rows, edges and tombstones out; nothing changes until the caller publishes them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.models import Completer, complete
from strataspark.functions.replies import parse_rules_skills, parse_wisdom
from strataspark.functions.text import content_hash, prompt
from strataspark.operators.aggregates import centroid, chrono_windows, cluster_span, dominant_attr, even_sample, stats_by_layer
from strataspark.operators.cluster import greedy_clusters
from strataspark.operators.filters import active
from strataspark.operators.graph import lineage_edges
from strataspark.operators.joins import delete_edges_from, edge_insert_ignore, promotion_guard, seed_exclusion
from strataspark.scratch import materialise

#: Fixed values.
L5_COUNT, L5_HOURS, L5_COSINE, L5_MIN, WINDOW = 50, 24, 0.75, 2, 20
L4_COSINE, L4_MIN = 0.85, 5
PROMOTE_ACCESSES, PROMOTE_IMPORTANCE = 10, 7
SEED_L5, SEED_L2, SEED_L3, SEED_CLUSTERS = 50, 10, 20, 100
SAMPLE_BYTES = 80_000
MADE = "id string, layer int, content string, content_hash string, attrs map<string,string>, source_ids array<string>, embedding array<float>, created_at timestamp, path string"


@dataclass
class Rollup:
    """New rows ``made`` (with their ``source_ids``), lineage ``edges`` and ``dead`` ids of one path."""

    made: DataFrame
    edges: DataFrame
    dead: DataFrame
    parts: list = field(default_factory=list)


def compaction_trigger(rows: DataFrame, now) -> DataFrame:
    """One row: count and oldest of layer 5, and whether they call for compaction (over 50, or older than 24 hours)."""
    at = F.lit(now).cast("timestamp")
    one = active(rows).where("layer = 5").agg(F.count("*").alias("live"), F.min("created_at").alias("oldest"))
    due = (F.col("live") > L5_COUNT) | F.coalesce(F.col("oldest") < at - F.expr(f"interval {L5_HOURS} hours"), F.lit(False))
    return one.withColumn("due", due)


def _empty(rows: DataFrame) -> Rollup:
    spark = rows.sparkSession
    made = spark.createDataFrame([], MADE)
    return Rollup(made, lineage_edges(made), made.select("id"))


def _texts(members: DataFrame, kind: str, completer: Completer) -> DataFrame:
    """``(cluster, reply)``: the model's answer for an even sample of each cluster's texts; failed ones are left out. The sample bounds what is collected for a cluster."""
    some = even_sample(members.select("cluster", "id", "content", "created_at"), SAMPLE_BYTES)
    notes = some.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))), lambda x: x["content"]), "\n---\n").alias("notes"))
    asked = materialise(notes.select("cluster", complete(prompt(kind, F.col("notes")), completer).alias("r")), "summaries")
    return asked.where("r.error is null and trim(r.text) <> ''").select("cluster", F.col("r.text").alias("reply"))


def _roll(members: DataFrame, replies: DataFrame, layer: int, path: str, now, attrs: DataFrame | None = None) -> DataFrame:
    sources = members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("source_ids"))
    out = replies.join(sources, "cluster")
    out = out.join(attrs, "cluster", "left") if attrs is not None else out.withColumn("attrs", F.create_map(F.lit("source"), F.lit("compactor")))
    return out.select(
        F.concat(F.lit(f"{path}-"), F.substring(content_hash(F.concat_ws("\0", F.lit(path), "source_ids", "reply")), 1, 24)).alias("id"), F.lit(layer).alias("layer"), F.trim("reply").alias("content"),
        content_hash(F.trim("reply")).alias("content_hash"), "attrs", "source_ids", F.lit(None).cast("array<float>").alias("embedding"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(path).alias("path"),
    )


def compact_l5_l4(rows: DataFrame, completer: Completer, now) -> Rollup:
    """Clusters of layer 5 (cosine 0.75, two members) and windows of twenty of the rest become rows of layer 4; all members die."""
    own = active(rows).where("layer = 5")
    clusters = materialise(greedy_clusters(own.select("id", "created_at", "embedding"), L5_COSINE, L5_MIN), "clusters")
    rest = own.join(clusters.select("id"), "id", "left_anti")
    fallback = chrono_windows(rest, WINDOW).select("id", F.concat(F.lit("window-"), F.col("window").cast("string")).alias("cluster"), F.row_number().over(Window.partitionBy("window").orderBy("created_at", "id")).alias("pos"))
    named = clusters.select("id", F.col("cluster").cast("string").alias("cluster"), F.col("pos").cast("int").alias("pos")).unionByName(fallback.withColumn("pos", F.col("pos").cast("int")))
    members = materialise(own.join(named, "id").select("id", "cluster", "pos", "content", "created_at", "attrs"), "members")
    span, project = cluster_span(members), dominant_attr(members, "project")
    known = span.join(project.select("cluster", "value"), "cluster", "left")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    attrs = F.create_map(F.lit("source"), F.lit("compactor"), F.lit("window_start"), time("window_start"), F.lit("window_end"), time("window_end"), F.lit("project"), F.coalesce("value", F.lit("")))
    made = materialise(_roll(members, _texts(members, "cluster", completer), 4, "l5-l4", now, known.select("cluster", F.map_filter(attrs, lambda k, v: v != "").alias("attrs"))), "made")
    return Rollup(made, lineage_edges(made), made.select(F.explode("source_ids").alias("id")))


def compact_l4_l3(rows: DataFrame, completer: Completer, now, valence_floor: float | None = None, keep_centroid: bool = False) -> Rollup:
    """Clusters of layer 4 (cosine 0.85, five members) become techniques of layer 3; members die. Optionally only rows over a valence count, and the new row keeps the members' centroid."""
    own = active(rows).where("layer = 4")
    own = own if valence_floor is None else own.where(F.col("valence") >= valence_floor)
    clusters = materialise(greedy_clusters(own.select("id", "created_at", "embedding"), L4_COSINE, L4_MIN), "clusters")
    members = materialise(own.join(clusters, "id").select("id", "cluster", "pos", "content", "created_at", "attrs", "embedding"), "members")
    made = _roll(members, _texts(members, "skill", completer), 3, "l4-l3", now)
    if keep_centroid:
        middle = members.select("id", "cluster").where(F.col("id") == F.col("cluster")).join(centroid(members), "cluster").select(F.col("id").alias("_seed"), F.col("centroid").cast("array<float>").alias("_c"))
        made = made.withColumn("_seed", F.explode("source_ids")).join(middle, "_seed").drop("_seed").withColumn("embedding", F.col("_c")).drop("_c")
    made = materialise(made, "made")
    return Rollup(made, lineage_edges(made), made.select(F.explode("source_ids").alias("id")))


def promote_l3_l2(rows: DataFrame, edges: DataFrame, completer: Completer, now) -> Rollup:
    """Rows of layer 3 that are used (10 accesses) and important (over 7) and weren't promoted yet become rules of layer 2; they stay alive."""
    due = promotion_guard(active(rows).where((F.col("layer") == 3) & (F.col("access_count") >= PROMOTE_ACCESSES) & (F.col("importance") > PROMOTE_IMPORTANCE)), edges)
    asked = materialise(due.select("id", complete(prompt("wisdom", F.col("content")), completer).alias("r")).withColumn("w", parse_wisdom(F.col("r.text"))), "wisdom")
    good = asked.where("w is not null")
    made = good.select(
        F.concat(F.lit("l3-l2-"), F.substring(content_hash(F.concat_ws("\0", "id", "w.content")), 1, 24)).alias("id"), F.lit(2).alias("layer"), F.col("w.content").alias("content"), content_hash(F.col("w.content")).alias("content_hash"),
        F.map_concat(F.create_map(F.lit("source"), F.lit("compactor")), F.col("w.attrs")).alias("attrs"), F.array(F.col("id")).alias("source_ids"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(now).cast("timestamp").alias("created_at"), F.lit("l3-l2").alias("path"),
    )
    return Rollup(made, lineage_edges(made, "derived_from"), made.select("id").limit(0))


def seed_upper_layers(rows: DataFrame, edges: DataFrame, completer: Completer, now) -> Rollup:
    """Rules and skills from clusters of fresh layer 5, while layer 2 has under 10 rows or layer 3 under 20; needs 50 rows of layer 5. Nothing dies.

    At most 100 clusters, in order; rules are taken until layer 2 is full and skills until layer 3 is.
    """
    have = {r.layer: r.live for r in stats_by_layer(rows).collect()}
    room2, room3 = max(0, SEED_L2 - have.get(2, 0)), max(0, SEED_L3 - have.get(3, 0))
    if have.get(5, 0) < SEED_L5 or not (room2 or room3):
        return _empty(rows)
    own = seed_exclusion(active(rows).where("layer = 5"), edges)
    clusters = materialise(greedy_clusters(own.select("id", "created_at", "embedding"), L5_COSINE, L5_MIN), "clusters")
    order = clusters.join(own.select("id", "created_at"), "id").groupBy("cluster").agg(F.min(F.struct("created_at", "id")).alias("first")).orderBy("first").limit(SEED_CLUSTERS)
    order = order.withColumn("turn", F.row_number().over(Window.orderBy("first")))
    members = materialise(own.join(clusters, "id").join(order.select("cluster", "turn"), "cluster").select("id", "cluster", "turn", "content", "created_at"), "members")
    replies = _texts(members, "seed", completer).withColumn("p", parse_rules_skills(F.col("reply"))).where("p is not null").join(order.select("cluster", "turn"), "cluster")
    rules = replies.select("cluster", "turn", F.lit(2).alias("layer"), F.posexplode("p.rules").alias("k", "content")).withColumn("tags", F.lit(""))
    skills = replies.select("cluster", "turn", F.lit(3).alias("layer"), F.posexplode("p.skills").alias("k", "s")).select("cluster", "turn", "layer", "k", F.col("s.content").alias("content"), F.coalesce("s.tags", F.lit("")).alias("tags"))
    both = materialise(rules.unionByName(skills).where("trim(content) <> ''"), "seeds")
    place = F.row_number().over(Window.partitionBy("layer").orderBy("turn", "k"))
    taken = both.withColumn("_n", place).where(F.col("_n") <= F.when(F.col("layer") == 2, room2).otherwise(room3))
    sources = members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("source_ids"))
    made = taken.join(sources, "cluster").select(
        F.concat(F.lit("seed-"), F.substring(content_hash(F.concat_ws("\0", "cluster", F.col("k").cast("string"), "content")), 1, 24)).alias("id"), "layer", F.trim("content").alias("content"), content_hash(F.trim("content")).alias("content_hash"),
        F.map_filter(F.create_map(F.lit("source"), F.lit("compactor"), F.lit("tags"), F.col("tags")), lambda k, v: v != "").alias("attrs"), "source_ids", F.lit(None).cast("array<float>").alias("embedding"), F.lit(now).cast("timestamp").alias("created_at"), F.lit("seed").alias("path"),
    )
    made = materialise(made, "made")
    return Rollup(made, lineage_edges(made), made.select("id").limit(0))


def apply_rollup(rows: DataFrame, edges: DataFrame, rollup: Rollup, now) -> tuple[DataFrame, DataFrame]:
    """The snapshot and the edges after a path: members are tombstoned, new rows with new texts come in.

    A text that is stored already, or made more than once, is one row: the stored one (of smallest id), or the made one of smallest id. Lineage starts at that row, once an edge; no edge starts or ends at an id that doesn't exist,
    and none leads from a row to itself.
    """
    at = F.lit(now).cast("timestamp")
    dead = rollup.dead.distinct().withColumn("_dead", F.lit(True))
    stored = rows.groupBy("content_hash").agg(F.min("id").alias("_stored"))
    first = rollup.made.groupBy("content_hash").agg(F.min("id").alias("_first"))
    kept = rollup.made.select("id", "content_hash").join(first, "content_hash").join(stored, "content_hash", "left").select(F.col("id").alias("from_id"), F.coalesce("_stored", "_first").alias("_kept"))
    kept = materialise(kept, "surviving")
    rows = rows.join(dead, "id", "left").withColumn("compacted_at", F.when(F.col("_dead"), at).otherwise(F.col("compacted_at"))).drop("_dead")
    fresh = rollup.made.join(kept.where("from_id = _kept").select(F.col("from_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    given = {"id", "layer", "content", "content_hash", "attrs", "embedding", "created_at"}
    defaults = {"importance": F.lit(5.0), "access_count": F.lit(0), "updated_at": at, "last_accessed_at": at, "stability": F.lit(1.0), "valence": F.lit(0.0), "valence_scored": F.lit(False), "valence_attempts": F.lit(0), "source": F.lit("compactor")}
    new = fresh.select(*(F.col(f.name) if f.name in given else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    rows = rows.unionByName(new)
    lineage = rollup.edges.join(kept, "from_id").withColumn("from_id", F.col("_kept")).where("from_id <> to_id").select(*edges.columns)
    return rows, edge_insert_ignore(edges, lineage, rows)


def run_compaction(rows: DataFrame, edges: DataFrame, completer: Completer, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, edges, report) after seeding and all three paths, once each. Layer 5 is compacted only when it is due."""
    parts = []

    def step(rollup: Rollup):
        nonlocal rows, edges
        parts.append(rollup)
        rows, edges = apply_rollup(rows, edges, rollup, now)
        rows, edges = materialise(rows, "snapshot"), materialise(edges, "edges")

    step(seed_upper_layers(rows, edges, completer, now))
    step(compact_l5_l4(rows, completer, now) if compaction_trigger(rows, now).first().due else _empty(rows))
    step(compact_l4_l3(rows, completer, now))
    step(promote_l3_l2(rows, edges, completer, now))
    return rows, edges, compaction_report(parts)


def compaction_report(parts: list[Rollup]) -> DataFrame:
    """``(path, made, sources)`` of the paths that made something."""
    made = reduce(DataFrame.unionByName, [p.made.select("path", "source_ids") for p in parts])
    return made.groupBy("path").agg(F.count("*").alias("made"), F.sum(F.size("source_ids")).alias("sources"))


def compaction_log(rollup: Rollup, run_id: str, now, source_layer: int) -> DataFrame:
    """A log row for each new row."""
    return rollup.made.select(F.concat(F.lit(f"{run_id}-"), "id").alias("id"), F.lit(now).cast("timestamp").alias("run_at"), "path", F.lit(source_layer).alias("source_layer"), F.col("layer").alias("target_layer"), "source_ids", F.col("id").alias("target_id"))


def rebuild_layer(rows: DataFrame, edges: DataFrame, completer: Completer, now, layer: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows of a layer die, their outgoing edges go, and compaction runs again."""
    gone = materialise(active(rows).where(F.col("layer") == layer).select("id"), "gone")
    dead = gone.withColumn("_dead", F.lit(True))
    rows = rows.join(dead, "id", "left").withColumn("compacted_at", F.when(F.col("_dead"), F.lit(now).cast("timestamp")).otherwise(F.col("compacted_at"))).drop("_dead")
    return run_compaction(rows, delete_edges_from(edges, gone), completer, now)


def dry_run(rows: DataFrame) -> DataFrame:
    """Live rows by layer beside what would start compaction."""
    return stats_by_layer(rows).withColumn("threshold", F.when(F.col("layer") == 5, L5_COUNT)).withColumn("due", F.col("live") > F.col("threshold"))
