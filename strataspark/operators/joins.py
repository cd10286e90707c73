"""The store's fixed joins. None has a cross product; every one is on keys, so Spark picks the strategy by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.operators.filters import active, classify_pr
from strataspark.schema import EDGES

KEY = ["from_id", "to_id", "edge_type"]


def with_embeddings(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with their vector (null without one)."""
    return rows.drop("embedding").join(vectors.select("id", "embedding"), "id", "left")


def with_attributes(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows with a map of their ``attributes(mem_id, key, value)``; rows without any have an empty map. Of a repeated key the largest value counts."""
    one = attributes.groupBy("mem_id", "key").agg(F.max("value").alias("value"))
    maps = one.groupBy("mem_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    out = rows.drop("attrs").join(maps.withColumnRenamed("mem_id", "id"), "id", "left")
    return out.withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def attributes_of(rows: DataFrame) -> DataFrame:
    """``(mem_id, key, value)`` of the attribute maps."""
    return rows.select(F.col("id").alias("mem_id"), F.explode("attrs").alias("key", "value"))


def list_untagged(rows: DataFrame, attributes: DataFrame, limit: int | None = None) -> DataFrame:
    """Live rows without the attribute ``tags``, oldest first."""
    tagged = attributes.where(F.col("key") == "tags").select(F.col("mem_id").alias("id"))
    out = active(rows).join(tagged, "id", "left_anti").orderBy("created_at", "id")
    return out if limit is None else out.limit(limit)


def list_unembedded(rows: DataFrame, vectors: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Live rows without a vector or with one of another model, oldest first."""
    have = vectors.select(F.col("id").alias("_vid"))
    out = active(rows).join(have, F.col("id") == F.col("_vid"), "left").where(F.col("_vid").isNull() | (F.coalesce("embedding_model", F.lit("")) != model)).drop("_vid").orderBy("created_at", "id")
    return out if limit is None else out.limit(limit)


def push_dedup(incoming: DataFrame, accepted: DataFrame, exact: bool = False) -> DataFrame:
    """Incoming rows with a column ``accepted``: not from the server, and their hash not yet accepted in their account and org.

    Repeated hashes within the payload: the first by id is accepted; with ``exact`` all are, as long as they share a layer (the first layer that has the hash).
    """
    scope = ["account", "org", "content_hash"]
    known = accepted.select(*scope).distinct().withColumn("_known", F.lit(True))
    own = F.coalesce(F.col("source"), F.lit("")) != "server"
    first = Window.partitionBy(*scope, own).orderBy("layer", "id")
    turn = F.col("layer") == F.first("layer").over(first) if exact else F.row_number().over(first) == 1
    out = incoming.join(known, scope, "left")
    return out.withColumn("_turn", turn).withColumn("accepted", own & F.col("_known").isNull() & F.col("_turn")).drop("_known", "_turn")


def push_counts(pushed: DataFrame) -> DataFrame:
    return pushed.agg(F.count_if(F.col("accepted")).alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped"))


def overlay_attrs(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """The latest sidecar JSON of a row's hash replaces its attributes, if it is a JSON object."""
    latest = sidecar.groupBy("account", "org", "content_hash").agg(F.max_by("attrs_json", "written_at").alias("_json"))
    out = rows.join(latest, ["account", "org", "content_hash"], "left")
    parsed = F.when(F.try_parse_json("_json").isNotNull() & F.rlike(F.trim("_json"), F.lit(r"(?s)^\{.*\}$")), F.from_json("_json", "map<string,string>"))
    return out.withColumn("attrs", F.coalesce(parsed, F.col("attrs"))).drop("_json")


#: What a newer row overwrites.
LWW_COLUMNS = ("importance", "access_count", "updated_at", "last_accessed_at", "decay_rate", "stability", "compacted_at")


def lww_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by content hash: a strictly newer row overwrites LWW_COLUMNS, attributes are merged key by key, a vector that comes along replaces the old.

    ``action`` is inserted, updated, skipped, or kept (no incoming row). Of several incoming rows of a hash the newest counts (largest id of equals).
    """
    columns = [c for c in current.columns if c in incoming.columns]
    newest = Window.partitionBy("content_hash").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    one = incoming.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*(F.col(c).alias(f"_in_{c}") for c in columns))
    both = current.select(*columns).join(one, F.col("content_hash") == F.col("_in_content_hash"), "full_outer")
    new, absent = F.col("content_hash").isNull(), F.col("_in_content_hash").isNull()
    newer = F.coalesce(F.col("_in_updated_at") > F.col("updated_at"), F.lit(False))

    def merged(c: str):
        mine, theirs = F.col(c), F.col(f"_in_{c}")
        if c == "attrs":
            empty = F.create_map().cast("map<string,string>")
            old = F.map_filter(F.coalesce(mine, empty), lambda k, v: ~F.map_contains_key(F.coalesce(theirs, empty), k))
            return F.when(new, theirs).when(absent, mine).otherwise(F.map_concat(old, F.coalesce(theirs, empty)))
        if c == "embedding":
            return F.coalesce(theirs, mine)
        return F.when(new | (newer & F.lit(c in LWW_COLUMNS)), theirs).otherwise(mine)

    action = F.when(new, "inserted").when(absent, "kept").when(newer, "updated").otherwise("skipped")
    return both.select(*(merged(c).alias(c) for c in columns), action.alias("action"))


def resolve_prs(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Each commit's pull request: a merged one if it has any, else the first by ``ref_order``. Commits without one have a null number."""
    order = Window.partitionBy("sha").orderBy((F.col("state") == "MERGED").desc(), "ref_order", "number")
    one = refs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "ref_order")
    return commits.join(one, "sha", "left")


def discover_new_prs(commits: DataFrame, seen: DataFrame, decided: DataFrame, budget: int) -> DataFrame:
    """``(repo, number, shas, pos)``: the first ``budget`` undecided pull requests of a repo's unseen commits, oldest first.

    ``commits(repo, sha, pos, number)`` come in order of ``pos``; a null number is a direct push. Each request has its commits up to where the budget ends. Direct pushes up to there come as a row each,
    with a null number: they are to be marked as seen.
    """
    fresh = commits.join(seen.select("repo", "sha"), ["repo", "sha"], "left_anti")
    fresh = fresh.join(decided.select("repo", "number"), ["repo", "number"], "left_anti")
    firsts = fresh.where("number is not null").groupBy("repo", "number").agg(F.min("pos").alias("first_pos"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("first_pos", "number")))
    cut = ranked.where(F.col("rank") == budget + 1).select("repo", F.col("first_pos").alias("cut"))
    taken = ranked.where(F.col("rank") <= budget).select("repo", "number")
    reached = fresh.join(cut, "repo", "left").where(F.col("cut").isNull() | (F.col("pos") < F.col("cut"))).drop("cut")
    of_requests = reached.join(taken, ["repo", "number"])
    direct = reached.where("number is null").select("repo", "number", "pos", F.array("sha").alias("shas"))
    return of_requests.groupBy("repo", "number").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha"))), lambda x: x["sha"]).alias("shas")).unionByName(direct)


def shared_budget(found: DataFrame, budget: int) -> DataFrame:
    """Of requests counted per source (``source_order, found``), how many each gets from one budget, in order."""
    before = F.coalesce(F.sum("found").over(Window.orderBy("source_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("granted", F.greatest(F.lit(0), F.least(F.col("found"), F.lit(budget) - before)))


def pr_outcomes(requests: DataFrame) -> DataFrame:
    """Requests with their outcome and whether it is final; the others are asked for again."""
    out = requests.withColumn("outcome", classify_pr(F.col("state"), F.col("merged_at")))
    return out.withColumn("decided", F.col("outcome") != "open")


def changed_documents(files: DataFrame, state: DataFrame) -> DataFrame:
    """``(path, hash, status)`` with status new, changed, unchanged or removed, of current ``files(path, hash)`` against what is stored."""
    old = state.select(F.col("path").alias("_path"), F.col("hash").alias("_hash"))
    both = files.select("path", "hash").join(old, F.col("path") == F.col("_path"), "full_outer")
    status = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "removed").when(F.col("hash") != F.col("_hash"), "changed").otherwise("unchanged")
    return both.select(F.coalesce("path", "_path").alias("path"), F.coalesce("hash", "_hash").alias("hash"), status.alias("status"))


def derived_tombstones(changes: DataFrame, derived: DataFrame) -> DataFrame:
    """Ids derived (``path, id``) from documents that changed or went."""
    return derived.join(changes.where(F.col("status").isin("changed", "removed")).select("path"), "path", "left_semi").select("id").distinct()


def changed_issues(issues: DataFrame, state: DataFrame) -> DataFrame:
    """Issues that are new or whose ``updated_at`` differs from the stored one."""
    old = state.select("repo", "number", F.col("updated_at").alias("_seen"))
    return issues.join(old, ["repo", "number"], "left").where(F.col("_seen").isNull() | (F.col("_seen") != F.col("updated_at"))).drop("_seen")


def new_comments(comments: DataFrame, seen: DataFrame) -> DataFrame:
    return comments.join(seen.select("comment_id"), "comment_id", "left_anti")


def changed_rich_docs(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Documents not stored yet or stored before their last change."""
    old = state.select("id", F.col("modified_time").alias("_stored"))
    return listing.join(old, "id", "left").where(F.col("_stored").isNull() | (F.col("_stored") < F.col("modified_time"))).drop("_stored")


def same_trace_edges(spans: DataFrame, limit: int = 50) -> DataFrame:
    """Edges from each span to the spans of its trace that came before, at most ``limit`` (the oldest), of ``spans(id, trace_id, seq)``.

    Only the first ``limit`` of a trace are ever a target, and they are cut before the shuffle; a span then meets those that are before it. So the output is at most ``limit`` rows a span, and no task sorts a trace.
    """
    rows = spans.where("trace_id is not null").select("id", "trace_id", F.struct("seq", "id").alias("at"))
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("at"))
    targets = rows.withColumn("n", number).where(F.col("n") <= limit).select("trace_id", F.col("id").alias("to_id"), F.col("at").alias("before"))
    out = rows.join(targets, "trace_id").where("before < at")
    return out.select(F.col("id").alias("from_id"), "to_id", F.lit("same_trace").alias("edge_type"), F.lit(1.0).cast("float").alias("weight"))


def seed_exclusion(rows: DataFrame, edges: DataFrame, edge_type: str = "compacted_from") -> DataFrame:
    """Rows without an edge of this type in either direction."""
    own = edges.where(F.col("edge_type") == edge_type)
    ends = own.select(F.col("from_id").alias("id")).union(own.select(F.col("to_id").alias("id")))
    return rows.join(ends, "id", "left_anti")


def promotion_guard(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that nothing was derived from yet."""
    return seed_exclusion(rows, edges, "derived_from")


def resume_guard(todo: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of problem and approach without a result."""
    return todo.join(results.select("instance_id", "approach"), ["instance_id", "approach"], "left_anti")


def edge_insert_ignore(edges: DataFrame, new: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges with those new ones added whose key is new and whose ends exist. Of repeated new keys the heaviest is taken."""
    ids = rows.select("id").distinct()
    one = new.groupBy(*KEY).agg(F.max(F.struct("weight", "created_at")).alias("_e")).select(*KEY, "_e.*")
    ok = one.join(edges.select(*KEY), KEY, "left_anti")
    ok = ok.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return edges.unionByName(ok.select(*(c.split()[0] for c in EDGES.split(", "))))


def delete_edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti")
