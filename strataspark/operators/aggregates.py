"""Counts, statistics and window-style operators over memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.text import file_list_text
from strataspark.functions.vectors import unit
from strataspark.operators.filters import active
from strataspark.operators.scan import number_rows
from strataspark.schema import LAYERS
from strataspark.scratch import materialise

#: Line numbers to a block of a file.
BLOCK_LINES = 1 << 16
#: Upper bounds in seconds of the duration histograms.
SEARCH_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
SYNC_BUCKETS = (1.0, 5.0, 15.0, 30.0, 60.0, 120.0, 300.0)


def stats_by_layer(rows: DataFrame) -> DataFrame:
    return active(rows).groupBy("layer").agg(F.count("*").alias("live"))


def stats(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: live rows, a map of them by layer, edges."""
    layers = stats_by_layer(rows).agg(F.coalesce(F.sum("live"), F.lit(0)).alias("live"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "live")))).alias("by_layer"))
    return layers.join(edges.agg(F.count("*").alias("edges")), F.lit(True))


def oldest_by_layer(rows: DataFrame) -> DataFrame:
    return active(rows).groupBy("layer").agg(F.count("*").alias("live"), F.min("created_at").alias("oldest"))


def pending_push(rows: DataFrame) -> DataFrame:
    """How many live rows that aren't from the server have never been pushed or have changed since."""
    due = (F.coalesce("source", F.lit("")) != "server") & (F.col("pushed_at").isNull() | (F.col("pushed_at") < F.col("updated_at")))
    return active(rows).where(due).agg(F.count("*").alias("pending"))


def distinct_attr_values(rows: DataFrame, key: str) -> DataFrame:
    """Sorted distinct values of an attribute, not empty."""
    return rows.select(F.col("attrs")[key].alias("value")).where("value <> ''").distinct().orderBy("value")


def dominant_attr(members: DataFrame, key: str) -> DataFrame:
    """The most frequent value of an attribute in each ``cluster``, not empty; ties to the smaller."""
    counts = members.select("cluster", F.col("attrs")[key].alias("value")).where("value <> ''").groupBy("cluster", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def centroid(members: DataFrame, key: str = "cluster") -> DataFrame:
    """``(key, centroid)``: the mean at length 1 of a group's vectors that have the size of its first one (by created_at, id); null where none has a vector.

    Sums are per position, so they are combined before the shuffle and a group of any size is two small arrays.
    """
    have = members.where("embedding is not null")
    size = have.groupBy(key).agg(F.min_by(F.size("embedding"), F.struct("created_at", "id")).alias("_dim"))
    parts = have.join(size, key).where(F.size("embedding") == F.col("_dim")).select(key, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_v"))
    return members.select(key).distinct().join(vectors, key, "left").select(key, unit(F.col("_v")).alias("centroid"))


def seed_attr_counts(seeds: DataFrame) -> DataFrame:
    """How often each attribute pair occurs among the seeds."""
    return seeds.select(F.explode("attrs").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def affinity(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(id, affinity)``: the summed counts of the pairs that a row shares with the seeds; rows that share none have 0."""
    pairs = rows.select("id", F.explode("attrs").alias("key", "value")).join(counts, ["key", "value"])
    return rows.select("id").join(pairs.groupBy("id").agg(F.sum("n").alias("affinity")), "id", "left").na.fill(0, ["affinity"])


def files_touched(blocks: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """``(session, paths, content[, project])``: the distinct paths that a session touched, as one sorted text.

    ``blocks(session, paths array<string>)`` are lines; ``projects(prefix, project)`` names the project of the first absolute path (in order) that lies below a prefix, the longest of several.
    """
    each = blocks.select("session", F.explode("paths").alias("path")).where("path <> ''").distinct()
    out = each.groupBy("session").agg(F.array_sort(F.collect_list("path")).alias("paths")).withColumn("content", file_list_text(F.col("paths")))
    if projects is None:
        return out
    # a path has few parents: it meets prefixes by equality on them, not by comparing with all
    parents = each.where(F.startswith("path", F.lit("/"))).withColumn("parts", F.split("path", "/"))
    parents = parents.select("session", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("prefix"))
    hit = parents.join(projects, "prefix").groupBy("session").agg(F.min_by("project", F.struct("path", -F.char_length("prefix"))).alias("project"))
    return out.join(hit, "session", "left")


def layer_gauges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Live rows of layers 1 to 5, with zeros, and the number of edges beside each."""
    layers = rows.sparkSession.range(1, 1 + max(LAYERS)).select(F.col("id").cast("int").alias("layer"))
    total = edges.agg(F.count("*").alias("edges"))
    return layers.join(stats_by_layer(rows), "layer", "left").na.fill(0, ["live"]).join(F.broadcast(total), F.lit(True))


def approach_summary(results: DataFrame) -> DataFrame:
    """By approach, in order of first appearance: problems, patches, without patch, failed, and patches in percent."""
    out = results.groupBy("approach").agg(
        F.count("*").alias("problems"), F.count_if(F.col("outcome") == "patch").alias("patches"), F.count_if(F.col("outcome") == "no_patch").alias("no_patch"),
        F.count_if(~F.col("outcome").isin("patch", "no_patch")).alias("failed"), F.min("started_at").alias("first_at"),
    )
    return out.withColumn("patch_rate", F.when(F.col("problems") > 0, F.col("patches") * 100.0 / F.col("problems")).otherwise(0.0)).orderBy("first_at", "approach")


def identities_tree(files: DataFrame) -> DataFrame:
    """``(account, orgs array<struct<org, users>>)`` of stored partitions."""
    users = files.select("account", "org", "user").distinct().groupBy("account", "org").agg(F.array_sort(F.collect_set("user")).alias("users"))
    return users.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("org", "users"))).alias("orgs"))


def op_counters(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("n"))


def op_histogram(log: DataFrame, labels: list[str], seconds: str = "seconds", buckets: tuple = SEARCH_BUCKETS) -> DataFrame:
    """``(labels, le, n)``: cumulative counts by upper bound, the last one infinite, in one pass over the log."""
    sums = log.groupBy(*labels).agg(*(F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(buckets)), F.count(seconds).alias(f"_{len(buckets)}"))
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate((*buckets, float("inf")))))
    return sums.select(*labels, F.explode(pairs).alias("b")).select(*labels, "b.le", "b.n")


def attr_rows_to_map(ops: DataFrame) -> DataFrame:
    """``(mem_id, attrs)`` of attribute changes ``(mem_id, key, value, at)``: the latest of each key; a null value removes it."""
    last = ops.groupBy("mem_id", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value")).where("value is not null")
    return last.groupBy("mem_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def replace_attrs(ops: DataFrame, replaced: DataFrame) -> DataFrame:
    """Attribute changes with those left out that a later replacement ``(mem_id, at)`` of all of a row's attributes undoes."""
    last = replaced.groupBy("mem_id").agg(F.max("at").alias("_cut"))
    return ops.join(last, "mem_id", "left").where(F.col("_cut").isNull() | (F.col("at") >= F.col("_cut"))).drop("_cut")


def carry_forward(lines: DataFrame, columns: list[str], key: str = "file", order: str = "line_no") -> DataFrame:
    """Empty values take the last that is not empty of the lines before, within a file.

    Files of any length: a file is cut in blocks of :data:`BLOCK_LINES` numbers of ``order`` (whole numbers), what each block hands on is combined, a row a block, and then applied within blocks.
    """
    rows = lines.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns}).withColumn("_block", F.floor(F.col(order) / BLOCK_LINES))
    held = rows.groupBy(F.col(key).alias("_of"), F.col("_block").alias("_at")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in columns))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_of", "_at", *(F.last(f"_last_{c}", True).over(before).alias(f"_last_{c}") for c in columns))
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(held, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    return both.withColumns({c: F.coalesce(F.last(c, True).over(within), F.col(f"_last_{c}")) for c in columns}).select(*lines.columns)


def chrono_windows(rows: DataFrame, size: int = 20) -> DataFrame:
    """Rows with their ``window`` of ``size``, in order (those without a vector first, then by time); none if there are fewer than ``size``.

    Rows are dealt by ranges of that order, which Spark balances by sampling, and counted within them; so no task sorts all rows, or all of a day.
    """
    order = ["_v", "created_at", "id"]
    dealt = materialise(rows.withColumn("_v", F.col("embedding").isNotNull().cast("int")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_k", within).join(F.broadcast(parts), "_part").where(F.col("_all") >= size)
    return out.withColumn("window", F.floor((F.col("_base") + F.col("_k") - 1) / size)).drop("_v", "_part", "_k", "_base", "_all")


def even_sample(members: DataFrame, budget: int = 80_000, key: str = "cluster", text: str = "content") -> DataFrame:
    """Of each group whose texts exceed ``budget`` bytes, evenly spaced rows with both ends: ``max(2, budget * N / total)`` of N; a budget of 0 or less keeps all. An id occurs once in a group."""
    sizes = members.select(key, "created_at", "id", F.octet_length(text).alias("_bytes"))
    sums = sizes.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_N"), F.sum("_bytes").alias("_total"))
    # numbers are dealt by ranges, without the texts, so a large group takes many tasks
    rows = number_rows(sizes, [key], ["created_at", "id"], "_i").withColumn("_i", F.col("_i") - 1).join(sums, F.col(key).eqNullSafe(F.col("_of")))
    n = F.least(F.col("_N"), F.greatest(F.lit(2), F.floor(F.lit(budget) * F.col("_N") / F.col("_total"))))
    # row i is taken if some j has floor(j * (N - 1) / (n - 1)) = i: the least j that reaches i is a candidate
    j = F.ceil(F.col("_i") * (n - 1) / (F.col("_N") - 1))
    taken = F.floor(j * (F.col("_N") - 1) / (n - 1)) == F.col("_i")
    keep = (F.lit(budget) <= 0) | (F.col("_total") <= budget) | (F.col("_N") <= 2) | F.coalesce(taken, F.lit(True))
    kept = rows.where(keep).select(F.col(key).alias("_key"), F.col("id").alias("_id"))
    return members.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("id") == F.col("_id")), "left_semi")


def latest_n(rows: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """The last ``n`` rows in created order (of each group), oldest first."""
    if key is None:
        return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n).orderBy("created_at", "id")
    order = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def cluster_span(members: DataFrame) -> DataFrame:
    """When the first and the last member of each cluster (by ``pos``) were made."""
    return members.groupBy("cluster").agg(F.min_by("created_at", "pos").alias("window_start"), F.max_by("created_at", "pos").alias("window_end"))


def union_ids(*results: DataFrame) -> DataFrame:
    """Distinct ids of several results in the order in which they come: ``(id, section, rank)`` of the first place."""
    out = None
    for i, r in enumerate(results):
        part = r.select("id", F.lit(i).alias("section"), "rank")
        out = part if out is None else out.union(part)
    best = out.groupBy("id").agg(F.min(F.struct("section", "rank")).alias("_p"))
    return best.select("id", "_p.section", "_p.rank").orderBy("section", "rank", "id")


def result_projects(results: DataFrame) -> DataFrame:
    """Sorted distinct projects of results."""
    return distinct_attr_values(results, "project").withColumnRenamed("value", "project")
