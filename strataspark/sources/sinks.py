"""Writers: partitioned memories, exports, sidecars, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.filters import active, exclude_source
from strataspark.operators.state import newest_snapshots
from strataspark.schema import EDGES, MEMORIES


def scope_of(layer: Column, user: Column, team: Column) -> Column:
    """Where a row of a layer is kept: 1, 2 with the user, 3 shared, 4 with the team or shared, else with the user."""
    return (
        F.when(layer == 3, "shared").when((layer == 4) & (F.coalesce(team, F.lit("")) != ""), F.concat(F.lit("teams/"), team)).when(layer == 4, "shared").otherwise(F.concat(F.lit("users/"), user))
    )


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Append rows ``(account, org, user, team, ...)`` below account, org, scope, layer and day, one file a task and partition.

    Rows are dealt by partition and a hash of the id, so a hot partition is written by many tasks.
    """
    placed = rows.withColumns({"scope": scope_of(F.col("layer"), F.col("user"), F.col("team")), "date": F.to_date("created_at")}).drop("user", "team")
    keys = ["account", "org", "scope", "layer", "date"]
    placed.repartition(*keys, F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy(*keys).option("compression", "zstd").mode("append").parquet(path)


def sidecar_rows(rows: DataFrame, now) -> DataFrame:
    """What the attribute sidecar gets: every row's attributes, accepted or not."""
    return rows.select("account", "org", "content_hash", F.to_json("attrs").alias("attrs_json"), F.lit(now).cast("timestamp").alias("written_at"))


def write_export(rows: DataFrame, edges: DataFrame, path: str, now, lines: int = 1000, without_source: str | None = None) -> None:
    """Live rows by layer and edges as JSON lines in files of ``lines``, with a manifest and counts by layer."""
    live = active(rows)
    live = exclude_source(live, without_source) if without_source else live
    live.write.option("maxRecordsPerFile", lines).option("compression", "none").partitionBy("layer").mode("overwrite").json(f"{path}/memories")
    edges.write.option("maxRecordsPerFile", lines).mode("overwrite").json(f"{path}/edges")
    counts = live.groupBy("layer").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("memory_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers"))
    manifest = total.join(edges.agg(F.count("*").alias("edge_count")), F.lit(True)).withColumns({"exported_at": F.lit(now).cast("timestamp"), "chunk_size": F.lit(lines)})
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_snapshot(rows: DataFrame, path: str, ts: str) -> None:
    """A full copy named by its time, ``YYYYMMDD-HHMMSS``."""
    rows.write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/ts={ts}")


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``(ts, path)`` of the snapshots in a folder that are complete, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    done = [n[3:] for n in names if n.startswith("ts=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.createDataFrame([(t, f"{path}/ts={t}") for t in sorted(done)], "ts string, path string")


def prune_snapshots(spark: SparkSession, path: str, keep: int = 7) -> list[str]:
    """Delete all but the newest ``keep``; returns what went."""
    gone = [r.path for r in newest_snapshots(list_snapshots(spark, path), keep).where("not kept").collect()]
    for p in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def restore_snapshot(spark: SparkSession, path: str, ts: str, current: DataFrame, now_ts: str) -> DataFrame:
    """The rows of a snapshot, after the current rows have been kept as the snapshot ``now_ts``."""
    write_snapshot(current, path, now_ts)
    return spark.read.schema(MEMORIES).parquet(f"{path}/ts={ts}")


def _mark(spark: SparkSession, path: str):
    """The file system and the success mark of a folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()), mark


def write_backup(rows: DataFrame, edges: DataFrame, path: str, ts: str) -> None:
    """Rows and edges as one snapshot ``ts``: the edges are those whose both ends are among the rows as written, so what is read back fits together whatever is stored meanwhile.

    The mark that :func:`list_snapshots` looks for comes last. Until then the backup doesn't count, and one that a crash left unfinished is written over; a whole one is never.
    """
    spark, to = rows.sparkSession, f"{path.rstrip('/')}/ts={ts}"
    system, mark = _mark(spark, to)
    if system.exists(mark):
        raise FileExistsError(to)
    rows.write.option("compression", "zstd").mode("overwrite").parquet(f"{to}/memories")
    have = spark.read.schema(rows.schema).parquet(f"{to}/memories").select("id").distinct()
    whole = edges.join(have.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(have.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    whole.select(*edges.columns).write.option("compression", "zstd").mode("overwrite").parquet(f"{to}/edges")
    system.create(mark, True).close()


def read_backup(spark: SparkSession, path: str, ts: str, rows_schema=MEMORIES, edges_schema=EDGES) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) of a backup that is whole."""
    of = f"{path.rstrip('/')}/ts={ts}"
    system, mark = _mark(spark, of)
    if not system.exists(mark):
        raise FileNotFoundError(f"no whole backup at {of}")
    return spark.read.schema(rows_schema).parquet(f"{of}/memories"), spark.read.schema(edges_schema).parquet(f"{of}/edges")


def restore_backup(spark: SparkSession, path: str, ts: str, rows: DataFrame, edges: DataFrame, now_ts: str) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) of a backup, after the current ones have been kept as the backup ``now_ts``."""
    found = read_backup(spark, path, ts, rows.schema, edges.schema)
    write_backup(rows, edges, path, now_ts)
    return found
