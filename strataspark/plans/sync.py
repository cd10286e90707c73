"""Push and pull between stores, as jobs from table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.filters import active, exclude_source
from strataspark.operators.joins import lww_upsert, overlay_attrs, push_counts, push_dedup
from strataspark.operators.state import mark_pushed
from strataspark.scratch import materialise
from strataspark.sources.readers import read_partitioned
from strataspark.sources.sinks import sidecar_rows, write_partitioned


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sync_push(rows: DataFrame, path: str, account: str, org: str, user: str, team: str, now) -> tuple[DataFrame, DataFrame]:
    """(counts, rows marked as pushed): live rows that aren't from the server go to the accepted partitions, unless their hash is there.

    The sidecar gets everybody's attributes. ``path`` holds ``memories`` and ``sidecar``.
    """
    spark = rows.sparkSession
    live = exclude_source(active(rows), "server").withColumns({"account": F.lit(account), "org": F.lit(org), "user": F.lit(user), "team": F.lit(team)})
    stored = f"{path}/memories"
    known = spark.read.parquet(stored).select("account", "org", "content_hash") if _exists(spark, stored) else live.select("account", "org", "content_hash").limit(0)
    pushed = materialise(push_dedup(live, known), "pushed")
    write_partitioned(pushed.where("accepted").drop("accepted"), stored)
    sidecar_rows(live, now).write.mode("append").parquet(f"{path}/sidecar")
    return push_counts(pushed), mark_pushed(rows, now)


def sync_pull(rows: DataFrame, path: str, account: str, org: str, scopes: list[str] | None = None, layers: list[int] | None = None, at=None) -> DataFrame:
    """The store after pulling what was accepted since ``at``: attributes from the sidecar, source ``server``, vectors left behind, newer rows win. ``action`` tells what happened to each row."""
    spark = rows.sparkSession
    found = read_partitioned(spark, f"{path}/memories", account, org, scopes, layers, at)
    found = found.withColumn("account", F.col("account").cast("string")).withColumn("org", F.col("org").cast("string"))
    found = overlay_attrs(found, spark.read.parquet(f"{path}/sidecar"))
    found = found.withColumns({"source": F.lit("server"), "embedding": F.lit(None).cast("array<float>")})
    return lww_upsert(rows, found.select(*rows.columns))
