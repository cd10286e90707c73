"""Scans over groups of any size: numbers of rows and last known values, without one task for a group.

A window over a key sorts all rows of that key in one task. Here rows are dealt by ranges of (key, order), so a large group lies in many partitions; each partition has a carry for each
of its groups (how many rows, which last value); carries are combined, which takes a row for each partition and group; then they are applied to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.scratch import materialise

PART, PLACE = "_scan_part", "_scan_place"


def ranged(rows: DataFrame, keys: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """``rows`` written in ranges of (keys, order), sorted, with the range's number and a place that grows along the whole order. Spark samples 100 keys a partition to cut ranges."""
    by = [*keys, *order]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return materialise(dealt.sortWithinPartitions(*by).withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}), "ranges")


def _joined(dealt: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what ``parts`` holds for their range and group; null keys meet."""
    named = parts.select(F.col(PART).alias("_scan_of"), *(F.col(k).alias(f"_scan_key_{i}") for i, k in enumerate(keys)), *(c for c in parts.columns if c not in (PART, *keys)))
    on = F.col(PART) == F.col("_scan_of")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_scan_key_{i}"))
    return dealt.join(named, on)


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """``rows`` with their number within the group, from 1, as ``long``. Ties of ``order`` are numbered in any order; null keys are a group."""
    dealt = ranged(rows, keys, order)
    parts = dealt.groupBy(PART, *keys).agg(F.min(PLACE).alias("_scan_first"), F.count("*").alias("_scan_n"))
    parts = parts.withColumn("_scan_base", F.coalesce(F.sum("_scan_n").over(_before(keys)), F.lit(0)))
    number = F.col(PLACE) - F.col("_scan_first") + F.col("_scan_base") + 1
    return _joined(dealt, parts, keys).select(*rows.columns, number.alias(name))


def fill_forward(rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """``rows`` whose nulls in ``columns`` take the last value before them in the group, if any."""
    dealt = ranged(rows, keys, order)
    held = dealt.groupBy(PART, *keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(PLACE))).alias(c) for c in columns))
    carried = held.select(PART, *keys, *(F.last(c, True).over(_before(keys)).alias(f"_scan_{c}") for c in columns))
    within = Window.partitionBy(PART, *keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(dealt, carried, keys).withColumns({c: F.coalesce(F.last(c, True).over(within), F.col(f"_scan_{c}")) for c in columns}).select(*rows.columns)
