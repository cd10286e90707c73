"""Predicates and small projections over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.schema import DEFAULT_IMPORTANCE


def active(rows: DataFrame) -> DataFrame:
    """Rows without a tombstone."""
    return rows.where(F.col("compacted_at").isNull())


def layers_in(rows: DataFrame, layers: list[int] | None) -> DataFrame:
    """Rows of these layers; none given means all."""
    return rows.where(F.col("layer").isin(list(layers))) if layers else rows


def since(rows: DataFrame, at=None, column: str = "created_at") -> DataFrame:
    return rows if at is None else rows.where(F.col(column) >= F.lit(at))


def partition_since(rows: DataFrame, day=None, column: str = "date") -> DataFrame:
    """Partitions from a day on; rows without one pass."""
    return rows if day is None else rows.where(F.col(column).isNull() | (F.col(column) >= F.lit(day)))


def exclude_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.coalesce(F.col("source"), F.lit("")) != source)


def valence_between(rows: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        rows = rows.where(F.col("valence") >= low)
    return rows if high is None else rows.where(F.col("valence") <= high)


def has_all_tags(rows: DataFrame, tags: list[str], attrs: str = "attrs") -> DataFrame:
    """Rows whose comma list ``tags`` has every one of these."""
    have = F.transform(F.split(F.coalesce(F.col(attrs)["tags"], F.lit("")), ","), F.trim)
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, tags)), have)) == 0) if tags else rows


def matches_attrs(attrs: Column, wanted: dict[str, str]) -> Column:
    """All pairs are there; a missing key counts as the empty text."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.coalesce(attrs[k], F.lit("")) == v)
    return out


def attrs_match(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return rows.where(matches_attrs(F.col("attrs"), wanted))


def domain_filter(rows: DataFrame, domain: str) -> DataFrame:
    """Rows of this domain and rows without any; an empty domain keeps all."""
    own = F.col("attrs")["domain"]
    return rows.where(own.isNull() | (own == "") | (own == domain)) if domain else rows


def cwd_filter(rows: DataFrame, cwd: str) -> DataFrame:
    return rows.where(F.col("attrs")["cwd"] == cwd) if cwd else rows


def by_attribute(rows: DataFrame, key: str, value: str, limit: int | None = None) -> DataFrame:
    """Live rows with an attribute, newest first."""
    out = active(rows).where(F.col("attrs")[key] == value).orderBy(F.col("created_at").desc(), "id")
    return out if limit is None else out.limit(limit)


def list_from_source(rows: DataFrame, source_file: str, limit: int = 500) -> DataFrame:
    """Live rows that came from one file."""
    return by_attribute(rows, "source_file", source_file, limit)


def get_by_id_or_prefix(rows: DataFrame, key: str) -> DataFrame:
    """The row of a full id (36 characters) or of a prefix that only one id has; raises for none and for several."""
    found = rows.where(F.col("id") == key if len(key) == 36 else F.startswith("id", F.lit(key)))
    count = found.limit(2).count()
    if count != 1:
        raise LookupError(f"{'no' if not count else 'more than one'} memory for {key!r}")
    return found


def prefix_lookup(rows: DataFrame, prefix: str) -> DataFrame:
    """All rows whose id begins so."""
    return rows.where(F.startswith("id", F.lit(prefix)))


def get_by_hash(rows: DataFrame, content_hash: str) -> DataFrame:
    """Rows of a hash, dead ones too."""
    return rows.where(F.col("content_hash") == content_hash)


def _oldest(rows: DataFrame, limit: int | None) -> DataFrame:
    out = rows.orderBy("created_at", "id")
    return out if limit is None else out.limit(limit)


def list_unscored(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return _oldest(active(rows).where(~F.coalesce(F.col("valence_scored"), F.lit(False))), limit)


def list_unimportant(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return _oldest(active(rows).where(F.col("importance") == DEFAULT_IMPORTANCE), limit)


def skip_authors(rows: DataFrame, logins: list[str], column: str = "author") -> DataFrame:
    return rows.where(~F.lower(column).isin([x.lower() for x in logins])) if logins else rows


def classify_pr(state: Column, merged_at: Column) -> Column:
    """``merged`` (with a time), ``rejected`` or ``open``."""
    return F.when((state == "MERGED") & (F.coalesce(merged_at, F.lit("")) != ""), "merged").when(state == "CLOSED", "rejected").otherwise("open")


def compact_view(results: DataFrame) -> DataFrame:
    """What a list of results shows."""
    return results.select(
        "id", "layer", "score", "parts", "valence", F.coalesce(F.col("attrs")["source"], F.lit("")).alias("source"), F.coalesce(F.col("attrs")["project"], F.lit("")).alias("project")
    )


def filter_drive_listing(files: DataFrame, mime: str, modified_after=None, include: list[str] = (), exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """Documents of a kind, changed after a time, whose names hold some include and no exclude; newest first."""
    out = files.where(F.col("mime_type") == mime)
    if modified_after is not None:
        out = out.where(F.col("modified_time") > F.lit(modified_after))
    if include:
        out = out.where(F.exists(F.array(*map(F.lit, include)), lambda p: F.contains("name", p)))
    for p in exclude:
        out = out.where(~F.contains("name", F.lit(p)))
    out = out.orderBy(F.col("modified_time").desc(), "id")
    return out if limit is None else out.limit(limit)
