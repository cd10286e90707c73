"""The store as a log of changes, folded into a snapshot.

``ops`` has a row per change: ``(id, op, at, layer, content, attrs, key, value, number, vector)``. Folding groups by id once; every fold is a maximum, sum or latest value, so the order of equal times
doesn't matter and a hot row is combined before the shuffle. States of parts of a log merge into the state of the whole, so a stored state and the ops since give the snapshot.

store: layer, content, attrs. touch. attr: key, value (null removes). replace_attrs: attrs. access. get. importance, valence: number (a null valence is a failed parse). embed: vector, value (model). tombstone. pushed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.replies import backdate, clamp_valence
from strataspark.functions.text import content_hash
from strataspark.schema import DEFAULT_IMPORTANCE, base_decay

OPS = "id string, op string, at timestamp, layer int, content string, attrs map<string,string>, key string, value string, number double, vector array<float>"
#: Fixed value: failed parses after which a row counts as scored.
MAX_ATTEMPTS = 3


def ops_of(df: DataFrame, op: str, **columns) -> DataFrame:
    """Op rows from a table: named columns (or expressions) fill the log's, the rest is null."""
    names = [c.strip().split(" ", 1) for c in OPS.split(", ")]
    given = {"op": F.lit(op)} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*(given[n].cast(t).alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in names))


def resolve_stores(ops: DataFrame, revive: bool = False) -> DataFrame:
    """The log with stores of a text that an earlier store has turned into touches and attribute changes of that row.

    The first store of a content hash (time, then id) makes the row, dead or not; with ``revive`` a store after the row's tombstone clears it. A store with a bad ``created_at`` attribute, without content or outside the layers 1 to 5 is left out.
    """
    ok = F.coalesce(F.col("layer").between(1, 5) & (F.col("content") != ""), F.lit(False)) & ~F.coalesce(backdate(F.col("attrs"))["bad"], F.lit(False))
    stores = ops.where("op = 'store'").where(ok).withColumn("_hash", content_hash(F.col("content")))
    firsts = stores.groupBy("_hash").agg(F.min(F.struct("at", "id")).alias("_first"))
    known = stores.join(firsts, "_hash")
    is_first = (F.col("at") == F.col("_first.at")) & (F.col("id") == F.col("_first.id"))
    made = known.where(is_first).dropDuplicates(["id", "_hash"]).drop("_hash", "_first")
    later = known.where(~is_first).withColumn("id", F.col("_first.id")).drop("_hash", "_first")
    null = lambda kind: F.lit(None).cast(kind)
    touches = later.withColumns({"op": F.lit("revive" if revive else "touch"), "content": null("string"), "layer": null("int"), "attrs": null("map<string,string>")})
    pairs = later.where("size(attrs) > 0").select("*", F.explode("attrs").alias("_k", "_v")).where("_k <> 'created_at'")
    pairs = pairs.withColumns({"op": F.lit("attr"), "key": F.col("_k"), "value": F.col("_v"), "content": null("string"), "layer": null("int"), "attrs": null("map<string,string>")}).drop("_k", "_v")
    return ops.where("op <> 'store'").unionByName(made).unionByName(touches).unionByName(pairs)


class State(NamedTuple):
    """A folded log that can be merged with another one's: every column is a maximum, a minimum or a sum.

    ``ids`` a row per id that ops name, ``changes`` the latest value per (id, key), ``texts`` per content hash the first store and the last, ``pairs`` the latest attribute per (hash, key) of later stores.
    """

    ids: DataFrame
    changes: DataFrame
    texts: DataFrame
    pairs: DataFrame


#: How the columns of ``ids`` merge: all but these are maxima.
SUMS = ("access_count", "gets", "valence_attempts")


def fold_state(ops: DataFrame) -> State:
    """The state of a log, or of any part of one."""
    when = lambda *names: F.col("op").isin(*names)
    at = lambda *names: F.max(F.when(when(*names), F.col("at")))
    latest = lambda ok, value: F.max(F.when(ok, F.struct("at", value.alias("v"))))
    ids = ops.where("op <> 'store' and id is not null").groupBy("id").agg(
        at("touch", "revive", "attr", "replace_attrs", "valence", "importance").alias("updated_at"),
        F.count_if(when("access", "get")).alias("access_count"),
        F.count_if(when("get")).alias("gets"),
        at("access", "get").alias("accessed_at"),
        latest(when("importance"), F.col("number")).alias("importance"),
        latest(when("valence") & F.col("number").isNotNull(), F.col("number")).alias("valence"),
        F.count_if(when("valence") & F.col("number").isNull()).alias("valence_attempts"),
        F.max(F.when(when("embed"), F.struct("at", F.col("value").alias("model"), "vector"))).alias("embed"),
        at("tombstone").alias("dead_at"),
        at("revive").alias("alive_at"),
        at("pushed").alias("pushed_at"),
        F.max(F.when(when("replace_attrs"), F.struct("at", F.to_json("attrs").alias("json")))).alias("replaced"),
    )
    changes = ops.where("op = 'attr'").groupBy("id", "key").agg(F.max(F.struct("at", "value")).alias("c"))
    ok = F.coalesce(F.col("layer").between(1, 5) & (F.col("content") != ""), F.lit(False)) & ~F.coalesce(backdate(F.col("attrs"))["bad"], F.lit(False))
    stores = ops.where("op = 'store'").where(ok).select(content_hash(F.col("content")).alias("hash"), F.struct("at", "id", "layer", "content", F.to_json("attrs").alias("attrs")).alias("s"))
    return State(ids, changes, *_texts(stores))


def _texts(stores: DataFrame, pairs: DataFrame | None = None, last: str = "s") -> tuple[DataFrame, DataFrame]:
    """``texts`` and ``pairs`` of stores (hash, s), or of the first stores of several parts: the attributes of a store that isn't the first are changes."""
    place = lambda c: F.struct(f"{c}.at", f"{c}.id")
    texts = stores.groupBy("hash").agg(F.min("s").alias("first"), F.max(place(last)).alias("last"))
    later = stores.join(texts.select("hash", "first"), "hash").where(place("s") != place("first"))
    more = later.select("hash", F.explode(F.from_json("s.attrs", "map<string,string>")).alias("key", "value"), F.col("s.at").alias("at")).where("key <> 'created_at'")
    more = more.select("hash", "key", F.struct("at", "value").alias("c"))
    more = more if pairs is None else more.unionByName(pairs)
    return texts, more.groupBy("hash", "key").agg(F.max("c").alias("c"))


def merge_states(a: State, b: State) -> State:
    """The state of two logs together, whichever is the later."""
    ids = a.ids.unionByName(b.ids)
    ids = ids.groupBy("id").agg(*((F.sum if c in SUMS else F.max)(c).alias(c) for c in ids.columns if c != "id"))
    changes = a.changes.unionByName(b.changes).groupBy("id", "key").agg(F.max("c").alias("c"))
    stores = a.texts.unionByName(b.texts).select("hash", F.col("first").alias("s"), "last")
    return State(ids, changes, *_texts(stores, a.pairs.unionByName(b.pairs), "last"))


def state_rows(state: State, revive: bool = False) -> DataFrame:
    """The snapshot (columns of MEMORIES but for agent and pushed state kept in attributes) that a state stands for.

    The first store of a text (time, then id) makes its row; later ones touch it and change its attributes, and with ``revive`` clear its tombstone. What ops say of ids without a row has no effect.
    """
    stored = state.texts.select("hash", F.col("first.id").alias("id"), "first", F.when(F.col("last") != F.struct("first.at", "first.id"), F.col("last.at")).alias("touched_at"))
    rows = stored.groupBy("id").agg(
        F.max("first.layer").alias("layer"), F.max("first.content").alias("content"), F.min("first.at").alias("stored_at"), F.max("first.at").alias("stored_last"), F.min_by("first.attrs", F.struct("first.at", "first.attrs")).alias("_attrs"), F.max("touched_at").alias("touched_at"),
    )
    of_texts = state.pairs.join(stored.select("hash", "id"), "hash").select("id", "key", "c")
    changes = state.changes.unionByName(of_texts).groupBy("id", "key").agg(F.max("c").alias("c"))
    changes = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "c.at", "c.value"))).alias("_changes"))
    wide = rows.join(state.ids, "id", "left").join(changes, "id", "left")
    early = backdate(F.from_json("_attrs", "map<string,string>"))
    base = F.coalesce(F.from_json(F.col("replaced.json"), "map<string,string>"), early["attrs"], F.create_map().cast("map<string,string>"))
    own = F.filter(F.coalesce("_changes", F.array().cast("array<struct<key: string, at: timestamp, value: string>>")), lambda c: F.col("replaced").isNull() | (c["at"] >= F.col("replaced.at")))
    over = F.map_from_entries(F.transform(own, lambda c: F.struct(c["key"], c["value"])))
    attrs = F.map_filter(F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over), lambda k, v: v.isNotNull())
    gets, attempts = (F.coalesce(c, F.lit(0)) for c in ("gets", "valence_attempts"))
    scored = F.col("valence").isNotNull() | (attempts >= MAX_ATTEMPTS)
    alive = F.greatest("alive_at", "touched_at") if revive else F.col("alive_at")
    return wide.select(
        "id", "layer", "content", content_hash(F.col("content")).alias("content_hash"), F.coalesce("importance.v", F.lit(DEFAULT_IMPORTANCE)).cast("float").alias("importance"),
        F.coalesce("access_count", F.lit(0)).cast("int").alias("access_count"), F.coalesce(early["created_at"], F.col("stored_at")).alias("created_at"),
        F.greatest("updated_at", "stored_last", "touched_at").alias("updated_at"), F.greatest("accessed_at", "stored_last").alias("last_accessed_at"),
        F.when(F.col("layer") > 1, base_decay(F.col("layer")) / (1 + gets)).otherwise(base_decay(F.col("layer"))).cast("float").alias("decay_rate"),
        (1.0 + gets).cast("float").alias("stability"), attrs["source"].alias("source"), attrs["agent"].alias("agent"),
        F.when(alive.isNull() | (alive < F.col("dead_at")), F.col("dead_at")).alias("compacted_at"),
        F.coalesce(clamp_valence(F.col("valence.v")), F.lit(0.0)).cast("float").alias("valence"), scored.alias("valence_scored"), attempts.cast("int").alias("valence_attempts"),
        F.col("embed.model").alias("embedding_model"), "pushed_at", F.col("embed.vector").alias("embedding"), attrs.alias("attrs"),
    )


def fold_ops(ops: DataFrame, revive: bool = False) -> DataFrame:
    """The current snapshot of a log of changes; see :func:`state_rows`."""
    return state_rows(fold_state(ops), revive)


def usable_vectors(rows: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors of the current model and length; others count as missing until they are made again."""
    return rows.where((F.col("embedding_model") == model) & (F.size("embedding") == dim)).select("id", "embedding", F.col("embedding_model").alias("model"))


def mark_pushed(rows: DataFrame, now) -> DataFrame:
    """Live rows that aren't from the server get the time of the push."""
    due = F.col("compacted_at").isNull() & (F.coalesce("source", F.lit("")) != "server")
    return rows.withColumn("pushed_at", F.when(due, F.lit(now).cast("timestamp")).otherwise(F.col("pushed_at")))


def soft_delete(ids: DataFrame, now) -> DataFrame:
    """Tombstone ops for ids."""
    return ops_of(ids, "tombstone", id="id", at=F.lit(now).cast("timestamp"))


def tag(ids: DataFrame, attrs: dict[str, str], now) -> DataFrame:
    """Attribute ops for ids."""
    pairs = F.explode(F.create_map(*(F.lit(x) for kv in attrs.items() for x in kv))).alias("key", "value")
    return ops_of(ids.select("id", pairs), "attr", id="id", at=F.lit(now).cast("timestamp"), key="key", value="value")


def mark_accessed(results: DataFrame, now) -> DataFrame:
    """Access ops for what a search returned."""
    return ops_of(results, "access", id="id", at=F.lit(now).cast("timestamp"))


def newest_snapshots(catalogue: DataFrame, keep: int = 7) -> DataFrame:
    """Snapshots ``(ts, path)`` with whether they are kept: the newest ``keep``."""
    return catalogue.withColumn("kept", F.row_number().over(Window.orderBy(F.col("ts").desc())) <= keep)
