"""The store's operators as queries over the test tables, each with the same in SQL.

Documents stand for memories, embeddings for vectors, benchmark items for search queries, conversations for transcripts, line items for graph edges, events for operation logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions import replies, scores, text
from strataspark.operators import aggregates, angles, cluster, filters, graph, joins, knn_cells, retrieval, state, text_index
from strataspark.plans import search as plans
from strataspark.plans.compact import compaction_trigger, dry_run
from strataspark.schema import layer_name
from strataspark.sources import readers
from strataspark.scratch import new_path
from strataspark.sources.sinks import read_backup, scope_of, write_backup

NOW = "2024-01-02 00:00:00"
QUERIES, ORACLES = {}, {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """The documents as stored rows."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("text").alias("content"), "lang", F.col("source").alias("src"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("n"), (F.col("quality") - F.col("toxic")).cast("float").alias("valence"))
    d = d.join(labels, "n", "left")
    made = F.timestamp_micros(F.lit(1704067200000000) + F.col("n") * 60000000)
    hours = lambda c: F.make_dt_interval(F.lit(0), c)
    updated = made + hours((F.col("n") % 7).cast("int"))
    tags = F.when(F.col("n") % 3 == 0, F.concat("lang", F.lit(",t"), (F.col("n") % 4).cast("string")))
    attrs = F.map_filter(F.create_map(F.lit("source"), F.col("src"), F.lit("lang"), F.col("lang"), F.lit("project"), F.concat(F.lit("p"), (F.col("n") % 5).cast("string")), F.lit("tags"), tags), lambda k, v: v.isNotNull())
    out = d.select(
        F.col("n").cast("string").alias("id"), (F.col("n") % 5 + 1).cast("int").alias("layer"), "content", F.sha2("content", 256).alias("content_hash"), (F.col("n") % 10 + 1).cast("float").alias("importance"),
        (F.col("n") % 13).cast("int").alias("access_count"), made.alias("created_at"), updated.alias("updated_at"), F.when(F.col("n") % 11 == 0, made + hours(F.lit(24))).alias("compacted_at"), F.col("src").alias("source"),
        "valence", F.col("valence").isNotNull().alias("valence_scored"), F.when(F.col("n") % 4 == 0, updated - hours(F.lit(1))).when(F.col("n") % 4 == 1, updated + hours(F.lit(1))).alias("pushed_at"), attrs.alias("attrs"),
    )
    if not vectors:
        return out
    return out.join(vector_table(spark, sf_dir), "id", "left")


def vector_table(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def edge_table(spark, sf_dir) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "derived_from").otherwise("relates_to")
    one = items.select(part.alias("from_id"), supplier.alias("to_id"), kind.alias("edge_type"), (F.col("l_linenumber") / 10.0).alias("weight"))
    two = items.where("l_linenumber = 1").select(supplier.alias("from_id"), part.alias("to_id"), F.lit("compacted_from").alias("edge_type"), F.lit(0.5).alias("weight"))
    return one.union(two).groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").cast("float").alias("weight")).withColumn("created_at", F.lit(NOW).cast("timestamp"))


def query_table(spark, sf_dir) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items.join(vectors, "item_id", "left").select(F.col("item_id").alias("query_id"), "query", "embedding")


MEM = """
mem AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS n, CAST(d.doc_id % 5 + 1 AS INTEGER) AS layer, d.text AS content, sha256(d.text) AS content_hash, CAST(d.doc_id % 10 + 1 AS FLOAT) AS importance,
    CAST(d.doc_id % 13 AS INTEGER) AS access_count, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) + to_hours(CAST(d.doc_id % 7 AS INTEGER)) AS updated_at,
    CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) END AS compacted_at,
    d.source, d.lang, 'p' || CAST(d.doc_id % 5 AS VARCHAR) AS project, CASE WHEN d.doc_id % 3 = 0 THEN d.lang || ',t' || CAST(d.doc_id % 4 AS VARCHAR) END AS tags,
    CAST(l.quality - l.toxic AS FLOAT) AS valence
  FROM documents d LEFT JOIN labels l USING (doc_id)
), live AS (SELECT * FROM mem WHERE compacted_at IS NULL)"""

EDG = """
edges AS (
  SELECT from_id, to_id, edge_type, CAST(max(weight) AS FLOAT) AS weight FROM (
    SELECT 'p' || l_partkey AS from_id, 's' || l_suppkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'derived_from' ELSE 'relates_to' END AS edge_type, l_linenumber / 10.0 AS weight FROM lineitem
    UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'compacted_from', 0.5 FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL
)"""

QRY = """
qry AS (
  SELECT item_id AS query_id, text AS query, CAST(embedding AS DOUBLE[]) AS qv
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# counts


@query(f"WITH {MEM} SELECT layer, count(*) AS live FROM live GROUP BY layer")
def stats_by_layer(spark, sf_dir):
    return aggregates.stats_by_layer(memories(spark, sf_dir))


@query(f"WITH {MEM}, {EDG} SELECT (SELECT count(*) FROM live) AS live, (SELECT map_from_entries(list((layer, n) ORDER BY layer)) FROM (SELECT layer, count(*) AS n FROM live GROUP BY layer)) AS by_layer, (SELECT count(*) FROM edges) AS edges")
def stats(spark, sf_dir):
    return aggregates.stats(memories(spark, sf_dir), edge_table(spark, sf_dir))


@query(f"WITH {MEM} SELECT layer, count(*) AS live, min(created_at) AS oldest FROM live GROUP BY layer")
def oldest_by_layer(spark, sf_dir):
    return aggregates.oldest_by_layer(memories(spark, sf_dir))


@query(f"WITH {MEM}, {EDG} SELECT CAST(r.layer AS INTEGER) AS layer, coalesce(n, 0) AS live, (SELECT count(*) FROM edges) AS edges FROM range(1, 6) r(layer) LEFT JOIN (SELECT layer, count(*) AS n FROM live WHERE layer <> 9 GROUP BY layer) USING (layer)")
def layer_gauges(spark, sf_dir):
    return aggregates.layer_gauges(memories(spark, sf_dir), edge_table(spark, sf_dir))


@query(f"WITH {MEM} SELECT count(*) AS pending FROM live WHERE source <> 'server' AND n % 4 <> 1")
def pending_push(spark, sf_dir):
    return aggregates.pending_push(memories(spark, sf_dir))


@query(f"WITH {MEM} SELECT DISTINCT tags AS value FROM mem WHERE tags IS NOT NULL")
def distinct_attr_values(spark, sf_dir):
    return aggregates.distinct_attr_values(memories(spark, sf_dir), "tags")


@query(f"WITH {MEM} SELECT layer, count(*) AS live, CASE WHEN layer = 5 THEN 50 END AS threshold, CASE WHEN layer = 5 THEN count(*) > 50 END AS due FROM live GROUP BY layer")
def compaction_dry_run(spark, sf_dir):
    return dry_run(memories(spark, sf_dir))


@query(f"WITH {MEM} SELECT count(*) AS live, min(created_at) AS oldest, count(*) > 50 OR min(created_at) < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AS due FROM live WHERE layer = 5", "compaction_trigger")
def compaction_due(spark, sf_dir):
    return compaction_trigger(memories(spark, sf_dir), NOW)


# filters


@query(f"WITH {MEM} SELECT id, created_at FROM live WHERE tags = 'en,t0'")
def by_attribute(spark, sf_dir):
    return filters.by_attribute(memories(spark, sf_dir), "tags", "en,t0").select("id", "created_at")


@query(f"WITH {MEM} SELECT id FROM mem WHERE list_has_all(string_split(coalesce(tags, ''), ','), ['en', 't0'])")
def has_all_tags(spark, sf_dir):
    return filters.has_all_tags(memories(spark, sf_dir), ["en", "t0"]).select("id")


@query(f"WITH {MEM} SELECT id, project FROM mem WHERE project = 'p3' AND lang = 'de'")
def attrs_match(spark, sf_dir):
    return filters.attrs_match(memories(spark, sf_dir), {"project": "p3", "lang": "de"}).select("id", F.col("attrs")["project"].alias("project"))


@query(f"WITH {MEM} SELECT id, layer FROM mem WHERE n % 3 <> 0 OR lang = 'fr'")
def domain_filter(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("attrs", F.map_filter(F.create_map(F.lit("domain"), F.when(F.col("attrs")["tags"].isNotNull(), F.col("attrs")["lang"])), lambda k, v: v.isNotNull()))
    return filters.domain_filter(rows, "fr").select("id", "layer")


@query(f"WITH {MEM} SELECT id, content_hash FROM mem WHERE starts_with(id, '12')")
def prefix_lookup(spark, sf_dir):
    return filters.prefix_lookup(memories(spark, sf_dir), "12").select("id", "content_hash")


@query(f"WITH {MEM} SELECT id FROM mem WHERE content_hash = (SELECT content_hash FROM mem WHERE n = 3)")
def lookup_by_hash(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return filters.get_by_hash(rows, rows.where("id = '3'").first().content_hash).select("id")


@query(f"WITH {MEM} SELECT id, layer, valence FROM live WHERE layer IN (2, 4) AND valence >= 0 AND valence <= 1 AND created_at >= TIMESTAMP '2024-01-01 01:00:00' AND source <> 'src0'")
def filtered_scan(spark, sf_dir):
    rows = filters.since(filters.layers_in(filters.active(memories(spark, sf_dir)), [2, 4]), "2024-01-01 01:00:00")
    return filters.exclude_source(filters.valence_between(rows, 0, 1), "src0").select("id", "layer", "valence")


@query(f"WITH {MEM} SELECT id, created_at FROM live WHERE valence IS NULL")
def unscored(spark, sf_dir):
    return filters.list_unscored(memories(spark, sf_dir)).select("id", "created_at")


@query(f"WITH {MEM} SELECT id FROM live WHERE importance = 5")
def unimportant(spark, sf_dir):
    return filters.list_unimportant(memories(spark, sf_dir)).select("id")


@query(f"WITH {MEM} SELECT id, created_at FROM live WHERE tags IS NULL")
def untagged(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return joins.list_untagged(rows, joins.attributes_of(rows)).select("id", "created_at")


@query(f"WITH {MEM} SELECT id, created_at FROM live WHERE n NOT IN (SELECT vec_id FROM embeddings) OR n % 2 = 1")
def unembedded(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("embedding_model", F.when(F.col("access_count") >= 0, F.when(F.pmod(F.col("id").cast("long"), F.lit(2)) == 1, "old").otherwise("new")))
    return joins.list_unembedded(rows, vector_table(spark, sf_dir), "new").select("id", "created_at")


@query(f"WITH {MEM} SELECT layer, CASE layer WHEN 1 THEN 'core' WHEN 2 THEN 'principles' WHEN 3 THEN 'knowledge' WHEN 4 THEN 'workspace' ELSE 'observations' END AS layer_name, count(*) AS n FROM mem GROUP BY layer")
def layer_names(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n")).withColumn("layer_name", layer_name(F.col("layer")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'merged' WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'open' END AS outcome, (o_orderstatus = 'F' AND o_orderpriority < '3') OR o_orderstatus = 'O' AS decided FROM orders")
def pr_outcomes(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "O", "CLOSED").otherwise("OPEN").alias("state"), F.when(F.col("o_orderpriority") < "3", "2024").otherwise("").alias("merged_at")
    )
    return joins.pr_outcomes(o).select("id", "outcome", "decided")


# joins and state


@query(f"WITH {MEM} SELECT id, map_from_entries(list_filter([('lang', lang), ('project', project), ('source', source), ('tags', tags)], lambda e: e[2] IS NOT NULL)) AS attrs FROM mem")
def with_attributes(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return joins.with_attributes(rows.select("id"), joins.attributes_of(rows)).select("id", "attrs")


@query(f"WITH {MEM} SELECT id, len(embedding) AS dim FROM mem LEFT JOIN embeddings ON vec_id = n")
def with_embeddings(spark, sf_dir):
    out = joins.with_embeddings(memories(spark, sf_dir), vector_table(spark, sf_dir))
    return out.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("dim"))


@query(f"WITH {MEM} SELECT arg_min(id, (created_at, id)) AS id, content_hash, count(*) AS stores, max(created_at) AS updated_at FROM mem GROUP BY content_hash")
def dedup_by_hash(spark, sf_dir):
    ops = state.ops_of(memories(spark, sf_dir), "store", id="id", at="created_at", layer="layer", content="content", attrs="attrs")
    log = state.resolve_stores(ops)
    per = log.groupBy("id").agg(F.count_if(F.col("op").isin("store", "touch")).alias("stores"), F.max(F.when(F.col("op") == "store", F.sha2("content", 256))).alias("content_hash"), F.max("at").alias("updated_at"))
    return per.select("id", "content_hash", "stores", "updated_at")


@query("""
WITH first AS (SELECT sha256(text) AS h, arg_min(CAST(doc_id AS VARCHAR), (doc_id, CAST(doc_id AS VARCHAR))) AS id, min(doc_id) AS d0 FROM documents GROUP BY 1
), acc AS (SELECT e.event_id % (SELECT count(*) FROM documents) AS d, count(*) AS n, max(ts) AS t FROM events e GROUP BY 1)
SELECT id, CAST(d0 % 5 + 1 AS INTEGER) AS layer, coalesce(n, 0) AS access_count, 1.0 + coalesce(n, 0) AS stability,
  CASE d0 % 5 + 1 WHEN 1 THEN 0.0 WHEN 2 THEN 0.01 WHEN 3 THEN 0.05 WHEN 4 THEN 0.1 ELSE 0.5 END / CASE WHEN d0 % 5 = 0 THEN 1 ELSE 1 + coalesce(n, 0) END AS decay_rate
FROM first LEFT JOIN acc ON d = d0""")
def fold_ops(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000)
    stores = state.ops_of(docs.withColumn("n", F.col("doc_id")), "store", id=F.col("doc_id").cast("string"), at=at, layer=(F.col("n") % 5 + 1), content="text", attrs=F.create_map(F.lit("lang"), F.col("lang")))
    count = docs.agg(F.count("*").alias("_all"))
    events = _table(spark, sf_dir, "events").join(F.broadcast(count), F.lit(True))
    gets = state.ops_of(events.select((F.col("event_id") % F.col("_all")).cast("string").alias("d"), F.col("ts").cast("timestamp").alias("ts")), "get", id="d", at="ts")
    out = state.fold_ops(stores.unionByName(gets))
    return out.select("id", "layer", F.col("access_count").cast("long").alias("access_count"), F.col("stability").cast("double").alias("stability"), F.round(F.col("decay_rate").cast("double"), 9).alias("decay_rate"))


@query(f"""
WITH {MEM}, cur AS (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY n) = 1),
inc AS (SELECT content_hash, id, updated_at + CASE WHEN n % 2 = 0 THEN INTERVAL 1 DAY ELSE -INTERVAL 1 DAY END AS updated_at, importance + 1 AS importance, project FROM mem WHERE n % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY updated_at + CASE WHEN n % 2 = 0 THEN INTERVAL 1 DAY ELSE -INTERVAL 1 DAY END DESC, id DESC) = 1),
c AS (SELECT * FROM cur WHERE n % 5 <> 0)
SELECT coalesce(c.id, i.id) AS id, CASE WHEN c.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' WHEN i.updated_at > c.updated_at THEN 'updated' ELSE 'skipped' END AS action,
  CASE WHEN c.id IS NULL OR i.updated_at > c.updated_at THEN i.importance ELSE c.importance END AS importance, coalesce('new' || i.project, c.project) AS project
FROM c FULL JOIN inc i ON c.content_hash = i.content_hash""")
def lww_upsert(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    one = Window.partitionBy("content_hash").orderBy("n")
    current = rows.withColumn("_k", F.row_number().over(one)).where("_k = 1 and n % 5 <> 0").drop("_k")
    shift = F.when(F.col("n") % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
    incoming = rows.where("n % 3 = 0").withColumns({"updated_at": F.col("updated_at") + shift, "importance": F.col("importance") + 1, "attrs": F.create_map(F.lit("project"), F.concat(F.lit("new"), F.col("attrs")["project"]))})
    out = joins.lww_upsert(current.drop("n"), incoming.drop("n"))
    return out.select("id", "action", F.col("importance").cast("float").alias("importance"), F.col("attrs")["project"].alias("project"))


@query(f"""
WITH {MEM}, inc AS (SELECT *, 'a' || n % 2 AS account FROM mem), known AS (SELECT DISTINCT 'a' || n % 2 AS account, content_hash FROM mem WHERE n % 7 = 0)
SELECT account, id, coalesce(source <> 'src0' AND k.content_hash IS NULL AND row_number() OVER (PARTITION BY account, i.content_hash, source <> 'src0' ORDER BY layer, id) = 1, false) AS accepted
FROM inc i LEFT JOIN known k USING (account, content_hash)""")
def push_dedup(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumns({"account": F.concat(F.lit("a"), (F.col("id").cast("long") % 2).cast("string")), "org": F.lit("o"), "source": F.when(F.col("source") == "src0", "server").otherwise(F.col("source"))})
    return joins.push_dedup(rows, rows.where("cast(id as long) % 7 = 0")).select("account", "id", "accepted")


@query(f"""
WITH {MEM}, side AS (SELECT content_hash, arg_max(lang, n) AS lang, max(n) % 3 = 0 AS ok FROM mem WHERE n % 2 = 0 GROUP BY 1)
SELECT m.id, CASE WHEN s.ok THEN s.lang || '!' ELSE m.lang END AS lang FROM mem m LEFT JOIN side s USING (content_hash)""")
def overlay_attrs(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumns({"account": F.lit("a"), "org": F.lit("o")})
    n = F.col("id").cast("long")
    side = rows.where(n % 2 == 0).select("account", "org", "content_hash", F.when(n % 3 == 0, F.to_json(F.create_map(F.lit("lang"), F.concat(F.col("attrs")["lang"], F.lit("!"))))).otherwise("{broken").alias("attrs_json"), n.alias("written_at"))
    return joins.overlay_attrs(rows, side).select("id", F.col("attrs")["lang"].alias("lang"))


@query("""
WITH files AS (SELECT 'd' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0), old AS (SELECT 'd' || doc_id AS path, sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(f.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'removed' WHEN f.hash <> o.hash THEN 'changed' ELSE 'unchanged' END AS status
FROM files f FULL JOIN old o ON f.path = o.path""")
def changed_documents(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    files = d.where("doc_id % 5 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    old = d.where("doc_id % 4 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")), 256).alias("hash"))
    return joins.changed_documents(files, old).select("path", "status")


@query("""
WITH commits AS (SELECT 'r' || o_custkey % 3 AS repo, o_orderkey AS pos, 'c' || o_orderkey AS sha, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS number FROM orders),
fresh AS (SELECT * FROM commits WHERE pos % 10 <> 0 AND (number IS NULL OR number % 7 <> 0)),
firsts AS (SELECT repo, number, min(pos) AS f FROM fresh WHERE number IS NOT NULL GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY f, number) AS k FROM firsts),
cut AS (SELECT repo, f AS c FROM ranked WHERE k = 26), reached AS (SELECT fresh.* FROM fresh LEFT JOIN cut USING (repo) WHERE c IS NULL OR pos < c)
SELECT repo, number, min(pos) AS pos, list(sha ORDER BY pos) AS shas FROM reached WHERE number IS NULL OR (repo, number) IN (SELECT (repo, number) FROM ranked WHERE k <= 25) GROUP BY repo, number, CASE WHEN number IS NULL THEN sha END""")
def discover_new_prs(spark, sf_dir):
    c = _table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("repo"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("number"))
    return joins.discover_new_prs(c, c.where("pos % 10 = 0"), c.where("number % 7 = 0").select("repo", "number").distinct(), 25)


@query("""
WITH s AS (SELECT 's' || event_id AS id, 't' || user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, 's' || event_id) AS n FROM events)
SELECT a.id AS from_id, b.id AS to_id, 'same_trace' AS edge_type, CAST(1 AS FLOAT) AS weight FROM s a JOIN s b ON a.trace_id = b.trace_id AND b.n < a.n AND b.n <= 50""")
def same_trace_edges(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.col("event_id").alias("seq"))
    return joins.same_trace_edges(e)


@query(f"WITH {MEM}, {EDG} SELECT id FROM (SELECT DISTINCT 'p' || p_partkey AS id FROM part) WHERE id NOT IN (SELECT from_id FROM edges WHERE edge_type = 'derived_from' AND weight >= 0.65 UNION SELECT to_id FROM edges WHERE edge_type = 'derived_from' AND weight >= 0.65)")
def promotion_guard(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).distinct()
    return joins.promotion_guard(parts, edge_table(spark, sf_dir).where("weight >= 0.65"))


# scalar functions


@query(f"WITH {MEM} SELECT id, exp(-0.9995 * (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600.0) * 0.333 AS time_part, 0.333 * importance / 10.0 AS importance_part, coalesce(0.15 * valence * abs(valence), 0) AS valence_part FROM mem")
def score_parts(spark, sf_dir):
    parts = scores.composite_score(F.col("created_at"), F.col("importance"), F.col("valence"), F.lit(None), F.lit(NOW).cast("timestamp"))
    out = memories(spark, sf_dir).select("id", parts.alias("p"))
    return out.select("id", F.col("p.time").alias("time_part"), F.col("p.importance").alias("importance_part"), F.col("p.valence").alias("valence_part"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')[1:80] AS slug FROM documents")
def slugs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""
SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE (
  SELECT max(left(text, k)) FROM range(24, 101) r(k) WHERE octet_length(encode(left(text, CAST(k AS INTEGER)))) <= 100) END AS cut FROM documents""")
def truncate_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_utf8(F.col("text"), 100).alias("cut"))


_INTENTS = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}' END" for name, words in text.INTENTS.items())


@query(f"SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE ['build'] END AS intents FROM (SELECT doc_id, list_filter([{_INTENTS}], lambda v: v IS NOT NULL) AS x FROM (SELECT doc_id, lower(text) AS t FROM documents))")
def detect_intents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.detect_intents(F.col("text")).alias("intents"))


@query("SELECT page_id, url, regexp_matches(p, '^[^/]+/(?:[^/]+/)*[0-9][^/]*$') AND NOT regexp_matches(p, '^(?:[^/]+/)*fr/[^/]*$') AS accepted FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[#?].*$', ''), '/') AS p FROM pages)")
def glob_filter(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[#?].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", "url", text.path_accepted(path, ["*/**/[0-9]*"], ["**/fr/*"]).alias("accepted"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(hex(encode(text))) ELSE '!' || text END AS decoded FROM documents")
def base64_hex(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")).otherwise(F.concat(F.lit("!"), "text")).alias("t"))
    return d.select("doc_id", text.base64_to_hex(F.col("t")).alias("decoded"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(1, greatest(-1, (doc_id % 30) / 10.0 - 1.5)) WHEN 1 THEN 0.5 WHEN 2 THEN NULL ELSE -1 END AS valence, CASE doc_id % 3 WHEN 0 THEN CAST(least(10, greatest(1, doc_id % 15)) AS INTEGER) WHEN 1 THEN 7 END AS importance, CASE WHEN doc_id % 2 = 0 THEN lang || ',b,c,d,e' ELSE '' END AS tags FROM documents")
def model_replies(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    valence = F.when(n % 4 == 0, F.format_number((n % 30) / 10.0 - 1.5, 2)).when(n % 4 == 1, "I would say: (0.5), mostly").when(n % 4 == 2, "no idea").otherwise(" -3.0 ")
    importance = F.when(n % 3 == 0, (n % 15).cast("string")).when(n % 3 == 1, "about 7 of 10").otherwise("none")
    tags = F.when(n % 2 == 0, F.concat(F.lit('```json\n[" '), F.upper("lang"), F.lit('","B","","c","d","e","f"]\n```'))).otherwise("not json")
    return d.select("doc_id", replies.parse_valence(valence).alias("valence"), replies.parse_importance(importance).alias("importance"), replies.parse_tags(tags).alias("tags"))


@query("SELECT event_id, '[svc' || user_id % 3 || '] span: ' || event_type || ' duration=' || event_id % 1000 || 'ms status=' || CASE event_id % 3 WHEN 1 THEN 'OK' WHEN 2 THEN 'ERROR' ELSE 'UNSET' END AS content FROM events")
def span_texts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    service = F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string"))
    start = F.col("event_id") * 10
    return e.select("event_id", text.span_text(service, F.col("event_type"), start, start + (F.col("event_id") % 1000) * 1_000_000 + 999, F.col("event_id") % 3).alias("content"))


@query(f"WITH {MEM} SELECT id, CASE layer WHEN 3 THEN 'shared' WHEN 4 THEN 'teams/' || lang ELSE 'users/' || project END AS scope FROM mem")
def partition_scopes(spark, sf_dir):
    return memories(spark, sf_dir).select("id", scope_of(F.col("layer"), F.col("attrs")["project"], F.col("attrs")["lang"]).alias("scope"))


# windows and groups


@query(f"WITH {MEM}, c AS (SELECT layer, tags, count(*) AS n FROM mem WHERE tags IS NOT NULL GROUP BY 1, 2) SELECT layer AS cluster, tags AS value, n FROM c QUALIFY row_number() OVER (PARTITION BY layer ORDER BY n DESC, tags) = 1")
def dominant_attr(spark, sf_dir):
    return aggregates.dominant_attr(memories(spark, sf_dir).withColumn("cluster", F.col("layer")), "tags")


@query("""
WITH m AS (SELECT label AS cluster, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), v AS (SELECT cluster, list(x ORDER BY i) AS v FROM m GROUP BY 1)
SELECT cluster, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS centroid FROM v""")
def centroids(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.timestamp_seconds("vec_id").alias("created_at"), "embedding")
    return aggregates.centroid(e).select("cluster", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""
WITH {MEM}, g AS (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY created_at, id) - 1 AS i, count(*) OVER (PARTITION BY layer) AS c, sum(octet_length(encode(content))) OVER (PARTITION BY layer) AS t FROM mem),
k AS (SELECT *, least(c, greatest(2, CAST(floor(80000 * c / t) AS BIGINT))) AS m FROM g)
SELECT layer AS cluster, id FROM k WHERE t <= 80000 OR list_contains(list_transform(range(0, m), lambda j: j * (c - 1) // (m - 1)), i)""")
def even_sample(spark, sf_dir):
    return aggregates.even_sample(memories(spark, sf_dir).withColumn("cluster", F.col("layer"))).select("cluster", "id")


@query(f"WITH {MEM} SELECT id, CAST(floor((row_number() OVER (ORDER BY vec_id IS NOT NULL, created_at, id) - 1) / 20) AS BIGINT) AS \"window\" FROM live LEFT JOIN embeddings ON vec_id = n WHERE layer = 5")
def chrono_windows(spark, sf_dir):
    return aggregates.chrono_windows(filters.active(memories(spark, sf_dir, True)).where("layer = 5")).select("id", "window")


@query(f"WITH {MEM} SELECT layer, id FROM mem QUALIFY row_number() OVER (PARTITION BY layer ORDER BY created_at DESC, id DESC) <= 7")
def latest_rows(spark, sf_dir):
    return aggregates.latest_n(memories(spark, sf_dir), 7, "layer").select("layer", "id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_turns(spark, sf_dir):
    return aggregates.last_turns(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id AS file, turn AS line_no, last_value(CASE WHEN role = 'user' THEN 'cwd' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cwd FROM conversations")
def carry_forward(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", F.concat(F.lit("cwd"), F.col("turn").cast("string"))).otherwise("").alias("cwd"))
    return aggregates.carry_forward(c, ["cwd"])


@query("SELECT event_type AS op, le, count(*) FILTER (CAST(event_id % 1000 AS DOUBLE) / 500 <= le) AS n FROM events, (VALUES (0.001::DOUBLE), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), ('inf'::DOUBLE)) b(le) GROUP BY 1, 2")
def op_histogram(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), ((F.col("event_id") % 1000).cast("double") / 500).alias("seconds"))
    return aggregates.op_histogram(log, ["op"])


@query("SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def op_counters(spark, sf_dir):
    return aggregates.op_counters(_table(spark, sf_dir, "events").withColumnRenamed("event_type", "op"), ["op"])


@query("SELECT o_orderpriority AS approach, count(*) AS problems, count(*) FILTER (o_orderstatus = 'F') AS patches, count(*) FILTER (o_orderstatus = 'O') AS no_patch, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS patch_rate FROM orders GROUP BY 1")
def approach_summary(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("approach"), F.when(F.col("o_orderstatus") == "F", "patch").when(F.col("o_orderstatus") == "O", "no_patch").otherwise("failed").alias("outcome"), F.col("o_orderdate").alias("started_at"))
    return aggregates.approach_summary(o).drop("first_at")


@query("""
WITH u AS (SELECT DISTINCT 'a' || c_nationkey % 3 AS account, 'o' || c_nationkey AS org, 'u' || c_custkey % 50 AS "user" FROM customer), o AS (SELECT account, org, list("user" ORDER BY "user") AS users FROM u GROUP BY 1, 2)
SELECT account, org, users FROM o""")
def identities_tree(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), (F.col("c_nationkey") % 3).cast("string")).alias("account"), F.concat(F.lit("o"), F.col("c_nationkey").cast("string")).alias("org"), F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("user"))
    return aggregates.identities_tree(c).select("account", F.explode("orgs").alias("o")).select("account", "o.org", "o.users")


@query("""
WITH p AS (SELECT DISTINCT conv_id, '/src/' || role || '/f' || turn AS path FROM conversations)
SELECT conv_id AS session, 'Files touched:' || chr(10) || string_agg('  ' || path || chr(10), '' ORDER BY path) AS content, 'P-' || split_part(min(path), '/', 3) AS project FROM p GROUP BY 1""")
def files_touched(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    blocks = c.select(F.col("conv_id").alias("session"), F.array(F.concat(F.lit("/src/"), "role", F.lit("/f"), F.col("turn").cast("string")), F.lit("")).alias("paths"))
    projects = c.select(F.concat(F.lit("/src/"), "role").alias("prefix"), F.concat(F.lit("P-"), "role").alias("project")).distinct()
    return aggregates.files_touched(blocks, projects).select("session", "content", "project")


# transcripts and spans


@query("SELECT 'c' || conv_id AS session, turn AS line_no, text AS content FROM conversations WHERE role <> 'system' AND text <> ''")
def transcript_lines(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.to_json(F.struct("role", block.alias("content"))))
    kind = F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","message":'), message, F.lit("}"))
    lines = c.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line_no"), line.alias("value"))
    return readers.parse_lines(lines, "A").where("content is not null").select("session", "line_no", "content")


@query("SELECT 'c' || conv_id AS session, '/w/' || conv_id AS cwd, turn AS line_no, text AS content FROM conversations WHERE role <> 'system' AND turn > 0 AND text <> ''")
def transcript_headers(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    ident = F.col("conv_id").cast("string")
    header = F.concat(F.lit('{"type":"session","id":"c'), ident, F.lit('","cwd":"/w/'), ident, F.lit('"}'))
    message = F.concat(F.lit('{"type":"message","id":"m","message":'), F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))), F.lit("}"))
    lines = c.select(F.concat(F.lit("/x/.pi/agent/sessions/"), ident).alias("file"), F.col("turn").alias("line_no"), F.when(F.col("turn") == 0, header).otherwise(message).alias("value"))
    return readers.carry_headers(readers.parse_lines(lines)).where("content is not null").select("session", "cwd", "line_no", "content")


@query("SELECT lower(hex(encode('trace-' || user_id))) AS trace_id, lower(hex(encode('span-' || event_id))) AS span_id, 'svc' || user_id % 3 AS service_name, event_type AS name, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_code, CAST(event_id AS VARCHAR) AS n FROM events")
def otlp_spans(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    b64 = lambda name, c: F.base64(F.encode(F.concat(F.lit(name), F.col(c).cast("string")), "UTF-8"))
    span = F.struct(
        b64("trace-", "user_id").alias("traceId"), b64("span-", "event_id").alias("spanId"), F.lit("").alias("parentSpanId"), F.col("event_type").alias("name"), F.lit("0").alias("startTimeUnixNano"), F.lit("1000000").alias("endTimeUnixNano"),
        F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"), F.array(F.struct(F.lit("n").alias("key"), F.struct(F.col("event_id").cast("long").alias("intValue")).alias("value"))).alias("attributes"),
    )
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")).alias("stringValue")).alias("value"))).alias("attributes"))
    request = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return readers.parse_spans(e.select(request.alias("value"))).select("trace_id", "span_id", "service_name", "name", "status_code", F.col("attrs")["n"].alias("n"))


# retrieval

_KNN = """
near AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, list_distance(qv, CAST(embedding AS DOUBLE[])) AS distance FROM qry, embeddings WHERE qv IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(vec_id AS VARCHAR)) <= {k})"""
_BM25 = """
toks AS (SELECT id, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS t FROM mem), sizes AS (SELECT id, len(t) AS len FROM toks), overall AS (SELECT count(*) AS docs, avg(len) AS mean FROM sizes),
terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(strip_accents(lower(query)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM qry),
posts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL), hits AS (SELECT query_id, term, id, tf FROM terms JOIN posts USING (term)),
dfs AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(greatest(0.000001, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS bm25
  FROM hits JOIN dfs USING (query_id, term) JOIN sizes USING (id) CROSS JOIN overall GROUP BY ALL),
texts AS (SELECT query_id, id, bm25 FROM bm JOIN live USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) <= {k})"""
_KNN, _BM25 = _KNN.replace("{k}", "30"), _BM25.replace("{{", "{").replace("}}", "}").replace("{k}", "30")


@query("SELECT CAST(x.vec_id AS VARCHAR) AS query_id, CAST(y.vec_id AS VARCHAR) AS id, list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS distance FROM embeddings x, embeddings y WHERE x.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY distance, CAST(y.vec_id AS VARCHAR)) <= 10")
def knn_l2(spark, sf_dir):
    v = vector_table(spark, sf_dir)
    asked = v.where("cast(id as long) % 50 = 0").withColumnRenamed("id", "query_id")
    return retrieval.knn_join(v, asked, 10).drop("rank")


@query(f"WITH {QRY}, {_KNN.replace('30', '12')} SELECT query_id, id, distance FROM near")
def knn_join(spark, sf_dir):
    return retrieval.knn_join(vector_table(spark, sf_dir), query_table(spark, sf_dir), 12).drop("rank")


@query(f"WITH {QRY}, {_KNN.replace('30', '12')} SELECT query_id, id, distance FROM near")
def knn_cells_join(spark, sf_dir):
    return knn_cells.knn_join_cells(vector_table(spark, sf_dir), query_table(spark, sf_dir), 12)[0].drop("rank")


@query(f"WITH {MEM}, {QRY}, {_KNN} SELECT query_id, id, distance FROM near JOIN live USING (id) WHERE layer IN (3, 4)")
def knn_postfilter(spark, sf_dir):
    return retrieval.vector_search(memories(spark, sf_dir), vector_table(spark, sf_dir), query_table(spark, sf_dir), 30, [3, 4])


@query("SELECT CAST(x.vec_id AS VARCHAR) AS a, CAST(y.vec_id AS VARCHAR) AS b, CAST(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS DOUBLE) AS cosine FROM embeddings x JOIN embeddings y ON CAST(x.vec_id AS VARCHAR) < CAST(y.vec_id AS VARCHAR) WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.35")
def cosine_pairs(spark, sf_dir):
    return angles.cosine_pairs(vector_table(spark, sf_dir), 0.35, kind="double")


@query("WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT x.id, count(*) AS links FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.2 GROUP BY 1")
def cosine_link_counts(spark, sf_dir):
    return angles.link_counts(angles.cosine_links(vector_table(spark, sf_dir), 0.2, kind="double"))


@query(f"WITH {MEM}, {QRY}, {_BM25.replace('30', '20')} SELECT query_id, id, bm25 FROM texts")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25_search(memories(spark, sf_dir), query_table(spark, sf_dir), 20).drop("rank")


@query(f"WITH {MEM}, {QRY}, {_BM25.replace('30', '20')} SELECT query_id, id, bm25 FROM texts")
def bm25_indexed(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return text_index.indexed_search(text_index.build_text_index(rows), query_table(spark, sf_dir), 20, rows)[0].select("query_id", "id", "bm25")


_HYBRID = f"""
WITH {MEM}, {QRY}, {_KNN}, {_BM25}, cand AS (SELECT query_id, id FROM near JOIN live USING (id) UNION SELECT query_id, id FROM texts),
scored AS (SELECT query_id, id, layer, valence, round((0.333 * exp(-0.9995 * (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600.0) + 0.333 * importance / 10.0
    + 0.333 * coalesce(CAST(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS FLOAT) AS DOUBLE), 0) + coalesce(0.15 * CAST(valence AS DOUBLE) * abs(CAST(valence AS DOUBLE)), 0)) * BOOST, 9) AS score
  FROM cand JOIN live USING (id) JOIN qry USING (query_id) LEFT JOIN embeddings ON vec_id = n WHERE RANGE)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 4) AS score FROM scored QUALIFY rank <= 10"""


def _hybrid(sql_boost="1", sql_range="true"):
    return _HYBRID.replace("BOOST", sql_boost).replace("RANGE", sql_range)


def _searched(spark, sf_dir, how, **more):
    return plans.hybrid_search(memories(spark, sf_dir, True), query_table(spark, sf_dir), NOW, how, **more).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


@query(_hybrid())
def hybrid_search_batch(spark, sf_dir):
    return _searched(spark, sf_dir, plans.Search())


@query(_hybrid() + " AND query_id % 50 = 0")
def hybrid_search(spark, sf_dir):
    return plans.hybrid_search(memories(spark, sf_dir, True), query_table(spark, sf_dir).where("query_id % 50 = 0"), NOW).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


@query(_hybrid("CASE WHEN lang = 'de' THEN 1.5 ELSE 1 END"))
def attr_boost(spark, sf_dir):
    return _searched(spark, sf_dir, plans.Search(attrs=(("lang", "de"),)))


@query(_hybrid(sql_range="valence >= 0 AND valence <= 0.5"))
def valence_range(spark, sf_dir):
    return _searched(spark, sf_dir, plans.Search(min_valence=0, max_valence=0.5))


_PER_LAYER = _hybrid().replace("<= 30)", "<= 24)").replace("JOIN live USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25", "JOIN live USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, layer ORDER BY bm25")
_PER_LAYER = _PER_LAYER.replace("SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score", "SELECT query_id, layer, CAST(row_number() OVER (PARTITION BY query_id, layer ORDER BY score").replace("rank <= 10", "rank <= 8")


@query(_PER_LAYER)
def search_per_layer(spark, sf_dir):
    return plans.per_layer_search(memories(spark, sf_dir, True), query_table(spark, sf_dir), NOW).select("query_id", "layer", "rank", "id", F.round("score", 4).alias("score"))


@query(_hybrid().replace("<= 30)", "<= 60)").replace("rank <= 10", "rank <= 20"))
def search_merged(spark, sf_dir):
    return plans.merged_search(memories(spark, sf_dir, True), query_table(spark, sf_dir), NOW).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


@query(f"WITH {QRY}, near AS (SELECT CAST(x.vec_id AS VARCHAR) AS from_id, CAST(y.vec_id AS VARCHAR) AS to_id, CAST(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS FLOAT) AS weight FROM embeddings x, embeddings y QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), CAST(y.vec_id AS VARCHAR)) <= 6) SELECT from_id, to_id, 'relates_to' AS edge_type, weight FROM near WHERE from_id <> to_id AND weight >= CAST(0.3 AS FLOAT)")
def auto_link(spark, sf_dir):
    v = vector_table(spark, sf_dir).withColumn("compacted_at", F.lit(None).cast("timestamp"))
    return cluster.auto_link(v, v, threshold=0.3)


# graph


@query(f"WITH {EDG}, e AS (SELECT from_id AS id, to_id AS other, edge_type, weight, true AS outgoing FROM edges UNION ALL SELECT to_id, from_id, edge_type, weight, false FROM edges) SELECT * FROM e WHERE id IN ('s1', 'p7') AND edge_type IN ('supports', 'compacted_from')")
def neighbors(spark, sf_dir):
    ids = _table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.lit("s1").alias("id")).union(_table(spark, sf_dir, "part").where("p_partkey = 7").select(F.lit("p7").alias("id")))
    return graph.neighbors(edge_table(spark, sf_dir), ids, ["supports", "compacted_from"])


def _bfs_sql(root: str, depth: int) -> str:
    parts, seen, front = [EDG], f"SELECT '{root}' AS id", f"SELECT '{root}' AS id"
    for k in range(1, depth + 1):
        parts.append(f"l{k} AS (SELECT to_id, arg_min(e, (e.from_id, e.edge_type)) AS e FROM (SELECT to_id, {{'from_id': from_id, 'edge_type': edge_type, 'weight': weight}} AS e FROM edges WHERE from_id IN ({front}) AND to_id NOT IN ({seen})) GROUP BY to_id)")
        front = f"SELECT to_id FROM l{k}"
        seen += f" UNION ALL {front}"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT e.from_id AS from_id, to_id, e.edge_type AS edge_type, e.weight AS weight, {k} AS level FROM l{k}" for k in range(1, depth + 1))


@query(_bfs_sql("p1", 3))
def bfs_depth3(spark, sf_dir):
    return graph.bfs(edge_table(spark, sf_dir), "p1", 3)


def _ppr_sql(iterations: int) -> str:
    parts = [EDG, "lnk AS (SELECT from_id, to_id, sum(p) AS p FROM (SELECT from_id, to_id, CAST(weight AS DOUBLE) / sum(CAST(weight AS DOUBLE)) OVER (PARTITION BY from_id) AS p FROM edges) GROUP BY ALL)",
             "seeds AS (SELECT DISTINCT 'p' || p_partkey AS id FROM part WHERE p_partkey % 50 = 1)", "node AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges UNION SELECT id FROM seeds)",
             "base AS MATERIALIZED (SELECT n.id, CASE WHEN s.id IS NULL THEN 0 ELSE 1.0 / (SELECT count(*) FROM seeds) END AS t, n.id NOT IN (SELECT from_id FROM lnk) AS dead FROM node n LEFT JOIN seeds s ON s.id = n.id)",
             "r0 AS MATERIALIZED (SELECT id, t, dead, t AS rank FROM base)"]
    for k in range(iterations):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT b.id, t, dead, 0.15 * t + 0.85 * (coalesce(got, 0) + t * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE dead)) AS rank FROM base b LEFT JOIN (SELECT to_id, sum(p * rank) AS got FROM lnk JOIN r{k} ON r{k}.id = from_id GROUP BY 1) ON to_id = b.id)")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{iterations}"


@query(_ppr_sql(20))
def pagerank_20(spark, sf_dir):
    seeds = _table(spark, sf_dir, "part").where("p_partkey % 50 = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).distinct()
    return graph.personalized_pagerank(edge_table(spark, sf_dir), seeds).select("id", F.round("rank", 9).alias("rank"))


@query(_ppr_sql(20).replace("round(rank, 9) AS rank FROM r20", "round(rank, 9) AS rank FROM r20 WHERE rank > 0").replace("SELECT id,", "SELECT 1 AS query_id, id,"))
def pagerank_pushed(spark, sf_dir):
    seeds = _table(spark, sf_dir, "part").where("p_partkey % 50 = 1").select(F.lit(1).alias("query_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).distinct()
    return graph.pagerank_of_queries(edge_table(spark, sf_dir), seeds)[0].select("query_id", "id", F.round("rank", 9).alias("rank"))


@query(f"""
WITH {MEM}, kept AS (SELECT n, layer FROM mem WHERE n % 11 <> 0), links AS (SELECT n AS a, n // 2 AS b FROM mem)
SELECT layer, count(*) AS n_rows, count(b) AS n_edges FROM kept LEFT JOIN (SELECT a, b FROM links WHERE b IN (SELECT n FROM kept)) ON n = a GROUP BY 1""")
def backup_of_rows_and_edges(spark, sf_dir):
    rows, path = memories(spark, sf_dir), new_path(spark, "backup")
    half = F.floor(F.col("id").cast("long") / 2).cast("string")
    edges = rows.select(F.col("id").alias("from_id"), half.alias("to_id"), F.lit("derived_from").alias("edge_type"), F.lit(1.0).cast("float").alias("weight"), "created_at")
    kept = rows.where("compacted_at is null")
    write_backup(kept, edges, path, "20240102-000000")
    rows, edges = read_backup(spark, path, "20240102-000000", kept.schema, edges.schema)
    return rows.join(edges.select(F.col("from_id").alias("id"), "to_id"), "id", "left").groupBy("layer").agg(F.count("*").alias("n_rows"), F.count("to_id").alias("n_edges"))


@query()
def greedy_clusters(spark, sf_dir):
    v = vector_table(spark, sf_dir).withColumn("created_at", F.timestamp_seconds(F.col("id").cast("long")))
    return cluster.greedy_clusters(v, 0.35, 2)
