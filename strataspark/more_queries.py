"""More of the store's operators as queries over the test tables, each with the same in SQL (see :mod:`strataspark.queries`, whose tables these use)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions import replies, scores, text
from strataspark.functions.models import const_completer
from strataspark.operators import aggregates, filters, graph, joins, retrieval, state
from strataspark.plans import search
from strataspark.queries import EDG, MEM, NOW, _ppr_sql, _table, edge_table, memories, query
from strataspark.schema import valid_memories
from strataspark.scratch import materialise
from strataspark.sources import readers

# rows by key and by attribute


@query(f"WITH {MEM} SELECT lpad(id, 36, '0') AS id, content_hash FROM mem WHERE n = 7")
def get_by_id(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("id", F.lpad("id", 36, "0"))
    return filters.get_by_id_or_prefix(rows, "7".zfill(36)).select("id", "content_hash")


@query(f"WITH {MEM} SELECT id, layer FROM mem WHERE 'w/' || project || '/' || lang = 'w/p3/de'")
def cwd_filter(spark, sf_dir):
    rows = memories(spark, sf_dir)
    rows = rows.withColumn("attrs", F.create_map(F.lit("cwd"), F.concat(F.lit("w/"), F.col("attrs")["project"], F.lit("/"), F.col("attrs")["lang"])))
    return filters.cwd_filter(rows, "w/p3/de").select("id", "layer")


@query("SELECT doc_id FROM documents WHERE lower(lang) NOT IN ('de', 'fr')")
def skip_authors(spark, sf_dir):
    return filters.skip_authors(_table(spark, sf_dir, "documents").withColumn("author", F.initcap("lang")), ["DE", "fr"]).select("doc_id")


@query(f"WITH {MEM} SELECT id, layer, importance / 10.0 AS score, valence, source, CASE WHEN n % 2 = 0 THEN project ELSE '' END AS project FROM mem")
def compact_view(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumns({"score": F.col("importance").cast("double") / 10.0, "parts": F.struct(F.lit(1.0).alias("time"))})
    odd = F.col("id").cast("long") % 2 == 1
    rows = rows.withColumn("attrs", F.when(odd, F.map_filter("attrs", lambda k, v: k != "project")).otherwise(F.col("attrs")))
    return filters.compact_view(rows).select("id", "layer", "score", "valence", "source", "project")


@query(f"WITH {MEM} SELECT id FROM live WHERE n % 7 = 3 ORDER BY created_at DESC, id LIMIT 500")
def list_from_source(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("attrs", F.create_map(F.lit("source_file"), F.concat(F.lit("f"), (F.col("id").cast("long") % 7).cast("string"))))
    return filters.list_from_source(rows, "f3").select("id")


@query("SELECT page_id AS id, url AS name FROM pages WHERE page_id % 3 = 0 AND page_id > 20 AND (contains(url, '1') OR contains(url, 'a')) AND NOT contains(url, '7')")
def drive_listing(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    files = p.select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.when(F.col("page_id") % 3 == 0, "doc").otherwise("sheet").alias("mime_type"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("modified_time"))
    return filters.filter_drive_listing(files, "doc", "000000020", ["1", "a"], ["7"]).select("id", "name")


@query(f"WITH {MEM} SELECT id, CAST(created_at AS DATE) AS date FROM mem WHERE n % 6 = 0 OR CAST(created_at AS DATE) >= DATE '2024-01-01'")
def partition_since(spark, sf_dir):
    rows = memories(spark, sf_dir)
    old = rows.withColumn("date", F.when(F.col("id").cast("long") % 6 != 0, F.to_date("created_at"))).withColumn("day", F.to_date("created_at"))
    return filters.partition_since(old, "2024-01-01").select("id", F.col("day").alias("date"))


@query(f"WITH {MEM} SELECT id FROM mem WHERE n % 6 IN (1, 2, 3, 4, 5) AND content <> '' AND (n % 4 <> 2)")
def valid_rows(spark, sf_dir):
    n = F.col("id").cast("long")
    rows = memories(spark, sf_dir).withColumns({"layer": (n % 6).cast("int"), "valence": F.when(n % 4 == 1, 1.0).when(n % 4 == 2, -1.5)})
    return valid_memories(rows).select("id")


# work items


@query("""
SELECT 'r' || o_custkey % 3 AS repo, o_orderkey AS number, 'GitHub Issue #' || o_orderkey || ' [' || o_orderstatus || ']: ' || o_orderpriority || chr(10) || chr(10) || 'Repo: r' || o_custkey % 3 || chr(10) || 'State: ' || o_orderstatus || chr(10)
  || 'Labels: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END || chr(10) || 'URL: u' || o_orderkey || chr(10) || chr(10) || 'Body of ' || o_orderkey AS content,
  map_from_entries(list_filter([('issue_number', CAST(o_orderkey AS VARCHAR)), ('issue_url', 'u' || o_orderkey), ('labels', CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END), ('project', 'r' || o_custkey % 3), ('repo', 'r' || o_custkey % 3),
    ('source', 'github_issue'), ('state', o_orderstatus)], lambda e: e[2] <> '')) AS attrs FROM orders""")
def issue_rows(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    labels = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name"))))
    issues = o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("repo"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("  Body of "), key, F.lit(" ")).alias("body"),
        F.col("o_orderstatus").alias("state"), F.concat(F.lit("u"), key).alias("html_url"), F.lit("2024").alias("updated_at"), labels.alias("labels"),
    )
    out = readers.issue_rows(issues)
    return out.select("repo", "number", "content", F.map_from_entries(F.array_sort(F.map_entries("attrs"))).alias("attrs"))


@query("SELECT 'c' || page_id AS comment_id, 'Comment on r' || page_id % 3 || '#' || page_id || ' by ' || CASE WHEN page_id % 2 = 0 THEN 'ann' ELSE '' END || ':' || chr(10) || chr(10) || url AS content FROM pages WHERE page_id % 5 <> 0")
def comment_rows(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    comments = p.select(F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("repo"), F.col("page_id").alias("number"), F.concat(F.lit("c"), key).alias("comment_id"), F.when(F.col("page_id") % 2 == 0, "ann").alias("author"), F.concat(F.lit(" "), "url").alias("body"))
    return readers.comment_rows(joins.new_comments(comments, comments.where("number % 5 = 0"))).select("comment_id", "content")


@query("""SELECT o_orderkey AS number, o_orderpriority AS content, map_from_entries([('author', 'c' || o_custkey), ('created_at', CAST(o_orderdate AS VARCHAR)[1:10]), ('pr_number', CAST(o_orderkey AS VARCHAR)), ('repo', 'r'), ('source', 'github_pr')]) AS attrs FROM orders""")
def pull_request_rows(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    merged = o.select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("summary"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("merged_at"))
    return readers.pull_request_rows(merged).select("number", "content", F.map_from_entries(F.array_sort(F.map_entries("attrs"))).alias("attrs"))


@query("SELECT 'i' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS instance_id, 'r' || o_custkey % 10 AS repo FROM orders WHERE o_custkey % 10 IN (2, 4) ORDER BY 1 LIMIT 200 OFFSET 5")
def select_problems(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("i"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("instance_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 10).cast("string")).alias("repo"))
    languages = o.select("repo").distinct().withColumn("language", F.when(F.col("repo").isin("r2", "r4"), "go").otherwise("rust"))
    return readers.select_problems(o, languages.union(languages), "go", 5, 200).select("instance_id", "repo")


@query("""
WITH refs AS (SELECT l_orderkey, l_partkey AS number, CASE WHEN l_returnflag = 'R' THEN 'MERGED' ELSE 'OPEN' END AS state, l_linenumber AS ref_order FROM lineitem),
one AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY state = 'MERGED' DESC, ref_order, number) = 1)
SELECT 'c' || o_orderkey AS sha, number, state FROM orders LEFT JOIN one ON l_orderkey = o_orderkey AND l_orderkey % 5 <> 0""")
def resolve_prs(spark, sf_dir):
    sha = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("sha")
    refs = _table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(sha("l_orderkey"), F.col("l_partkey").alias("number"), F.when(F.col("l_returnflag") == "R", "MERGED").otherwise("OPEN").alias("state"), F.col("l_linenumber").alias("ref_order"))
    return joins.resolve_prs(_table(spark, sf_dir, "orders").select(sha("o_orderkey")), refs).select("sha", "number", "state")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 1")
def changed_issues(spark, sf_dir):
    issues = _table(spark, sf_dir, "orders").select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("number"), F.concat(F.lit("t"), "o_orderstatus").alias("updated_at"))
    seen = issues.where("number % 3 <> 0").withColumn("updated_at", F.when(F.col("number") % 4 == 1, "old").otherwise(F.col("updated_at")))
    return joins.changed_issues(issues, seen).select("number")


@query("SELECT page_id AS id FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 1")
def changed_rich_docs(spark, sf_dir):
    listing = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("2024-02").alias("modified_time"))
    stored = listing.where("id % 3 <> 0").withColumn("modified_time", F.when(F.col("id") % 4 == 1, "2024-01").otherwise("2024-02"))
    return joins.changed_rich_docs(listing, stored).select("id")


@query("SELECT 'i' || o_orderkey AS instance_id, a AS approach FROM orders, (VALUES ('x'), ('y')) v(a) WHERE NOT (a = 'x' AND o_orderkey % 3 = 0)")
def resume_guard(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("instance_id"), "o_orderkey")
    todo = o.select("instance_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("approach"))
    return joins.resume_guard(todo, o.where("o_orderkey % 3 = 0").withColumn("approach", F.lit("x")))


@query("SELECT DISTINCT 'm' || doc_id % 50 AS id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 = 0")
def derived_tombstones(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    old = d.select("path", F.lit("h").alias("hash"), "doc_id")
    files = d.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, "new").otherwise("h").alias("hash"))
    derived = d.select("path", F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("id"))
    return joins.derived_tombstones(joins.changed_documents(files, old), derived)


# graph


@query(f"WITH {EDG} SELECT from_id, to_id, edge_type, weight FROM edges WHERE from_id NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def delete_edges_from(spark, sf_dir):
    ids = _table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return joins.delete_edges_from(edge_table(spark, sf_dir), ids).select("from_id", "to_id", "edge_type", "weight")


@query(f"""
WITH {EDG}, own AS (SELECT * FROM edges WHERE weight < 0.45), ids AS (SELECT from_id AS id FROM edges WHERE from_id <> 'p1' UNION SELECT to_id FROM edges WHERE to_id <> 'p1'),
fresh AS (SELECT from_id, to_id, edge_type, weight FROM edges WHERE weight >= 0.25 UNION ALL SELECT to_id, from_id, 'supports', CAST(0.125 AS FLOAT) FROM edges WHERE edge_type = 'relates_to')
SELECT from_id, to_id, edge_type, weight FROM own UNION ALL SELECT from_id, to_id, edge_type, max(weight) FROM fresh WHERE (from_id, to_id, edge_type) NOT IN (SELECT (from_id, to_id, edge_type) FROM own)
  AND from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids) GROUP BY ALL""")
def edge_insert_ignore(spark, sf_dir):
    edges = materialise(edge_table(spark, sf_dir), "edges")  # read six times
    rows = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).where("id <> 'p1'")
    back = edges.where("edge_type = 'relates_to'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("supports").alias("edge_type"), F.lit(0.125).cast("float").alias("weight"), "created_at")
    new = edges.where("weight >= 0.25").unionByName(back)
    return joins.edge_insert_ignore(edges.where("weight < 0.45"), new, rows).select("from_id", "to_id", "edge_type", "weight")


@query(f"WITH {EDG} SELECT DISTINCT 'p' || p_partkey AS id FROM part WHERE 'p' || p_partkey NOT IN (SELECT from_id FROM edges WHERE edge_type = 'compacted_from' AND weight >= 0.5 UNION SELECT to_id FROM edges WHERE edge_type = 'compacted_from' AND weight >= 0.5)")
def seed_exclusion(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).distinct()
    return joins.seed_exclusion(parts, edge_table(spark, sf_dir))


@query("SELECT 'n' || l_orderkey AS from_id, 'p' || l_partkey AS to_id, 'compacted_from' AS edge_type, CAST(1 AS FLOAT) AS weight FROM lineitem")
def lineage_edges(spark, sf_dir):
    made = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("source_ids"))
    made = made.select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("id"), "source_ids", F.lit(NOW).cast("timestamp").alias("created_at"))
    return graph.lineage_edges(made).drop("created_at")


@query(f"WITH {MEM} SELECT DISTINCT b.id, b.layer FROM mem a JOIN live b ON b.n = a.n + 1 WHERE a.layer = 4 AND a.n % 2 = 0 AND b.layer = 5")
def follow_edges(spark, sf_dir):
    rows = memories(spark, sf_dir)
    n = F.col("id").cast("long")
    edges = rows.select(F.col("id").alias("from_id"), (n + 1).cast("string").alias("to_id"))
    return graph.follow_edges(edges, rows.where(n % 2 == 0), rows).select("id", "layer")


@query(_ppr_sql(20) + " QUALIFY row_number() OVER (ORDER BY round(rank, 9) DESC, id) <= 10")
def ppr_top(spark, sf_dir):
    seeds = _table(spark, sf_dir, "part").where("p_partkey % 50 = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).distinct()
    ranks = graph.personalized_pagerank(edge_table(spark, sf_dir), seeds)
    return graph.ppr_top(ranks.select("id", F.round("rank", 9).alias("rank")), 10)


# attributes and groups


@query(f"""
WITH {MEM}, pairs AS (SELECT n, id, unnest([('source', source), ('lang', lang), ('project', project), ('tags', tags)]) AS p FROM mem), seeds AS (SELECT p, count(*) AS n FROM pairs WHERE n % 10 = 0 AND p[2] IS NOT NULL GROUP BY p)
SELECT id, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS affinity FROM pairs LEFT JOIN seeds s USING (p) GROUP BY id""")
def attr_affinity(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return aggregates.affinity(rows, aggregates.seed_attr_counts(rows.where("cast(id as long) % 10 = 0"))).select("id", "affinity")


@query("""
WITH ops AS (SELECT event_id % 97 AS m, event_type AS key, CASE WHEN event_id % 11 <> 0 THEN 'v' || event_id % 13 END AS value, event_id AS i FROM events), cut AS (SELECT m, max(i) AS c FROM ops WHERE i % 101 = 0 GROUP BY m),
last AS (SELECT m, key, arg_max(coalesce(value, '-'), i) AS value FROM ops LEFT JOIN cut USING (m) WHERE c IS NULL OR i >= c GROUP BY m, key)
SELECT 'm' || m AS mem_id, map_from_entries(list((key, value) ORDER BY key)) AS attrs FROM last WHERE value <> '-' GROUP BY m""")
def attr_rows_to_map(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    ops = e.select(F.concat(F.lit("m"), (F.col("event_id") % 97).cast("string")).alias("mem_id"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("v"), (F.col("event_id") % 13).cast("string"))).alias("value"), F.col("event_id").alias("at"))
    return aggregates.attr_rows_to_map(aggregates.replace_attrs(ops, ops.where("at % 101 = 0")))


@query(f"WITH {MEM} SELECT layer AS cluster, min(created_at) AS window_start, max(created_at) AS window_end FROM mem GROUP BY layer")
def cluster_span(spark, sf_dir):
    return aggregates.cluster_span(memories(spark, sf_dir).withColumns({"cluster": F.col("layer"), "pos": F.col("id").cast("long")}))


@query(f"WITH {MEM} SELECT id, CAST(min(s)[1] AS INTEGER) AS section, CAST(min(s)[2] AS BIGINT) AS rank FROM (SELECT id, [0, n] AS s FROM mem WHERE n % 4 = 0 UNION ALL SELECT id, [1, -n] FROM mem WHERE n % 6 = 0) GROUP BY id")
def union_ids(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("rank", F.col("id").cast("long"))
    return aggregates.union_ids(rows.where("rank % 4 = 0"), rows.where("rank % 6 = 0").withColumn("rank", -F.col("rank")))


@query(f"WITH {MEM} SELECT DISTINCT project FROM mem WHERE n % 5 <> 2")
def result_projects(spark, sf_dir):
    return aggregates.result_projects(memories(spark, sf_dir).where("cast(id as long) % 5 <> 2"))


@query("SELECT DISTINCT 'a' || c_nationkey % 3 AS account, 'o' || c_nationkey AS org, 'u' || c_custkey % 50 AS \"user\" FROM customer WHERE c_custkey % 3 <> 0")
def partition_identities(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    scope = F.when(F.col("c_custkey") % 3 == 0, "shared").otherwise(F.concat(F.lit("users/u"), (F.col("c_custkey") % 50).cast("string")))
    return readers.partition_identities(c.select(F.concat(F.lit("a"), (F.col("c_nationkey") % 3).cast("string")).alias("account"), F.concat(F.lit("o"), F.col("c_nationkey").cast("string")).alias("org"), scope.alias("scope")))


@query(f"WITH {MEM} SELECT id, importance * CASE WHEN project = 'p2' THEN 3.0 ELSE 1.0 END AS score FROM mem")
def project_boost(spark, sf_dir):
    return retrieval.project_boost(memories(spark, sf_dir).withColumn("score", F.col("importance").cast("double")), "p2").select("id", "score")


@query("SELECT o_orderpriority AS k, sum(o_orderkey % 40) AS found, greatest(0, least(sum(o_orderkey % 40), 20000 - coalesce(sum(sum(o_orderkey % 40)) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS granted FROM orders GROUP BY 1")
def shared_budget(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source_order")).agg(F.sum(F.col("o_orderkey") % 40).alias("found"))
    return joins.shared_budget(o, 20_000).withColumnRenamed("source_order", "k")


@query(f"WITH {MEM} SELECT id, 1.0 + access_count AS stability, CASE WHEN layer = 1 THEN 0.0 ELSE round(CASE layer WHEN 2 THEN 0.01 WHEN 3 THEN 0.05 WHEN 4 THEN 0.1 ELSE 0.5 END / (1.0 + access_count), 9) END AS decay_rate FROM mem")
def stability_and_decay(spark, sf_dir):
    gets = F.col("access_count")
    return memories(spark, sf_dir).select("id", scores.stability_after(gets).alias("stability"), F.round(scores.decay_after(F.col("layer"), gets).cast("double"), 9).alias("decay_rate"))


@query("SELECT 'm' || event_id % 500 AS id, CAST(count(*) AS BIGINT) AS n, max(ts) AS at FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def mark_accessed(spark, sf_dir):
    results = _table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("m"), (F.col("event_id") % 500).cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    ops = state.mark_accessed(results, NOW)
    return ops.where("op is not null").groupBy("id").agg(F.count("*").alias("n")).join(results.groupBy("id").agg(F.max("ts").alias("at")), "id")


# replies of models


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN ['fact ' || doc_id, lang] END AS facts, CASE WHEN doc_id % 3 = 0 THEN ['r' || doc_id] END AS rules, CASE WHEN doc_id % 3 = 0 THEN 's' || lang END AS skill,
  CASE WHEN doc_id % 4 <> 1 THEN 'do ' || lang END AS wisdom, CASE WHEN doc_id % 4 <> 1 THEN lang END AS domain, CASE WHEN lang IN ('de', 'en') THEN lang END AS class FROM documents""")
def model_objects(spark, sf_dir):
    n, lang = F.col("doc_id"), F.col("lang")
    number = n.cast("string")
    facts = F.when(n % 3 == 0, F.concat(F.lit('```json\n["fact '), number, F.lit('","'), lang, F.lit('"]\n```'))).when(n % 3 == 1, F.concat(F.lit(' ["fact '), number, F.lit('", "'), lang, F.lit('"] '))).otherwise('{"a": 1}')
    rules = F.when(n % 3 == 0, F.concat(F.lit('{"rules":["r'), number, F.lit('"],"skills":[{"content":"s'), lang, F.lit('","tags":"t"}]}'))).otherwise("{broken")
    wisdom = F.when(n % 4 == 1, '{"rule":" ","domain":"x"}').otherwise(F.concat(F.lit('{"rule":" do '), lang, F.lit(' ","tags":"","domain":"'), lang, F.lit('"}')))
    reply = F.when(n % 4 == 0, F.concat(F.lit('"'), F.upper(lang), F.lit('"'))).when(n % 4 == 1, lang).when(n % 4 == 2, F.concat(F.lit("```\n'"), lang, F.lit("'\n```"))).otherwise(F.concat(F.lit('{"domain":"'), lang, F.lit('"}')))
    out = _table(spark, sf_dir, "documents").select("doc_id", replies.parse_facts(facts).alias("facts"), replies.parse_rules_skills(rules).alias("r"), replies.parse_wisdom(wisdom).alias("w"), replies.parse_classification(reply, "domain", ["De", "en"]).alias("c"))
    return out.select("doc_id", "facts", F.col("r.rules").alias("rules"), F.get("r.skills", F.lit(0))["content"].alias("skill"), F.col("w.content").alias("wisdom"), F.col("w.attrs")["domain"].alias("domain"), F.col("c")["domain"].alias("class"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ['/w/' || role] WHEN 1 THEN [] ELSE ['/w/' || role, '/e'] END AS paths FROM conversations")
def file_paths(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    first = F.concat(F.lit('{"type":"tool_use","name":"Read","input":{"file_path":"/w/'), "role", F.lit('"}}'))
    other = F.lit('{"type":"tool_use","name":"Bash","input":{"file_path":"/no"}},{"type":"text","text":"x"}')
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), first, F.lit(","), other, F.lit("]"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("["), other, F.lit("]")))
    raw = raw.otherwise(F.concat(F.lit("["), first, F.lit(',{"type":"tool_use","name":"Edit","input":{"file_path":"/e"}}]')))
    return c.select("conv_id", "turn", replies.extract_file_paths(raw).alias("paths"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN TIMESTAMP '2024-01-15 12:00:00' + to_hours(CAST(doc_id % 24 AS INTEGER)) END AS created_at, doc_id % 3 = 2 AS bad, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE lang END AS source, source AS agent FROM documents")
def attrs_of_new_rows(spark, sf_dir):
    n = F.col("doc_id")
    at = F.when(n % 3 != 2, F.date_format(F.timestamp_seconds(F.lit(1705320000) + (n % 24) * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a date")
    d = _table(spark, sf_dir, "documents").withColumn("b", replies.backdate(F.create_map(F.lit("created_at"), at, F.lit("source"), F.col("lang"))))
    merged = replies.merge_source_attrs(F.col("b.attrs"), F.when(n % 2 == 0, "web").otherwise(""), F.col("source"))
    return d.select("doc_id", F.col("b.created_at").alias("created_at"), F.col("b.bad").alias("bad"), merged["source"].alias("source"), merged["agent"].alias("agent"))


# texts

_CUT = "CASE WHEN octet_length(encode(text)) <= {n} THEN text ELSE (SELECT max(left(text, k)) FROM range({low}, {high}) r(k) WHERE octet_length(encode(left(text, CAST(k AS INTEGER)))) <= {m}) || {mark} END"


def _cut(n: int, m: int, mark: str) -> str:
    return _CUT.format(n=n, low=m // 4, high=m + 1, m=m, mark=mark)


@query(f"SELECT doc_id, {_cut(90, 87, chr(39) + '...' + chr(39))} AS brief, {_cut(70, 70, 'chr(10) || chr(10) || ' + chr(39) + '... [diff truncated]' + chr(39))} AS diff FROM documents")
def truncated_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_ellipsis(F.col("text"), 90).alias("brief"), text.truncate_diff(F.col("text"), 70).alias("diff"))


@query(f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), ' {{2,}}', ' ', 'g')) AS text FROM documents), h AS (SELECT doc_id, text, {_cut(280, 280, "''")} AS head FROM d)
SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 280 THEN text ELSE (CASE WHEN contains(head, ' ') THEN left(head, length(head) - strpos(reverse(head), ' ')) ELSE head END) || '…' END AS short FROM h""")
def condensed(spark, sf_dir):
    body = F.concat(F.lit("# Title\n\n## Part\n\n"), F.trim(F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " {2,}", " ")), F.lit("\n\nmore"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.condense(body).alias("short"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN list_transform(string_split(text, chr(10)), lambda x: '# ' || x || chr(10)) WHEN 1 THEN [text || 'x'] ELSE list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: 'a: ' || x || chr(10)) END AS chunks FROM documents WHERE text <> ''")
def document_chunks(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text <> ''")
    n, lines = F.col("doc_id") % 3, F.split("text", "\n")
    path = F.when(n == 0, "a.MD").when(n == 1, "a.txt").otherwise("a.yaml")
    headed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("# "), x)), "\n")
    yaml = F.array_join(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(F.lit("a: "), x)), "\n---\n")
    return d.select("doc_id", text.split_chunks(path, F.when(n == 0, headed).when(n == 1, F.concat("text", F.lit("x"))).otherwise(yaml)).alias("chunks"))


@query("SELECT doc_id, '2024-01-0' || doc_id % 9 || '_' || trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')[1:80] || '__' || doc_id || '.md' AS name FROM documents")
def output_names(spark, sf_dir):
    day = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9).cast("string"), F.lit("T10:00"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.doc_output_name(F.col("text"), F.col("doc_id").cast("string"), day).alias("name"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'o' || s_suppkey % 7 || '/r' || s_suppkey END AS repo FROM supplier")
def remotes(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("o"), (k % 7).cast("string"), F.lit("/r"), k.cast("string"))
    url = F.when(k % 4 == 0, F.concat(F.lit("https://host.org/"), name, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("git@host.org:"), name, F.lit(".git"))).when(k % 4 == 2, F.concat(F.lit("https://host.org/"), name)).otherwise(F.concat(F.lit("https://host.org/x/"), name))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", text.parse_remote(url).alias("repo"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'diff ' || doc_id || chr(10) || '+' || lang END AS patch FROM documents")
def patches(spark, sf_dir):
    body = F.concat(F.lit("\ndiff "), F.col("doc_id").cast("string"), F.lit("\n+"), "lang", F.lit(" \n"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("no patch "), "text")).otherwise(F.concat(F.lit("here: <patch>"), body, F.lit("</patch> and <patch>other</patch>")))
    return _table(spark, sf_dir, "documents").select("doc_id", text.extract_patch(reply).alias("patch"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT doc_id, {_quoted(text.PROMPTS['tags'].split('{text}')[0])} || text || {_quoted(text.PROMPTS['tags'].split('{text}')[1])} AS prompt, 'Repo: ' || lang || chr(10) || 'Author: ' || source || chr(10) || 'Title: t' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Description:' || chr(10) || 'why' || chr(10) || chr(10) ELSE '' END || 'Diff:' || chr(10) || '+x' AS change FROM documents")
def prompts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    change = text.pull_request_text(F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, " why "), F.lit("+x"))
    return d.select("doc_id", text.prompt("tags", F.col("text")).alias("prompt"), change.alias("change"))


@query(f"WITH {MEM}, d AS (SELECT id, content AS text FROM mem) SELECT id, {_cut(300, 297, chr(39) + '...' + chr(39))} AS brief FROM d")
def brief_results(spark, sf_dir):
    return search.brief_results(memories(spark, sf_dir), const_completer(" ")).select("id", "brief")


# transcripts and observations


@query("SELECT '/w/' || conv_id AS cwd, turn AS line_no, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND turn > 0 AND text <> ''")
def transcript_dialect_c(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    ident = F.col("conv_id").cast("string")
    header = F.concat(F.lit('{"type":"session","id":"c'), ident, F.lit('","cwd":"/w/'), ident, F.lit('"}'))
    message = F.to_json(F.struct(F.lit("message").alias("type"), F.lit("m").alias("id"), "role", F.col("text").alias("content")))
    lines = c.select(F.concat(F.lit("/x/.wllr/"), ident).alias("file"), F.col("turn").alias("line_no"), F.when(F.col("turn") == 0, header).otherwise(message).alias("value"))
    return readers.carry_headers(readers.parse_lines(lines)).where("content is not null").select("cwd", "line_no", "content")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'A' END AS dialect FROM events")
def dialects(spark, sf_dir):
    n = F.col("event_id")
    path = F.concat(F.when(n % 3 == 0, "/u/.pi/agent/sessions/").when(n % 3 == 1, "/u/.wllr/").otherwise("/u/talks/"), n.cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", readers.detect_format(path).alias("dialect"))


@query(f"SELECT CAST(5 AS INTEGER) AS layer, event_type || event_id AS content, sha256(event_type || event_id) AS content_hash, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '{NOW}' END AS created_at FROM events")
def observations(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.concat("event_type", F.col("event_id").cast("string")).alias("content"), F.lit("x").alias("agent"), F.create_map(F.lit("a"), F.lit("b")).alias("attrs"), F.lit(0.5).alias("valence"), F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp")).alias("created_at"))
    return readers.observations(rows, NOW).select("layer", "content", "content_hash", "created_at")


@query(f"WITH {MEM}, {EDG} SELECT count(*) FILTER (n % 6 = 0 OR content = '') AS bad_memories, (SELECT count(*) FROM edges WHERE weight >= 0.65) AS bad_edges FROM mem")
def invalid_export(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("layer", (F.col("id").cast("long") % 6).cast("int"))
    edges = edge_table(spark, sf_dir).withColumn("edge_type", F.when(F.col("weight") < 0.65, F.col("edge_type")).otherwise(""))
    return readers.invalid_export(rows, edges)
