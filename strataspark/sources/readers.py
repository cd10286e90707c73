"""Readers: partitioned memories, exports, transcripts, documents, spans, observations, work items. All lazy, all by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspark.functions.replies import extract_content, extract_file_paths
from strataspark.functions.text import base64_to_hex, comment_text, content_hash, ext_match, issue_text, otlp_value, path_accepted, span_text, split_chunks
from strataspark.operators.aggregates import carry_forward
from strataspark.operators.filters import active, layers_in, partition_since, since
from strataspark.schema import EDGES, MEMORIES

EXPORT_MEMORY = """id string, layer int, content string, content_hash string, importance float, access_count int, created_at timestamp, updated_at timestamp, last_accessed_at timestamp,
 decay_rate float, stability float, source string, agent string, compacted_at timestamp, valence float, valence_scored boolean, embedding_model string, embedding array<float>, attrs map<string,string>"""
OBSERVATION = "content string, agent string, attrs map<string,string>, valence float, created_at timestamp"
_ANY = "array<struct<key: string, value: struct<stringValue: string, intValue: long, boolValue: boolean>>>"
OTLP = f"""resourceSpans array<struct<resource: struct<attributes: {_ANY}>, scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string,
 name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int>, attributes: {_ANY}>>>>>>"""
PROBLEM = """repo string, instance_id string, base_commit string, patch string, test_patch string, problem_statement string, hints_text string, created_at string, version string,
 FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>"""


def read_memories(spark: SparkSession, path: str, layer: int | None = None, active_only: bool = True) -> DataFrame:
    """Stored rows, oldest first."""
    rows = spark.read.schema(MEMORIES).parquet(path)
    rows = layers_in(rows, None if layer is None else [layer])
    return (active(rows) if active_only else rows).orderBy("created_at", "id")


def read_partitioned(spark: SparkSession, path: str, account: str, org: str, scopes: list[str] | None = None, layers: list[int] | None = None, at=None) -> DataFrame:
    """Rows of the partitions of an account and org (and scopes, layers, days from ``at``), then those made since ``at``."""
    # names such as 007 stay texts
    found = spark.read.option("basePath", path).parquet(path).schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("account", "org", "scope") else f for f in found])
    rows = spark.read.schema(texts).option("basePath", path).parquet(path).where((F.col("account") == account) & (F.col("org") == org))
    if scopes:
        rows = rows.where(F.col("scope").isin(list(scopes)))
    rows = layers_in(rows, layers)
    return since(partition_since(rows, None if at is None else str(at)[:10]), at)


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Memories and edges of an exported archive; an unreadable line raises when read. :func:`invalid_export` finds the rows that don't qualify."""
    read = spark.read.option("mode", "FAILFAST")
    return read.schema(EXPORT_MEMORY).json(f"{path}/memories"), read.schema(EDGES).json(f"{path}/edges")


def _valid_memory() -> Column:
    return F.coalesce((F.col("id") != "") & F.col("layer").between(1, 5) & (F.col("content") != ""), F.lit(False))


def valid_export(memories: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = F.coalesce((F.col("from_id") != "") & (F.col("to_id") != "") & (F.col("edge_type") != ""), F.lit(False))
    return memories.where(_valid_memory()), edges.where(keys)


def invalid_export(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many memories and edges are invalid."""
    good, joined = valid_export(memories, edges)
    count = lambda all_, ok, name: all_.agg(F.count("*").alias("a")).join(ok.agg(F.count("*").alias("b")), F.lit(True)).select((F.col("a") - F.col("b")).alias(name))
    return count(memories, good, "bad_memories").join(count(edges, joined, "bad_edges"), F.lit(True))


def detect_format(path: Column) -> Column:
    """Dialect of a transcript by its path: B, C, else A."""
    return F.when(F.contains(path, F.lit("/.pi/agent/sessions/")), "B").when(F.contains(path, F.lit("/.wllr/")), "C").otherwise("A")


_LINE_A = "type string, timestamp timestamp, sessionId string, cwd string, message struct<role: string>"
_LINE_BC = "type string, id string, cwd string, role string, timestamp timestamp, message struct<role: string>"


def parse_lines(lines: DataFrame, dialect: Column | str | None = None) -> DataFrame:
    """Lines ``(file, line_no, value)`` of transcripts as ``(file, line_no, dialect, header, content, session, cwd, ts, paths)``.

    ``content`` is null for lines that aren't stored. Header lines (dialects B and C) carry session and cwd, which :func:`carry_headers` hands on. Bad JSON is a line that isn't stored. Files touched by assistants' tools are in ``paths``.
    """
    kind = detect_format(F.col("file")) if dialect is None else F.lit(dialect) if isinstance(dialect, str) else dialect
    out = lines.withColumn("dialect", kind)
    a, b = F.from_json("value", _LINE_A), F.from_json("value", _LINE_BC)
    out = out.withColumns({"_a": a, "_b": b, "_raw": F.get_json_object("value", "$.message.content"), "_own": F.get_json_object("value", "$.content")})
    is_json = F.try_parse_json("value").isNotNull()
    # get_json_object gives a string's text without quotes: quote it again, so that a string is told from an array
    text = lambda c, path: F.when(F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), path, "variant")), F.lit("STRING")), F.to_json(F.array(c)))

    def content(c, path, **how):
        quoted = text(F.col(c), path)
        plain = F.regexp_extract(quoted, r"(?s)^\[(.*)\]$", 1)
        return extract_content(F.coalesce(plain, F.col(c)), **how)

    a_ok = is_json & F.col("_a.type").isin("user", "assistant") & F.col("_a.message").isNotNull() & (F.coalesce("_a.message.role", F.lit("")) != "system")
    b_ok = is_json & (F.col("_b.type") == "message") & F.col("_b.message.role").isin("user", "assistant", "toolResult")
    c_ok = is_json & (F.col("_b.type") == "message") & F.col("_b.role").isin("user", "assistant")
    header = is_json & F.col("dialect").isin("B", "C") & (F.col("_b.type") == "session")
    body = (
        F.when((F.col("dialect") == "A") & a_ok, content("_raw", "$.message.content"))
        .when((F.col("dialect") == "B") & b_ok, content("_raw", "$.message.content", tool_results=False, text_limit=10_240))
        .when((F.col("dialect") == "C") & c_ok, content("_own", "$.content"))
    )
    session = F.when(F.col("dialect") == "A", F.col("_a.sessionId")).when((F.col("dialect") == "B") & header, F.col("_b.id"))
    cwd = F.when(F.col("dialect") == "A", F.col("_a.cwd")).when(header, F.col("_b.cwd"))
    none = F.array().cast("array<string>")
    paths = (
        F.when((F.col("dialect") == "A") & is_json & (F.col("_a.type") == "assistant"), extract_file_paths(F.col("_raw"), "A"))
        .when((F.col("dialect") == "B") & is_json & (F.col("_b.type") == "message") & (F.col("_b.message.role") == "assistant"), extract_file_paths(F.col("_raw"), "B"))
        .otherwise(none)
    )
    return out.select(
        "file", "line_no", "dialect", F.coalesce(header, F.lit(False)).alias("header"), F.nullif(body, F.lit("")).alias("content"), session.alias("session"), cwd.alias("cwd"),
        F.when(F.col("dialect") == "A", F.col("_a.timestamp")).alias("ts"), F.coalesce(paths, none).alias("paths"),
    )


def carry_headers(parsed: DataFrame) -> DataFrame:
    """Session and cwd of the last header before each line of dialects B and C; dialect A has its own on every line."""
    own = F.col("dialect") == "A"
    carried = carry_forward(parsed.withColumns({"_s": F.when(~own, F.col("session")), "_c": F.when(~own, F.col("cwd"))}), ["_s", "_c"])
    return carried.withColumns({"session": F.when(own, F.col("session")).otherwise(F.col("_s")), "cwd": F.when(own, F.col("cwd")).otherwise(F.col("_c"))}).drop("_s", "_c")


def read_transcripts(spark: SparkSession, path: str, dialect: str | None = None) -> DataFrame:
    """Stored lines of transcript files with their session and cwd. Line numbers are positions within a file, which is read whole."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return carry_headers(parse_lines(files.where("value <> ''"), dialect)).where("content is not null").drop("header", "paths")


def read_documents(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """``(path, content, hash)`` of the files below a folder that the globs accept; paths are relative."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    root = path.split("://")[-1].rstrip("/") + "/"
    rel = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + "\\Q" + root + "\\E", "")
    rows = files.select(rel.alias("path"), F.col("value").alias("content"))
    return rows.where(path_accepted(F.col("path"), include, exclude) & ext_match(F.col("path"), extensions)).withColumn("hash", content_hash(F.col("content")))


def document_chunks(documents: DataFrame, max_bytes: int = 600_000) -> DataFrame:
    """``(path, hash, part, parts, content)``: documents cut into parts that a model takes."""
    cut = documents.withColumn("_c", split_chunks(F.col("path"), F.col("content"), max_bytes))
    return cut.select("path", "hash", F.size("_c").alias("parts"), F.posexplode("_c").alias("part", "content"))


def parse_spans(requests: DataFrame, column: str = "value", ids: str = "base64") -> DataFrame:
    """Flat spans of OTLP/JSON requests: ids in hex, service, name, times, status, attributes, and the text that is stored.

    Ids are always taken as base64 (a hex id is valid base64 and comes out mangled); ``ids="hex"`` leaves them.
    """
    r = requests.select(F.explode(F.from_json(column, OTLP)["resourceSpans"]).alias("r"))
    named = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    value = lambda v: otlp_value(v["stringValue"], v["intValue"], v["boolValue"])
    service = F.coalesce(value(F.get(named, F.lit(0))["value"]), F.lit(""))
    s = r.select(service.alias("service_name"), F.explode("r.scopeSpans").alias("s")).select("service_name", F.explode("s.spans").alias("s"))
    hex_ = base64_to_hex if ids == "base64" else (lambda c: c)
    # of a repeated attribute the last counts
    pairs = F.coalesce("s.attributes", F.array().cast(_ANY))
    attrs = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, v: k != a["key"]), F.create_map(a["key"], value(a["value"]))))
    empty = lambda c: F.coalesce(c, F.lit(""))
    out = s.select(
        hex_(empty(F.col("s.traceId"))).alias("trace_id"), hex_(empty(F.col("s.spanId"))).alias("span_id"), hex_(empty(F.col("s.parentSpanId"))).alias("parent_span_id"), "service_name",
        empty(F.col("s.name")).alias("name"), F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0)).alias("start_nano"), F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0)).alias("end_nano"),
        F.coalesce("s.status.code", F.lit(0)).alias("status_code"), attrs.alias("attrs"),
    )
    return out.withColumn("content", span_text(F.col("service_name"), F.col("name"), F.col("start_nano"), F.col("end_nano"), F.col("status_code")))


def read_spans(spark: SparkSession, path: str, ids: str = "base64") -> DataFrame:
    return parse_spans(spark.read.text(path), ids=ids)


def observations(rows: DataFrame, now) -> DataFrame:
    """Observation records as rows of layer 5; ``created_at`` defaults to ``now``."""
    return rows.select(F.lit(5).alias("layer"), "content", content_hash(F.col("content")).alias("content_hash"), "agent", "attrs", "valence", F.coalesce("created_at", F.lit(now).cast("timestamp")).alias("created_at"))


def read_observations(spark: SparkSession, path: str, now) -> DataFrame:
    """A bad line rejects the batch."""
    return observations(spark.read.option("mode", "FAILFAST").schema(OBSERVATION).json(path), now)


def issue_rows(issues: DataFrame) -> DataFrame:
    """Issues ``(repo, number, title, body, state, html_url, updated_at, labels array<struct<name>>)`` as texts with attributes."""
    labels = F.array_join(F.transform("labels", lambda x: x["name"]), ",")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = issue_text(F.col("number"), empty("state"), empty("title"), F.col("repo"), F.coalesce(labels, F.lit("")), empty("html_url"), empty("body"))
    pairs = {"source": F.lit("github_issue"), "repo": F.col("repo"), "issue_number": F.col("number").cast("string"), "issue_url": empty("html_url"), "state": empty("state"), "project": F.col("repo"), "labels": F.coalesce(labels, F.lit(""))}
    attrs = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    return issues.select("repo", "number", "updated_at", content.alias("content"), F.map_filter(attrs, lambda k, v: v != "").alias("attrs"))


def comment_rows(comments: DataFrame) -> DataFrame:
    """Comments ``(repo, number, comment_id, author, body)`` as texts with attributes."""
    content = comment_text(F.col("repo"), F.col("number"), F.coalesce("author", F.lit("")), F.coalesce("body", F.lit("")))
    attrs = F.create_map(F.lit("source"), F.lit("github_comment"), F.lit("repo"), F.col("repo"), F.lit("issue_number"), F.col("number").cast("string"), F.lit("comment_id"), F.col("comment_id").cast("string"), F.lit("project"), F.col("repo"))
    return comments.select("repo", "number", "comment_id", content.alias("content"), attrs.alias("attrs"))


def pull_request_rows(merged: DataFrame, summary: str = "summary") -> DataFrame:
    """Merged requests with their summary as rows backdated to the merge."""
    attrs = F.create_map(F.lit("source"), F.lit("github_pr"), F.lit("repo"), F.col("repo"), F.lit("pr_number"), F.col("number").cast("string"), F.lit("author"), F.col("author"), F.lit("created_at"), F.col("merged_at"))
    return merged.select("repo", "number", F.col(summary).alias("content"), attrs.alias("attrs"))


def read_problems(spark: SparkSession, path: str, languages: DataFrame, language: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Problems whose repository has a language, by ``languages(repo, language)``; offset and limit count the filtered rows, in order of instance."""
    return select_problems(spark.read.schema(PROBLEM).json(path), languages, language, offset, limit)


def select_problems(problems: DataFrame, languages: DataFrame, language: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    own = problems.join(languages.where(F.col("language") == language).select("repo").distinct(), "repo", "left_semi").orderBy("instance_id").offset(offset)
    return own if limit is None else own.limit(limit)


def partition_identities(rows: DataFrame) -> DataFrame:
    """Distinct ``(account, org, user)`` of stored partitions; users come from scopes ``users/<name>``."""
    user = F.nullif(F.regexp_extract("scope", "^users[/_](.+)$", 1), F.lit(""))
    return rows.select("account", "org", user.alias("user")).where("user is not null").distinct()


def number_lines(lines: DataFrame, file: str, order: str) -> DataFrame:
    """Line numbers within a file from an order column."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1)
