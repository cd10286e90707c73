import json
import time

from pyspark.sql import functions as F

from strataspark.functions.models import const_completer, hash_embedder
from strataspark.plans import compact, context, enrich, search
from strataspark.schema import EDGES, MEMORIES
from strataspark.sources import readers, rich_docs
from strataspark.streaming import jobs
from tests.test_store import T, memory


def snapshot(spark, n=60, layer=5):
    v = lambda i: [1.0, 0.01 * (i % 5), 0.0] if i % 2 else [0.0, 1.0, 0.01 * (i % 3)]
    rows = [memory(f"m{i:03d}", layer, hour=i % 20, embedding=v(i) if i < 34 else None, attrs={"project": "p" if i % 3 else "q"}) for i in range(n)]
    return spark.createDataFrame(rows, MEMORIES), spark.createDataFrame([], EDGES)


def test_compaction(spark):
    rows, edges = snapshot(spark)
    now = "2024-01-05"
    assert compact.compaction_trigger(rows, now).first().due
    out = compact.compact_l5_l4(rows, const_completer("summary"), now)
    made = out.made.collect()
    assert sorted(len(m.source_ids) for m in made) == [6, 17, 17, 20] and out.dead.count() == 60 and out.edges.count() == 60
    assert all(m.attrs["source"] == "compactor" and m.attrs["window_start"] <= m.attrs["window_end"] for m in made)
    reply = json.dumps({"rules": ["always test", "be kind"], "skills": [{"content": "knit", "tags": "wool"}]})
    seeds = compact.seed_upper_layers(rows, edges, const_completer(reply), now)
    assert sorted((m.layer, m.content) for m in seeds.made.collect()) == [(2, "always test")] * 2 + [(2, "be kind")] * 2 + [(3, "knit")] * 2 and seeds.dead.count() == 0
    after, linked, report = compact.run_compaction(rows, edges, const_completer("summary"), now)
    assert {r.path: (r.made, r.sources) for r in report.collect()} == {"l5-l4": (4, 60)}
    live = {r.layer: r.live for r in after.where("compacted_at is null").groupBy("layer").agg(F.count("*").alias("live")).collect()}
    assert live == {4: 1} and linked.count() == 60
    # four clusters got one summary: its row is one, and all lineage starts there
    ids = {r.id for r in after.collect()}
    assert {r.from_id for r in linked.collect()} == {r.id for r in after.where("layer = 4").collect()} and {r.to_id for r in linked.collect()} == {f"m{i:03d}" for i in range(60)} < ids
    known = rows.unionByName(spark.createDataFrame([memory("old", 4, content="summary", content_hash=made[0].content_hash)], MEMORIES))
    again, lineage = compact.apply_rollup(known, edges, out, now)
    assert {r.from_id for r in lineage.collect()} == {"old"} and again.count() == 61
    l3 = spark.createDataFrame([memory("k", 3, access_count=12, importance=8.0), memory("l", 3, access_count=2, importance=8.0)], MEMORIES)
    wise = compact.promote_l3_l2(l3, edges, const_completer('{"rule":"r","tags":"t","domain":"d"}'), now)
    assert [(m.content, m.source_ids) for m in wise.made.collect()] == [("r", ["k"])] and wise.edges.first().edge_type == "derived_from"
    l4, _ = snapshot(spark, 12, 4)
    skill = compact.compact_l4_l3(l4, const_completer("how to"), now, keep_centroid=True)
    assert [len(m.source_ids) for m in skill.made.collect()] == [6, 6] and all(m.embedding for m in skill.made.collect())


def test_search_batched_equals_single_and_expansion(spark):
    texts = ["apple pie with cream", "apple tart", "pear cake", "cake of apples and pears", "steel bridge"]
    rows = spark.createDataFrame([memory(f"m{i}", i % 5 + 1, content=t, embedding=hash_embedder(8)([t])[0], valence=(i - 2) / 4) for i, t in enumerate(texts)], MEMORIES)
    queries = spark.createDataFrame([(0, "apple pie"), (1, "cake"), (2, "nothing at all")], "query_id int, query string")
    how = search.Search(top_k=3)
    both = {(r.query_id, r.rank, r.id) for r in search.hybrid_search(rows, queries, "2024-01-01 02:00:00", how, hash_embedder(8)).collect()}
    single = set()
    for q in range(3):
        single |= {(r.query_id, r.rank, r.id) for r in search.hybrid_search(rows, queries.where(f"query_id = {q}"), "2024-01-01 02:00:00", how, hash_embedder(8)).collect()}
    assert both == single and len(both) == 9
    wide = search.hybrid_search(rows, queries.where("query_id = 2"), "2024-01-01 02:00:00", how, completer=const_completer('["steel bridge"]'))
    assert [r.id for r in wide.collect()] == ["m4"]
    assert {r.layer for r in search.hybrid_search(rows, queries, "2024-01-01 02:00:00", search.Search(layers=(2,)), hash_embedder(8)).collect()} == {2}
    block = context.context_block(rows, spark.createDataFrame([], EDGES), queries.where("query_id = 0"), "2024-01-01 02:00:00", "build", embedder=hash_embedder(8))
    assert {r.section for r in block.collect()} == {"principles", "techniques", "workspace"} and "## Build" in context.render_context(block).first().text


def test_enrichment(spark):
    rows = spark.createDataFrame([memory("a", attrs={}, valence_scored=False), memory("b", attrs={"tags": "x"}, valence_scored=True)], MEMORIES)
    assert [(r.id, r.number) for r in enrich.backfill_valence(rows, const_completer("0.5"), "2024-02-01").collect()] == [("a", 0.5)]
    attributes = rows.select(F.col("id").alias("mem_id"), F.explode("attrs").alias("key", "value"))
    assert [(r.id, r.value) for r in enrich.backfill_tags(rows, attributes, const_completer('["T"]'), "2024-02-01").collect()] == [("a", "t")]
    vectors = spark.createDataFrame([], "id string, embedding array<float>, model string")
    assert {r.id for r in enrich.backfill_embeddings(rows, vectors, hash_embedder(4), "m", "2024-02-01").collect()} == {"a", "b"}
    ops, counts = enrich.classify_layer(rows, 5, "domain", ["go"], const_completer("Go"), "2024-02-01")
    assert counts.first().asDict() == {"total": 2, "skipped": 0, "tagged": 2, "failed": 0} and ops.count() == 4
    made, links = enrich.enrich(rows, rows.where("id = 'a'"), spark.createDataFrame([], EDGES), hash_embedder(4), {k: const_completer("5") for k in ("importance", "tags", "valence")}, "m", "2024-02-01")
    assert {r.op for r in made.collect()} == {"embed", "importance", "valence"} and links.count() == 0


DIALECT_A = [
    '{"type":"user","message":{"role":"user","content":"where is the ford"},"sessionId":"s-77","cwd":"/land/river"}', '{"type":"queue-operation"}', '{"type":"user","message":{"role":"system","content":"rule"}}', '{"type":"user"}',
    '{"type":"user","message":{"role":"user","content":""}}', "no json at all", '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"below the mill"},{"type":"tool_use","name":"Read","input":{"file_path":"/maps/ford.txt"}}]}}',
    '{"type":"user","message":{"role":"user","content":"[2] so \\"it\\" is"}}',
]


def ended(query):
    """A stream over what is there ends by itself; if it doesn't within a minute, the test fails."""
    done = query.awaitTermination(120)
    query.stop()
    assert done


def test_transcripts(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / ".pi/agent/sessions"
    a.mkdir()
    b.mkdir(parents=True)
    (a / "one.jsonl").write_text("\n".join(DIALECT_A))
    pi = ['{"type":"session","version":3,"id":"walk-5","cwd":"/land/mill"}', '{"type":"message","id":"u1","message":{"role":"user","content":[{"type":"text","text":"who keeps the mill"},{"type":"thinking","text":"aside"}]}}', '{"type":"message","id":"u2","message":{"role":"assistant","content":[{"type":"toolCall","name":"read","arguments":{"path":"maps/mill.txt"}}]}}', '{"type":"message","id":"u3","message":{"role":"toolResult","content":"the miller"}}', '{"type":"message","id":"u4","message":{"role":"system","content":"quiet"}}']
    (b / "two.jsonl").write_text("\n".join(pi))
    got = [(r.content, r.session, r.cwd) for r in readers.read_transcripts(spark, str(a)).orderBy("line_no").collect()]
    assert got == [("where is the ford", "s-77", "/land/river"), ("below the mill", None, None), ('[2] so "it" is', None, None)]
    got = [(r.content, r.session, r.cwd) for r in readers.read_transcripts(spark, str(b)).orderBy("line_no").collect()]
    assert got == [("who keeps the mill", "walk-5", "/land/mill"), ("the miller", "walk-5", "/land/mill")]
    lines = spark.createDataFrame([("/x/.wllr/f", i, v) for i, v in enumerate(['{"type":"session","id":"walk-6","cwd":"/land/hill"}', '{"type":"message","id":"u5","role":"user","content":"how high is the hill"}', '{"type":"message","role":"tool","content":"ridge"}', '{"type":"tool_call"}'])], "file string, line_no int, value string")
    assert [(r.content, r.session, r.cwd) for r in readers.carry_headers(readers.parse_lines(lines)).where("content is not null").collect()] == [("how high is the hill", None, "/land/hill")]
    paths = readers.parse_lines(spark.createDataFrame([("f", i, v) for i, v in enumerate(DIALECT_A)], "file string, line_no int, value string"), "A").where("size(paths) > 0").first()
    assert paths.paths == ["/maps/ford.txt"]
    land = tmp_path / "land"
    for name, lines in {"a/one.jsonl": DIALECT_A, ".pi/agent/sessions/two.jsonl": pi}.items():
        (land / name).parent.mkdir(parents=True, exist_ok=True)
        (land / name).write_text("\n".join(lines))

    def ingest(source):
        ended(jobs.ingest_transcripts(spark, str(land / source), str(tmp_path / "out"), str(tmp_path / f"cp{len(source)}")))
        return sorted((r.content, r.session, r.cwd) for r in spark.read.parquet(str(tmp_path / "out")).fillna("").collect())

    first = [("[2] so \"it\" is", "", ""), ("below the mill", "", ""), ("where is the ford", "s-77", "/land/river")]
    assert ingest("a") == first
    (land / "a/three.jsonl").write_text(DIALECT_A[0] + "\n" + DIALECT_A[0].replace("ford", "bridge"))
    first = sorted([*first, ("where is the bridge", "s-77", "/land/river")])
    assert ingest("a") == first
    first = sorted([*first, ("who keeps the mill", "walk-5", "/land/mill"), ("the miller", "walk-5", "/land/mill")])
    assert ingest(".pi/agent/sessions") == first
    (land / ".pi/agent/sessions/two.1.jsonl").write_text('{"type":"message","id":"u6","message":{"role":"user","content":"and on"}}')
    assert ingest(".pi/agent/sessions") == sorted([*first, ("and on", "walk-5", "/land/mill")])


def test_state_across_batches(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()

    def run(name, stream):
        ended(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start(str(tmp_path / name)))
        return spark.read.parquet(str(tmp_path / name))

    def land(n, rows):
        (src / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))

    lines = lambda: spark.readStream.schema("file string, line_no int, value string").json(str(src))
    land(1, [{"file": "f", "line_no": 0, "value": '{"type":"session","id":"s","cwd":"/w"}'}, {"file": "f", "line_no": 1, "value": '{"type":"message","role":"user","content":"a","message":{"role":"user","content":"a"}}'}])
    assert [(r.content, r.session, r.cwd) for r in run("carry", jobs.carry_header_stream(lines(), "B")).collect()] == [("a", "s", "/w")]
    land(2, [{"file": "f", "line_no": 2, "value": '{"type":"message","message":{"role":"user","content":"b"}}'}])
    assert sorted((r.content, r.session) for r in run("carry", jobs.carry_header_stream(lines(), "B")).collect()) == [("a", "s"), ("b", "s")]


def test_span_stream_and_observations(spark, tmp_path):
    src, obs = tmp_path / "otlp", tmp_path / "obs"
    src.mkdir()
    obs.mkdir()

    def request(*spans):
        return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [{"traceId": t, "spanId": s, "name": "n", "startTimeUnixNano": str(k), "endTimeUnixNano": "5000000", "status": {"code": 1}} for k, (t, s) in enumerate(spans)]}]}]})

    (src / "1").write_text(request(("!t", "!a"), ("!t", "!b"), ("!u", "!c")))
    out = spark.readStream.text(str(src))
    for n, want in ((1, {("!b", "!a")}), (2, {("!b", "!a"), ("!d", "!a"), ("!d", "!b")})):
        if n == 2:
            (src / "2").write_text(request(("!t", "!d")))
        ended(jobs.write_stream(jobs.span_edge_stream(out, ttl_ms=None), str(tmp_path / "edges"), str(tmp_path / "cp")))
        assert {(r.from_id, r.to_id) for r in spark.read.parquet(str(tmp_path / "edges")).collect()} == want
    # with a time to live the stream goes on until it is stopped
    query = jobs.span_edge_stream(out).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start(str(tmp_path / "live"))
    until = time.time() + 90
    while time.time() < until and not (query.lastProgress and (tmp_path / "live/_spark_metadata").exists() and spark.read.parquet(str(tmp_path / "live")).count() == 3):
        time.sleep(1)
    query.stop()
    # both files are one batch here, whose spans come in order of their start: a, d, b
    assert {(r.from_id, r.to_id) for r in spark.read.parquet(str(tmp_path / "live")).collect()} == {("!b", "!a"), ("!d", "!a"), ("!b", "!d")}
    assert readers.read_spans(spark, str(src)).orderBy("start_nano").first().content == "[api] span: n duration=5ms status=OK"
    (obs / "1.json").write_text('{"content":"seen","agent":"x","attrs":{"a":"b"}}\n{"content":"later","created_at":"2024-03-01T00:00:00Z"}')
    ended(jobs.write_stream(jobs.observation_stream(spark, str(obs), "2024-01-01"), str(tmp_path / "o"), str(tmp_path / "cpo")))
    assert readers.read_observations(spark, str(obs), "2024-01-01").count() == 2
    assert sorted((r.content, r.layer, r.created_at) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("later", 5, T(2024, 3, 1)), ("seen", 5, T(2024, 1, 1))]


def test_rich_docs_and_documents(spark, tmp_path):
    para = lambda t, style="NORMAL_TEXT", **more: {"paragraph": {"elements": [{"textRun": {"content": t + "\n"}}], "paragraphStyle": {"namedStyleType": style}} | more}
    table = {"table": {"tableRows": [{"tableCells": [{"content": [para("Name")]}, {"content": [para("Value")]}]}, {"tableCells": [{"content": [para("a")]}, {"content": [para("1")]}]}]}}
    doc = json.dumps({"title": "T", "body": {"content": [{"sectionBreak": {}}, para("Head", "HEADING_2"), para("point", bullet={}), table]}})
    got = rich_docs.read_rich_docs(spark.createDataFrame([("i", "T", "2024", "l", doc), ("j", "U", "2024", "l", "broken")], "id string, name string, modified_time string, link string, doc string")).orderBy("id").collect()
    assert "## Head\n\n- point\n\n| Name | Value |\n| --- | --- |\n| a | 1 |" in got[0].content and got[1].content.startswith("---\ntitle: U")
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.md").write_text("# One\nx\n# Two\ny\n")
    (tmp_path / "d/sub/b.md").write_text("b")
    (tmp_path / "d/sub/c.txt").write_text("c")
    docs = readers.read_documents(spark, str(tmp_path / "d"), ["**/*.md"], ["sub/**"])
    assert [r.path for r in docs.collect()] == ["a.md"] and readers.document_chunks(docs).count() == 2


