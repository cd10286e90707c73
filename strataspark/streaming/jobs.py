"""Continuous ingestion by Structured Streaming. Keys are content hashes and state is bounded, so a restart from the checkpoint changes nothing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from strataspark.functions.text import content_hash
from strataspark.sources.growing import SPLIT_BYTES, growing_lines
from strataspark.sources.readers import OBSERVATION, detect_format, observations, parse_lines, parse_spans

#: Siblings of a trace that are remembered, and for how long.
SIBLINGS, TRACE_TTL_MS = 50, 3_600_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transcript_stream(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines ``(file, line_no, value)`` of transcripts below a folder: of new files, and what was appended to known ones (see :func:`growing_lines`).

    A transcript may also go on in segments, named as it with a number before the last dot (``talk.2.jsonl`` of ``talk.jsonl``, which counts as 0); ``file`` is the transcript, and line numbers grow from segment to segment.
    """
    lines = growing_lines(spark, path, split_bytes)
    number = F.coalesce(F.regexp_extract("file", r"\.(\d{1,6})\.[^./]*$", 1).try_cast("long"), F.lit(0))
    return lines.select(F.regexp_replace("file", r"\.\d{1,6}(\.[^./]*)$", "$1").alias("file"), (number * (1 << 42) + F.col("line_no")).alias("line_no"), "value")


class _Carry(StatefulProcessor):
    """Session and cwd of the last header of a file (two short texts a file)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "session string, cwd string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, cwd = self.last.get() if self.last.exists() else ("", "")
        # a flush of a file, put in order
        part = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        sessions, cwds = [], []
        for header, s, c in zip(part["header"], part["session"], part["cwd"], strict=True):
            if header:
                session, cwd = s or session, c or cwd
            sessions.append(session)
            cwds.append(cwd)
        part = part.assign(session=sessions, cwd=cwds)
        yield part[part["content"].notna()][["file", "line_no", "content", "session", "cwd"]]
        self.last.update((session or "", cwd or ""))

    def close(self) -> None:
        pass


def carry_header_stream(lines: DataFrame, dialect: str | None = None) -> DataFrame:
    """Stored lines of a stream ``(file, line_no, value)`` with the session and cwd of their file's last header, carried across batches."""
    parsed = parse_lines(lines, dialect).select("file", F.col("line_no").cast("long").alias("line_no"), "header", "content", "session", "cwd")
    return parsed.groupBy("file").transformWithStateInPandas(_Carry(), "file string, line_no long, content string, session string, cwd string", "Append", "None")


class _Siblings(StatefulProcessor):
    """The first SIBLINGS span ids of a trace, forgotten after a time (if one is given)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getValueState("ids", "ids array<string>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.ids.get()[0]) if self.ids.exists() else []
        for part in rows:
            out = []
            for span in part.sort_values(["start_nano", "span_id"], kind="stable")["span_id"]:
                if span in known:
                    continue
                out += [(span, other) for other in known]
                if len(known) < SIBLINGS:
                    known.append(span)
            yield pd.DataFrame(out, columns=["from_id", "to_id"]).assign(edge_type="same_trace", weight=1.0)
        self.ids.update((known,))

    def close(self) -> None:
        pass


def span_edge_stream(requests: DataFrame, column: str = "value", ids: str = "base64", ttl_ms: int | None = TRACE_TTL_MS) -> DataFrame:
    """Edges from each new span to the first spans of its trace, from a stream of OTLP requests.

    Traces are forgotten ``ttl_ms`` after their last spans, which needs a stream that goes on (a processing-time trigger): Spark keeps running empty batches for the clock, so ``availableNow`` doesn't end. With None nothing is forgotten and
    it does.
    """
    spans = parse_spans(requests, column, ids).select("trace_id", "span_id", "start_nano")
    return spans.groupBy("trace_id").transformWithStateInPandas(_Siblings(ttl_ms), "from_id string, to_id string, edge_type string, weight double", "Append", "None" if ttl_ms is None else "ProcessingTime")


def observation_stream(spark: SparkSession, path: str, now) -> DataFrame:
    return observations(spark.readStream.option("mode", "FAILFAST").schema(OBSERVATION).json(path), now)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, as Parquet; called again, what has come since."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _folders(spark: SparkSession, path: str, begin: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in system.listStatus(where) if f.getPath().getName().startswith(begin)] if system.exists(where) else []


def store_stream(lines: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Store texts ``(content, ...)`` once each: a batch is compared with what earlier batches stored and with itself, so no set of hashes lives in state.

    Rows lie in a folder ``stream=S/batch=N`` for each stream (told by its checkpoint) and batch, so that several may store in one place, and a batch that is run again after a crash writes its own folder anew. ``then`` gets the stored rows of a batch and its number, also where the
    crash came between the write and the call: no batch's call is lost, and a call that comes twice has the same number and the same rows.
    """
    spark, stream = lines.sparkSession, f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.withColumn("content_hash", content_hash(F.col("content"))).dropDuplicates(["content_hash"])
        own = f"{path.rstrip('/')}/stream={stream}/batch={number}"
        found = [f for f in _folders(spark, path, "stream=") for f in _folders(spark, f, "batch=")]
        earlier = [f for f in found if not f.split("/stream=")[-1].startswith(f"{stream}/") or int(f.rpartition("=")[2]) < number]
        if earlier:
            fresh = fresh.join(spark.read.parquet(*earlier).select("content_hash"), "content_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(own)
        if then is not None:
            then(spark.read.schema(fresh.schema).parquet(own), number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_transcripts(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Transcripts of all dialects to stored texts, in one pass over what has landed since the last call: new files, new segments and appended lines.

    Dialect A has session and cwd on every line and goes without state; those of B and C come from the last header of their transcript, which is carried over. A bad line is a line that isn't stored. A text is stored once.
    """
    lines = transcript_stream(spark, source)
    kind = detect_format(F.col("file"))
    plain = parse_lines(lines.where(kind == "A"), "A").where("content is not null").select("content", "session", "cwd")
    carried = carry_header_stream(lines.where(kind != "A")).select("content", "session", "cwd")
    return store_stream(plain.union(carried), path, checkpoint)
