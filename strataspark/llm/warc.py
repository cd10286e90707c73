"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A crawl file that is one gzip stream can't be read from the middle. :func:`normalise` inflates each such file once, front to back in a bounded
window, and rewrites every record as a gzip member of its own beside a sidecar index of offsets; :func:`read_records` then opens any record by
(file, offset, length). Files go to a folder that all executors share, through its file system; a task names its file with a unique name and only names that
tasks return are read, so repeated or lost tasks leave nothing but unused files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.scratch import materialise

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: A written file is closed beyond so many bytes before compression.
FILE_BYTES = 128 << 20
#: Payloads are handed on beyond so many bytes together.
BATCH_BYTES = 32 << 20
#: Fixed value: the date of records whose source gives none.
DATE = "1970-01-01T00:00:00Z"
_STEP = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)``, one row per page.

    The payload is the page in UTF-8 (null: empty). Among equal payloads of ``min_revisit_bytes`` or more the page with the largest id is the response that the others revisit. Only ids, sizes and digests
    are grouped; the largest id of a digest is combined before the shuffle. Rows that repeat an id and payload are alike. Null ids are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.where("page_id is not null").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= min_revisit_bytes).select("page_id", "payload_digest")
    tops = large.groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top").drop("low")
    again = large.join(tops, "payload_digest").where("page_id < top").select(F.col("page_id").alias("_again"), F.col("payload_digest").alias("_digest"), F.col("top").alias("refers_to")).distinct()
    again = materialise(again, "revisits")  # written, so that Spark knows its size and broadcasts it only within its limit
    out = rows.join(again, (F.col("page_id") == F.col("_again")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_again", "_digest")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _record(page: int, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers: int | None) -> bytes:
    """A record: headers, block, two line ends. Revisits have no payload, but its digest and length."""
    block = _HTTP + payload if kind == "response" else _HTTP
    safe = "".join(c if 32 < ord(c) != 127 else "%{:02X}".format(ord(c)) for c in url) if url else f"urn:page:{page}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {safe}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str):
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write records (of :func:`plan_records`) as archives that are one gzip stream each; returns ``(uri, records)`` of the files. Lazy: write the result once."""

    def run(batches):
        where, path = _open(folder)
        name = out = pack = None
        count = size = 0
        done = []

        def close():
            out.write(pack.flush())
            out.close()
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"crawl-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, pack = where.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                data = _record(*row)
                out.write(pack.compress(data))
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["uri", "records"])

    columns = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records.select(*columns).mapInArrow(run, "uri string, records long")


def _inflate(file) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of any number of members, in pieces of bounded size."""
    unpack, begun = zlib.decompressobj(31), False
    while data := file.read(_STEP):
        while data:
            begun = True
            yield unpack.decompress(data, _STEP)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, begun = unpack.unused_data, zlib.decompressobj(31), False
    while begun and not unpack.eof:
        piece = unpack.decompress(unpack.unconsumed_tail, _STEP)
        if not piece and not unpack.eof:
            raise ValueError("the archive ends within a gzip member")
        yield piece


class _Window:
    """Bytes of a stream, by line or by count, with no more in memory than asked for at once."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end of the stream."""
        while True:
            self.held = self.held.lstrip(b"\r\n") if self.held[:1] in (b"\r", b"\n") else self.held
            at = self.held.find(b"\r\n\r\n")
            if at >= 0 and self.held:
                out, self.held = self.held[: at + 4], self.held[at + 4 :]
                return out
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's header")
                return None

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in pieces."""
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if ":" in line)}


_INDEX = "uri string, offset long, length long, record_id string, warc_type string"


def normalise(files: DataFrame, folder: str, uri_col: str = "uri") -> DataFrame:
    """Rewrite archives record by record; returns the sidecar index ``(uri, offset, length, record_id, warc_type)``, one row per record.

    A file is read once, by one task, and neither it nor a record is held whole. Beside each new archive lies ``<archive>.idx``, its part of the index as tab-separated lines. Input may be one member or many;
    an archive that breaks off raises. Lazy: write the result once. Null file names are left out.
    """

    def run(batches):
        where, path = _open(folder)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                source, at = fs.FileSystem.from_uri(uri)
                name = f"records-{uuid.uuid4().hex}.warc.gz"
                index = []
                with source.open_input_stream(at, compression=None) as file, where.open_output_stream(f"{path}/{name}", compression=None) as out, where.open_output_stream(f"{path}/{name}.idx") as side:
                    window, offset = _Window(_inflate(file)), 0
                    while (head := window.head()) is not None:
                        kind = _headers(head)
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        length = out.write(pack.compress(head))
                        for part in window.take(int(kind["content-length"])):
                            length += out.write(pack.compress(part))
                        length += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                        row = (f"{folder}/{name}", offset, length, kind.get("warc-record-id", ""), kind.get("warc-type", ""))
                        side.write("\t".join(map(str, row[1:])).encode() + b"\n")
                        index.append(row)
                        offset += length
                        if len(index) >= 10_000:
                            yield _batch(index)
                            index = []
                yield _batch(index)

    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uri", "offset", "length", "record_id", "warc_type"])

    uris = files.select(F.col(uri_col).cast("string").alias("uri")).where("uri is not null")
    return uris.repartition(uris.count() or 1).mapInArrow(run, _INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """``(record_id, warc_type, url, refers_to, stated_digest, stated_bytes, payload)`` of the records that an index (or any part of one) points at.

    Each is read from its offset alone, a record at a time; payloads go on once they are BATCH_BYTES together. The payload is what follows the HTTP head of the block; revisits have an empty one. A record that the index has
    more than once is read as often.
    """

    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["record_id", "warc_type", "url", "refers_to", "stated_digest", "stated_bytes", "payload"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k)for i, k in enumerate(kinds)], names)

    def run(batches):
        last = file = None
        rows, held = [], 0
        for batch in batches:
            for uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if uri != last:
                    source, at = fs.FileSystem.from_uri(uri)
                    last, file = uri, source.open_input_file(at)
                file.seek(offset)
                data = zlib.decompress(file.read(length), 31)
                cut = data.index(b"\r\n\r\n") + 4
                head = _headers(data[:cut])
                payload = data[cut : cut + int(head["content-length"])].partition(b"\r\n\r\n")[2]
                rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest"), int(head.get("warc-x-payload-length", len(payload))), payload))
                held += len(payload)
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield packed(rows)
                    rows, held = [], 0
        yield packed(rows)

    schema = "record_id string, warc_type string, url string, refers_to string, stated_digest string, stated_bytes long, payload binary"
    return index.select("uri", "offset", "length").mapInArrow(run, schema)
