"""A stream of the lines of files that grow.

The offset of the stream is a map of file to bytes read. It always lies between two lines: a line counts as whole when its line end is there, or, at the end of a file, when it is a JSON object that is closed.
Half a line waits for its rest. A batch is what lies between two offsets, so it can be read again, and long stretches are cut into partitions by bytes.

A file that got shorter, or whose first line is another one, was written anew and is read from its start. (A file that is replaced by a longer one with the same first line looks like one that grew.)
Files are listed and read by pyarrow's file systems: local folders, HDFS and object stores.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes to a partition, bytes that are read at once, and bytes of a first line that tell files apart.
SPLIT_BYTES, STEP_BYTES, HEAD_BYTES = 64 << 20, 1 << 20, 4096
SCHEMA = "file string, at long, value string"


class Stretch(InputPartition):
    """The lines of a file that begin within [start, end), which end by ``stop``."""

    def __init__(self, path: str, start: int, end: int, stop: int, first: bool):
        self.path, self.start, self.end, self.stop, self.first = path, start, end, stop, first


def _whole_until(file, size: int, known: int) -> int:
    """Where the last whole line ends; nothing before ``known``, which is such a place, is read."""
    at, tail = size, b""
    while at > known:
        step = min(STEP_BYTES, at - known)
        at -= step
        file.seek(at)
        part = file.read(step)
        cut = part.rfind(b"\n")
        if cut >= 0:
            tail, at = part[cut + 1 :] + tail, at + cut + 1
            break
        tail = part + tail
    if tail.strip():
        try:
            return size if isinstance(json.loads(tail), dict) else at
        except ValueError:
            return at
    return at


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.known = path, split_bytes, {}

    def _open(self):
        if "://" in self.path or self.path.startswith("file:"):
            return pa.fs.FileSystem.from_uri(self.path)
        return pa.fs.LocalFileSystem(), self.path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, root = self._open()
        out = {}
        for info in system.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not info.size or info.base_name.startswith((".", "_")):
                continue
            size, at, head = self.known.get(info.path, (0, 0, None))
            if size != info.size or info.size <= HEAD_BYTES:
                with system.open_input_file(info.path) as file:
                    first = file.read(HEAD_BYTES)
                    own = zlib.crc32(first.split(b"\n", 1)[0])
                    again = own != head or info.size < size
                    at = _whole_until(file, info.size, 0 if again else at)
                self.known[info.path] = (info.size, at, own)
                head = own
            if at:
                out[info.path] = [at, head]
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, out = json.loads(start["files"]), []
        for path, (stop, head) in json.loads(end["files"]).items():
            at, old = before.get(path, (0, head))
            begin = at if old == head and at <= stop else 0
            for lo in range(begin, stop, self.split_bytes):
                out.append(Stretch(path, lo, min(stop, lo + self.split_bytes), stop, lo == begin))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = partition
        system, _ = self._open()
        with system.open_input_file(p.path) as file:
            # a line that runs on from the stretch before is that stretch's
            at = p.start if p.first else p.start - 1
            file.seek(at)
            held, begin, skip = b"", at, not p.first
            while begin < p.end and at < p.stop:
                part = file.read(min(STEP_BYTES, p.stop - at))
                if not part:
                    return
                at += len(part)
                lines = (held + part).split(b"\n")
                held = lines.pop()
                for line in lines:
                    if not skip and begin < p.end and line.strip():
                        yield p.path, begin, line.decode("utf-8", "replace")
                    skip, begin = False, begin + len(line) + 1
            if held.strip() and not skip and begin < p.end:
                yield p.path, begin, held.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format ``growing_lines``: option ``path``, and ``splitBytes`` for the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def growing_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream ``(file, line_no, value)`` of the lines of all files below a folder, those of known files that were appended too; ``line_no`` is the byte at which a line begins. Empty lines and files whose names begin with a dot or underscore
    are left out, bytes that are no UTF-8 become U+FFFD."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("splitBytes", split_bytes).option("path", path).load()
    return lines.select("file", F.col("at").alias("line_no"), "value")
