"""The store's verbs over a log of changes in files, with its folded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators import aggregates, filters
from strataspark.operators.state import OPS, State, fold_state, mark_accessed, merge_states, ops_of, soft_delete, state_rows, tag
from strataspark.plans.search import Search, hybrid_search
from strataspark.schema import EDGES
from strataspark.scratch import materialise, new_path
from strataspark.sources.sinks import write_backup


class MemoryTable:
    """Rows kept as a log in a folder that all machines share. A verb that changes something writes its ops as the log's next segment; reading merges the last stored state with the segments since.

    After ``fold_every`` segments a new state is written, so what is read, and the plan of it, stay as they are however long the log gets. Nothing is deleted: older states and segments may be, once a newer state is there.
    One writer at a time; a table opened on the same ``path`` goes on from what is there. A segment or state that a crash left unfinished (without Spark's success mark) doesn't count and is written over.
    """

    def __init__(self, spark: SparkSession, ops: DataFrame | None = None, edges: DataFrame | None = None, embedder=None, path: str | None = None, fold_every: int = 16):
        self.spark, self.embedder, self.fold_every = spark, embedder, fold_every
        self.path = (path or new_path(spark, "memories")).rstrip("/")
        self.edges = spark.createDataFrame([], EDGES) if edges is None else edges
        self.segments, self.folded = self._done("log", "."), max(self._done("state", "pairs"), default=-1)
        if ops is not None:
            self._append(ops)

    def _done(self, kind: str, within: str) -> list[int]:
        """Numbers of the segments or states that are whole."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(top)] if system.exists(top) else []
        mark = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/{within}/_SUCCESS")
        return sorted(int(n) for n in names if n.isdigit() and system.exists(mark(n)))

    def _append(self, ops: DataFrame) -> None:
        number = max([*self.segments, self.folded]) + 1
        ops.write.mode("overwrite").parquet(f"{self.path}/log/{number:012d}")
        self.segments.append(number)
        if number - self.folded >= self.fold_every:
            self.fold()

    def state(self) -> State:
        """The last stored state, and what the segments since say."""
        since = [f"{self.path}/log/{n:012d}" for n in self.segments if n > self.folded]
        new = fold_state(self.spark.read.schema(OPS).parquet(*since) if since else self.spark.createDataFrame([], OPS))
        if self.folded < 0:
            return new
        old = State(*(self.spark.read.schema(own.schema).parquet(f"{self.path}/state/{self.folded:012d}/{name}") for name, own in zip(State._fields, new, strict=True)))
        return merge_states(old, new) if since else old

    def fold(self) -> None:
        """Write the state of all segments so far. Its last table marks it as whole."""
        if not self.segments or self.segments[-1] == self.folded:
            return
        for name, table in zip(State._fields, self.state(), strict=True):
            table.write.mode("overwrite").parquet(f"{self.path}/state/{self.segments[-1]:012d}/{name}")
        self.folded = self.segments[-1]

    def snapshot(self) -> DataFrame:
        return state_rows(self.state())

    def store(self, rows: DataFrame, now) -> None:
        """Texts ``(id, layer, content, attrs)``."""
        self._append(ops_of(rows, "store", id="id", at=F.lit(now).cast("timestamp"), layer="layer", content="content", attrs="attrs"))

    def get(self, key: str, now) -> DataFrame:
        """One row by id or unique prefix, as it was before; counts as a get."""
        found = materialise(filters.get_by_id_or_prefix(self.snapshot(), key), "got")
        self._append(ops_of(found, "get", id="id", at=F.lit(now).cast("timestamp")))
        return found

    def search(self, queries: DataFrame, now, how: Search = Search()) -> DataFrame:
        """Results; :meth:`accessed` records that they were shown."""
        return hybrid_search(self.snapshot(), queries, now, how, self.embedder)

    def accessed(self, results: DataFrame, now) -> None:
        self._append(mark_accessed(results, now))

    def list(self, layer: int | None = None) -> DataFrame:
        return filters.layers_in(filters.active(self.snapshot()), None if layer is None else [layer]).orderBy("created_at", "id")

    def stats(self) -> DataFrame:
        return aggregates.stats(self.snapshot(), self.edges)

    def backup(self, path: str, ts: str) -> None:
        """Rows of all segments so far and their edges as one snapshot; later ops don't reach it, and it reads the log once."""
        write_backup(self.snapshot(), self.edges, path, ts)

    def soft_delete(self, ids: DataFrame, now) -> None:
        self._append(soft_delete(ids, now))

    def tag(self, ids: DataFrame, attrs: dict[str, str], now) -> None:
        self._append(tag(ids, attrs, now))
