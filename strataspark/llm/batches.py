"""Arrow batches of bounded bytes for texts that pass through Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of a batch. Each task holds several copies of one: in the JVM, in the worker, and on the way back.
BATCH_BYTES = 4 << 20


def map_texts(rows: DataFrame, run, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of about ``batch_bytes``; a longer row is a batch of its own, whole.

    Spark reads the limit from the session when a job starts, so it is set there, and stays, unless the session names one other than Spark's own 64 MB.
    """
    conf = rows.sparkSession.conf
    if conf.get(LIMIT, SPARKS_OWN) == SPARKS_OWN:
        conf.set(LIMIT, str(batch_bytes))
    return rows.mapInArrow(run, schema)
