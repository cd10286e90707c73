"""Tables of the store, and their fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORIES = """id string, layer int, content string, content_hash string, importance float, access_count int,
 created_at timestamp, updated_at timestamp, last_accessed_at timestamp, decay_rate float, stability float, source string, agent string, compacted_at timestamp,
 valence float, valence_scored boolean, valence_attempts int, embedding_model string, pushed_at timestamp, embedding array<float>, attrs map<string,string>"""
EDGES = "from_id string, to_id string, edge_type string, weight float, created_at timestamp"
COMPACTION_LOG = "id string, run_at timestamp, path string, source_layer int, target_layer int, source_ids array<string>, target_id string"
VECTORS = "id string, embedding array<float>, model string"

#: Names of layers, base decay by layer, kinds of edges, defaults of a new row.
LAYERS = {1: "core", 2: "principles", 3: "knowledge", 4: "workspace", 5: "observations"}
BASE_DECAY = {1: 0.0, 2: 0.01, 3: 0.05, 4: 0.1, 5: 0.5}
EDGE_TYPES = ("relates_to", "contradicts", "supports", "derived_from", "compacted_from", "same_trace")
DEFAULT_IMPORTANCE, DEFAULT_STABILITY = 5.0, 1.0


def _choose(values: dict, key: Column, otherwise) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(otherwise)


def layer_name(layer: Column) -> Column:
    """Name of a layer; ``unknown`` for any other number and null."""
    return _choose(LAYERS, layer, "unknown")


def base_decay(layer: Column) -> Column:
    """Decay of a new row of a layer; null for numbers that are no layer."""
    return _choose(BASE_DECAY, layer, F.lit(None).cast("double"))


def valid_memories(rows: DataFrame) -> DataFrame:
    """Rows that may be stored: layer 1 to 5, content not empty, valence null or within [-1, 1]."""
    ok = F.col("layer").between(1, 5) & (F.col("content") != "") & (F.col("valence").isNull() | F.col("valence").between(-1, 1))
    return rows.where(F.coalesce(ok, F.lit(False)))
