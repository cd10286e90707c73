"""A training-data pipeline over ``documents``: five filters and rewrites, one after the other.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; :func:`run` writes each result as Parquet and reads it
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm.decontaminate import drop_contaminated
from strataspark.llm.line_dedup import drop_repeated_lines
from strataspark.llm.near_dedup import keep_one_of_each
from strataspark.llm.queries import VOCABULARY
from strataspark.llm.sentencepiece_viterbi import with_tokens
from strataspark.llm.toxicity import drop_toxic
from strataspark.scratch import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines cut out; a document that held nothing else goes."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id: two-word shingles, similarity 0.8, as in the operator's query."""
    return keep_one_of_each(docs, words=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With token ids, their number, and whether decoding gives the text again."""
    return with_tokens(docs, VOCABULARY)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("sentencepiece", sentencepiece)]

#: Two stages are a trained model and a tokenizer, which SQL can't say; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
