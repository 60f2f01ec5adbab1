"""The corpus pipeline: documents in, packed token rows out.

Five stages, in order: toxicity (rejected documents go), MinHash near-dedup
(one document of each group stays), benchmark decontamination, mixing sources
to target weights, token-ID output.  Every stage takes ``(spark, docs,
sf_dir)`` and works on all rows its predecessor kept; all but the last return
the columns of ``documents`` as they came.  ``run`` writes each stage as
Parquet to the shared checkpoint folder and reads it again, so a lost executor
costs at most one stage.

No SQL twin: learned scores, signatures and a tokenizer cannot be expressed in
SQL; ``tests/llm/test_pipeline.py`` holds each stage against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash, mixture, packing, toxicity
from tidemark.llm.common import load, remainder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels that are not held out (crc32 of the id mod 5)."""
    labels = load(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, minhash.Params(shingle_words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.emit(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("token_rows", pack_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
