"""The registered queries of this subpackage: ``opN_<name>``, each with its
production parameters over its whole table.  ``SQL`` holds the DuckDB twins of
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, embeddings, hosts, interaction, language, merkle, minhash, mixture, packing, repetition,
                          sharding, toxicity, warc)
from tidemark.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op2_zstd_language(spark, sf_dir):
    return language.predictions(load(spark, sf_dir, "documents"))


@query
def op3_packed_token_rows(spark, sf_dir):
    return packing.packed_rows(load(spark, sf_dir, "documents"))


@query
def op4_warc_transactions(spark, sf_dir):
    return warc.round_trip(load(spark, sf_dir, "pages"))


SQL["op4_warc_transactions"] = warc.SQL


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), minhash.Params(shingle_words=2))


@query
def op6_host_reputation(spark, sf_dir):
    return hosts.judge(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


SQL["op6_host_reputation"] = hosts.SQL


@query
def op7_mixture(spark, sf_dir):
    return mixture.mixed_sizes(load(spark, sf_dir, "documents"))


SQL["op7_mixture"] = mixture.SQL


@query
def op8_stratified_shards(spark, sf_dir):
    s = sharding.stratified_shards(load(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


SQL["op8_stratified_shards"] = sharding.SQL


@query
def op9_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.predictions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.verification(load(spark, sf_dir, "documents"))


SQL["op11_merkle_manifest"] = merkle.SQL


@query
def op12_repetition_rules(spark, sf_dir):
    return repetition.judged(load(spark, sf_dir, "documents"))


SQL["op12_repetition_rules"] = repetition.SQL


@query
def op13_filter_interaction(spark, sf_dir):
    return interaction.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL["op13_filter_interaction"] = interaction.SQL
