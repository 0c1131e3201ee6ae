"""The corpus operators' queries: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, compaction, iblt, langid, nndescent, packing, simhash, stupid_backoff, suffixes
from tidewell.llm.common import scratch, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op3_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.store_and_compact(table(spark, sf_dir, "documents"), scratch(spark, "store"), target_bytes=16 << 20)
    return store.placed(F.col("doc_id"), F.length("text").cast("long").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_balanced(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(table(spark, sf_dir, "embeddings"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff.scores(table(spark, sf_dir, "documents"), order=3, least=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
