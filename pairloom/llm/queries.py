"""The registered queries of this subpackage: one operator each, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, pii, quality, sharding, simhash, suffix_dedup, token_counts, token_files, toxicity
from .common import table


#: Fixed, so that the registered queries give the same rows each time. Real data need a secret key.
QUERY_KEY = "pairloom"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), True, 2)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its new text and the number of mentions replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.redact(docs, QUERY_KEY, "n_entities")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair of which the document holds 0.8 of the item or more."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", F.round("containment", 6).alias("containment")).distinct()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), False, 2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash_near_dedup,
        op3_sharding,
        op4_toxicity,
        op5_suffix_array_dedup,
        op6_token_counts,
        op7_token_files,
        op8_pii_surrogates,
        op9_benchmark_decontamination,
        op10_best_fit_packing,
    )
}
SQL: dict[str, str] = {"op5_suffix_array_dedup": suffix_dedup.SQL, "op9_benchmark_decontamination": decontaminate.LEAKS_SQL}
