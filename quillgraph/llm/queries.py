"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, centroids, collocations, html_extract, interleave, langid, license_scan, media_chunks, minhash_dedup, packing, slack_packing, suffix_dedup, topk_search
from .oracle import ORACLE_SQL


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk_search.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave.interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def op6_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op9_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dim=64, seed=2)


def op12_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["ORACLE_SQL", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_topk, op2_media_chunks, op3_interleave, op4_byte_cnn, op5_fast_similarity, op6_prefix_free, op7_bpe_transducer, op8_best_fit, op9_page_difference, op10_license_index,
        op11_weighted_lloyd, op12_bin_slack, op13_suffix_phrases,
    )
    return {f.__name__: f for f in every}
