"""The queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import bpe, decontam, exact, huffman, langid, licenses, merkle, minhash, repeats, shards, toxicity, vafile, winnow
from groundwell.llm.common import documents, shared_dir


def op1_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(documents(spark, directory), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def op2_shards(spark: SparkSession, directory: str) -> DataFrame:
    placed = shards.lpt_shards(documents(spark, directory), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, directory))


def op4_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, directory)).select("doc_id", "class_id", "class_size")


def op5_repeated_passages(spark: SparkSession, directory: str) -> DataFrame:
    done = repeats.remove_repeats(documents(spark, directory))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_huffman_tokens(spark: SparkSession, directory: str) -> DataFrame:
    path = shared_dir(spark, "huffman")
    huffman.write_tokens(documents(spark, directory), tokenizers.path("word_bpe_49k.json"), path)
    return huffman.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontam.leaks(documents(spark, directory), spark.read.parquet(f"{directory}/benchmark.parquet"))


def op8_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact.exact_groups(documents(spark, directory)).drop("row_hash")


def op9_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{directory}/labels.parquet")))


def op10_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_winnowing(spark: SparkSession, directory: str) -> DataFrame:
    return winnow.edited_likeness(documents(spark, directory))


def op12_vafile_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return vafile.cluster_vectors(spark.read.parquet(f"{directory}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return merkle.manifest(documents(spark, directory), merkle.without_newlines())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_shards": op2_shards,
    "op3_licenses": op3_licenses,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_huffman_tokens": op6_huffman_tokens,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_winnowing": op11_winnowing,
    "op12_vafile_clusters": op12_vafile_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op8_exact_dedup": exact.ORACLE, "op12_vafile_clusters": vafile.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
