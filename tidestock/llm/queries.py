"""The corpus operators as named queries with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_join, byte_bpe, conversations, decontaminate, hash_ring, repeated_bytes, secret_scan, simhash_trie, token_lengths, toxicity, url_filter, warc, whitening
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SHARDS = 40
TOXIC = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 1)
    scored = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "posterior"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op3_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hash_ring.place(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_groups(table(spark, sf_dir, "documents"))


def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_lengths.token_counts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.digest(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contained(docs, items).drop("text_hash")


def op11_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, absent=dropped).digests().withColumnRenamed("key", "conv_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_url_filter, op3_hash_ring, op4_simhash_trie, op5_token_lengths,
        op6_secret_scan, op7_block_join, op8_repeated_bytes, op9_byte_bpe, op10_decontaminate,
        op11_glr_repair, op12_warc, op13_whitening,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op7_block_join": block_join.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL}
