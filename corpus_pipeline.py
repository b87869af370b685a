"""A corpus pipeline of five operators, each stage written and read back before the next.

toxicity         documents that score TOXIC or more go
near_duplicates  of each component of SimHash fingerprints (three-word shingles, 3 bits of 64) the row
                 with the smallest id stays
decontaminate    documents that hold a benchmark item go
secrets          every secret is replaced by a mark, and n_chars follows
tokens           adds the number of ids of byte-level BPE, their digest and that of the decoded bytes

Every stage keeps the columns of documents and all rows it has nothing against. Rows without id or
text pass through like others: an empty text is never toxic by itself, empty texts are copies of
each other, hold no item and no secret, and have no ids. Equal rows are copies, so one stays. Empty
tables give empty tables; without labels the toxicity stage falls back on its fixed word list.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestock.llm import byte_bpe, decontaminate, secret_scan, simhash_trie, toxicity
from tidestock.llm.common import Scratch, table

TOXIC = 0.7
RANKS = "byte_bpe_multi_50k.tiktoken"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fold, as the operator's own query does."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 1)
    # The score comes under a name that no column of docs has, so clashing names pass through.
    own = "score"
    while own in docs.columns:
        own += "_"
    return toxicity.score(docs, labels, keep=docs.columns, score_as=own).where(F.col(own) < TOXIC).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component; of equal ids the smallest hash of the text, of equal rows any one.

    The operator gets one row per fingerprint, and rows are found again by id and text hash, so a group of
    copies of any size is only ever a minimum.
    """
    scratch = Scratch(spark)
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select("doc_id", hashed.alias("hash"), "text")
    prints = scratch.store(simhash_trie.fingerprints(rows, keep=("doc_id", "hash")), "prints")
    groups = simhash_trie.near_duplicates(prints, scratch)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    firsts = prints.groupBy("fp").agg(least)
    chosen = firsts.join(groups, "fp").groupBy("root").agg(F.min("least").alias("least"))
    chosen = scratch.store(chosen.select(F.col("least.doc_id").alias("__id"), F.col("least.hash").alias("__hash")), "chosen")
    found = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["__id"]) & (hashed == chosen["__hash"]), "left_semi")
    # Equal rows were chosen together: one stays. The limit applies in every task before the shuffle.
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    same = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.xxhash64(*plain))
    place = "place"
    while place in docs.columns:
        place += "_"
    return found.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(place)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def with_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = tuple(c for c in docs.columns if c not in made)
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", one_of_each),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", with_tokens),
]

#: Training and tokenising cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
