"""Token counts from an exact histogram of encoded lengths.

Documents are counted per length; sums over the lengths at or above each one then answer totals,
quantiles and truncated totals for every context limit without touching the documents again.

Defined cases: a null text is empty and has length 0; repeated rows and null ids count like any
other row; texts are encoded whole; an empty table has an empty histogram, totals of 0 and null
quantiles; further columns are left out. Lengths between two rows are answered by the next longer
row, lengths beyond the longest by the totals.
"""

from __future__ import annotations

from collections.abc import Sequence

import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import coder, rank_file, read_ranks
from .common import Scratch, map_batches

#: Texts with more code points go through the coder whose time is linear in a single long piece.
LONG_TEXT = 200_000
#: Lengths per bucket of the two-level sums; the upper level has longest length / BUCKET rows.
BUCKET = 1024

_encodings: dict[str, tiktoken.Encoding] = {}


def encoded_lengths(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and n_tokens of every row."""
    ranks = rank_file(docs, path)

    def run(**columns):
        texts = columns.pop("length_input")
        if pattern not in _encodings:
            _encodings[pattern] = tiktoken.Encoding(
                "lengths", pat_str=pattern, mergeable_ranks=read_ranks(ranks.value), special_tokens={}
            )
        short, long = _encodings[pattern].encode_ordinary, coder(ranks.value, pattern).encode
        return columns | {"n_tokens": [len((short if len(t or "") <= LONG_TEXT else long)(t or "")) for t in texts]}

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, docs["text"].alias("length_input")), run, f"{kinds}n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs): one row per length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per length with sums over that length and all longer ones.

    docs_at_least and tokens_at_least: documents this long or longer, and their tokens;
    truncated_total: tokens left when every document is cut to this length;
    share_up_to: share of the documents that fit in this length.
    Sums run in two levels, so that no task orders more lengths than one bucket or the bucket list.
    """
    counts = scratch.store(
        counts.select("n_tokens", "docs", F.floor(F.col("n_tokens") / BUCKET).alias("bucket"), (F.col("n_tokens") * F.col("docs")).alias("tokens")),
        "histogram",
    )
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    buckets = scratch.store(
        buckets.select(
            "bucket", F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("docs_beyond"),
            F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_beyond"),
        ),
        "buckets",
    )
    total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(buckets, "bucket")
        .withColumns({
            "docs_at_least": F.col("docs_beyond") + F.sum("docs").over(inside),
            "tokens_at_least": F.col("tokens_beyond") + F.sum("tokens").over(inside),
        })
        .select(
            "n_tokens", "docs", "docs_at_least", "tokens_at_least",
            (F.lit(total["t"]) - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            ((F.lit(total["d"]) - F.col("docs_at_least") + F.col("docs")) / F.lit(total["d"])).alias("share_up_to"),
        )
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_cut_or_full, tokens_kept) for any limits, from the suffix sums alone."""
    end = F.struct(*[F.col(c) for c in ("n_tokens", "docs_at_least", "tokens_at_least")])
    shortest = F.min(end)
    at = [F.min(F.when(F.col("n_tokens") >= limit, end)).alias(f"at{i}") for i, limit in enumerate(limits)]
    row = sums.agg(shortest.alias("all"), *at).first()
    total = row["all"]["tokens_at_least"] if row["all"] else 0
    made = []
    for i, limit in enumerate(limits):
        docs, tokens = (row[f"at{i}"]["docs_at_least"], row[f"at{i}"]["tokens_at_least"]) if row[f"at{i}"] else (0, 0)
        made.append((int(limit), docs, total - tokens + limit * docs))
    return sums.sparkSession.createDataFrame(made, "context_limit long, docs_at_least long, tokens_kept long")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the shortest length that at least this share of the documents fits in."""
    row = sums.agg(*[F.min(F.when(F.col("share_up_to") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]).first()
    return sums.sparkSession.createDataFrame([(float(s), row[f"q{i}"]) for i, s in enumerate(shares)], "share double, n_tokens long")


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return suffix_sums(histogram(encoded_lengths(docs, path, pattern, keep=())), Scratch(docs.sparkSession))
