"""Key handling: last-wins rows, known keys, orphan repair, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under `order`.

    Spark keeps at most one row per key and task before it shuffles (the window
    group limit), so a key that holds a large share of all rows costs one row per
    map task on the reduce side.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def last_ingested(df: DataFrame, keys: Sequence[str], seq: str = "_ingest_seq") -> DataFrame:
    """The most recently loaded row per key."""
    return latest_per_key(df, keys, [F.col(seq).desc_nulls_last()])


def keep_known(df: DataFrame, col: str, dim: DataFrame, dim_col: str) -> DataFrame:
    """Rows whose key exists in `dim`.

    The join carries no broadcast hint: Spark broadcasts `dim` when its measured
    size is under the session threshold and otherwise joins by shuffle, where the
    adaptive skew rule can split a hot key of `df`.
    """
    known = dim.select(F.col(dim_col).alias("_known"))
    return df.join(known, F.col(col) == F.col("_known"), "left_semi")


def null_if_orphan(df: DataFrame, col: str, dim: DataFrame, dim_col: str) -> DataFrame:
    """Keep every row but clear keys (text) that `dim` does not hold.

    Rows without a key would all meet in one partition of a shuffled join. They get a
    stand-in key from a hash of the row, so they spread like others; it is never kept.
    """
    names = df.columns
    known = dim.select(F.col(dim_col).alias("_known")).distinct()
    stand_in = F.concat(F.lit("-"), F.xxhash64(*names).cast("string"))
    joined = df.withColumn("_key", F.coalesce(F.col(col), stand_in)).join(
        known, F.col("_key") == F.col("_known"), "left"
    )
    kept = F.when(F.col(col).isNotNull(), F.col("_known"))
    return joined.select(*[kept.alias(n) if n == col else F.col(n) for n in names])


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """One row: rows read, distinct non-NULL keys and the surplus between them."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct(*keys).alias("unique_keys")
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_keys"))


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted option list of one column."""
    return df.select(col).distinct().orderBy(col)


#: Keys joined apart by `join_with_hot_keys`, and values the sketch that finds them keeps track of.
APART, TRACKED = 1000, 50_000


def frequent_keys(rows: DataFrame, key: str, most: int = APART, tracked: int = TRACKED) -> DataFrame:
    """(key): the `most` keys with the most rows, by a sketch of fixed size that combines map-side.

    Every key with more than a few rows in `tracked` is found; a key in place of another costs nothing but speed.
    """
    top = rows.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"))
    return top.select(F.explode("top.item").alias(key))


def join_with_hot_keys(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """`one` left join `many` on a key that is unique in `one` and may be hot in `many`; each side is shuffled once.

    An outer join cannot split its side of many rows. So the rows of the most frequent keys are joined
    apart: there are at most APART of them in `one`, which are broadcast, and no row of `many` moves.
    What is left has no hot key, and takes one plain outer join. The keys are settled first, on the
    driver, as all branches must agree on them.
    """
    settled = frequent_keys(many, key).collect()  # APART keys at most
    apart = F.broadcast(one.sparkSession.createDataFrame(settled, one.select(key).schema))
    few = F.broadcast(one.join(apart, key, "left_semi"))  # a row for each
    left, right = one.join(apart, key, "left_anti"), many.join(apart, key, "left_anti")
    return left.join(right, key, "left").unionByName(many.join(few, key))
