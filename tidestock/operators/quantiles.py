"""Exact interpolated percentiles whose cost does not sit in one task.

`percentile` holds every distinct value of a group in one task. That is right for
groups bounded by the calendar, but not for a measure split into a handful of
groups. Here rows are first collapsed to (group, value) counts. Values then fall
into logarithmic buckets, a running count over the few buckets locates the one or
two that hold each wanted rank, and only those are ordered value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_DOUBLING = 1024


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, _v, _c): how often each non-NULL value occurs per group."""
    rows = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def _bucket(value: Column) -> Column:
    """A step function that never decreases as the value grows."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * BUCKETS_PER_DOUBLING)).cast("long")


def percentiles_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, float],
    few_groups: bool = False,
    with_above: bool = False,
) -> DataFrame:
    """One row per group with a column per wanted percentile, by linear interpolation.

    `with_above` adds `<name>_above`, the number of rows greater than the percentile.
    It lies between two neighbouring values, so these are the rows after the lower one.

    `few_groups` promises that the number of groups is bounded by the caller (no
    keys, or keys restricted to a fixed list); the selected buckets, two per group
    and percentile at most, are then broadcast. Otherwise Spark picks the join.
    """
    keys = list(keys)
    counts = counts.withColumn("_b", _bucket(F.col("_v")))
    per_group = Window.partitionBy(*keys)
    exact = T.DecimalType(31, 8)
    targets = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(str(p)).cast("decimal(10,8)").alias("p")) for a, p in wanted.items()]
    )
    picked = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_end", F.sum("_bc").over(per_group.orderBy("_b")))
        .withColumn("_n", F.sum("_bc").over(per_group))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
        .select("*", F.explode(targets).alias("_t"))
        .withColumn("_pos", (F.col("_t.p") * (F.col("_n") - 1).cast("decimal(20,0)")).cast(exact))
        .withColumn("_r0", F.floor("_pos").cast("long"))
        .withColumn("_frac", F.col("_pos") - F.col("_r0").cast("decimal(20,0)"))
        .withColumn("_r1", F.ceil("_pos").cast("long"))
        .filter((F.col("_r0") < F.col("_end")) & (F.col("_r1") >= F.col("_start")))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.col("_b").alias("_pb"), F.col("_t.a").alias("_a"), "_start", "_n", "_r0", "_r1", "_frac")
    )
    if few_groups or not keys:
        picked = F.broadcast(picked)
    # Null-safe equality throughout: no filter is inferred for one side, so all
    # readers of the counts share one shuffle and the rows are scanned once.
    match = F.col("_b").eqNullSafe(F.col("_pb"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_a", "_b").orderBy("_v")
    ranked = (
        counts.join(picked, match, "inner")
        .withColumn("_to", F.sum("_c").over(within) + F.col("_start"))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )

    def at(alias: str, rank: str, what: Column) -> Column:
        hit = (F.col("_a") == alias) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to"))
        return F.max(F.when(hit, what))

    aggs = []
    for alias in wanted:
        low, high = at(alias, "_r0", F.col("_v")), at(alias, "_r1", F.col("_v"))
        share = F.max(F.when(F.col("_a") == alias, F.col("_frac")))
        aggs.append((low + (high - low) * share).alias(alias))
        if with_above:
            aggs.append(at(alias, "_r0", F.col("_n") - F.col("_to")).alias(f"{alias}_above"))
    return ranked.groupBy(*keys).agg(*aggs)


def spread_percentiles(
    df: DataFrame, keys: Sequence[str], value: Column, wanted: Mapping[str, float], few_groups: bool = False
) -> DataFrame:
    return percentiles_from_counts(value_counts(df, keys, value), keys, wanted, few_groups)
