"""Group-wise repair of numbers: mean imputation and winsorising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.text import is_missing, is_numeric, to_dec, to_int
from .quantiles import percentiles_from_counts, value_counts


def group_mean_int(df: DataFrame, col: str, group: str) -> DataFrame:
    """Rounded mean of the readable values per group: (group, group_mean)."""
    readable = df.filter(is_numeric(col)).select(group, to_dec(col, 32, 6).alias("_v"))
    mean = ratio(F.sum("_v"), F.count("_v"), 0).try_cast("int")
    return readable.groupBy(group).agg(mean.alias("group_mean"))


def impute_by_group(df: DataFrame, col: str, group: str, fallback: int) -> DataFrame:
    """Replace text `col` by its own integer, else the group's rounded mean, else `fallback`."""
    means = group_mean_int(df, col, group)
    filled = F.coalesce(to_int(col), F.col("group_mean"), F.lit(fallback))
    return df.join(means, group, "left").withColumn(col, filled).drop("group_mean")


def winsor_stats(df: DataFrame, col: str, group: str, p: float = 0.99) -> DataFrame:
    """Per group that occurs, the cap (percentile `p`) and the mean of the values after capping.

    Both come from the same (group, value) counts, so the rows are read once. Numbers of
    up to 24 digits before the point take part; Spark's decimals hold no more together
    with the interpolation.
    """
    rows = df.filter(F.col(group).isNotNull() & is_numeric(col))
    counts = value_counts(rows, [group], to_dec(col, 30, 6))
    caps = percentiles_from_counts(counts, [group], {"cap": p})
    caps = caps.select(F.col(group).alias("_group"), F.col("cap").cast("decimal(32,6)").alias("cap"))
    capped = F.least(F.col("_v").cast("decimal(32,6)"), F.col("cap"))
    # A sum too long for a decimal leaves the mean unknown instead of ending the job.
    total = F.try_sum(F.try_multiply(capped, F.col("_c").cast("decimal(13,0)"))).try_cast("decimal(32,6)")
    mean = F.try_divide(total, F.sum("_c").cast("decimal(13,0)"))
    # Null-safe for the reason given in percentiles_from_counts.
    return counts.join(caps, F.col(group).eqNullSafe(F.col("_group"))).groupBy(group).agg(
        F.max("cap").alias("cap"), mean.try_cast("decimal(38,12)").alias("capped_mean")
    )


def winsorize(value: Column | str, cap: Column, mean: Column) -> Column:
    """Missing or unreadable text takes the mean, larger numbers the cap, others stay."""
    text = F.col(value) if isinstance(value, str) else value
    number = F.when(is_numeric(text), to_dec(text, 38, 10))
    return (
        F.when(is_missing(text) | number.isNull(), mean)
        .when(number > cap, cap)
        .otherwise(number)
        .try_cast("decimal(10,2)")
    )


def winsorize_impute(
    df: DataFrame,
    col: str,
    group: str,
    p: float = 0.99,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Cap `col` at the group percentile and fill gaps with the post-cap group mean.

    Rows of an unknown group keep their own number, or stay NULL. `stats_from`
    supplies the rows the statistics are taken from where they differ from `df`.
    """
    stats = winsor_stats(df if stats_from is None else stats_from, col, group, p)
    out = winsorize(col, F.col("cap"), F.col("capped_mean"))
    return df.join(stats, group, "left").withColumn(col, out).drop("cap", "capped_mean")
