"""What-if analysis of a stock policy under a service level and unit costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inventory import recommend, z_for_service_level
from ..functions.numeric import half_even
from ..functions.text import to_number
from ..operators.filters import equality_filter

NUMERIC_COLUMNS = ["avg_demand", "std_demand", "lead_time", "reorder_point", "safety_stock"]
# Default controls.
SERVICE_LEVEL = 95
HOLDING_COST = 2.0
STOCKOUT_COST = 10.0
TOP_N = 5


def coerce_numeric(df: DataFrame, cols: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Read columns as numbers; what does not read counts as 0."""
    return df.withColumns({c: to_number(c) for c in cols})


def scenario(
    policy: DataFrame,
    level: int | Column = SERVICE_LEVEL,
    holding: float = HOLDING_COST,
    stockout: float = STOCKOUT_COST,
    sku: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Recomputed buffer, reorder point, costs and advice per policy row.

    Each figure is rounded to cents before the next one uses it.
    """
    rows = equality_filter(coerce_numeric(policy), sku_id=sku, location_id=location)
    lead = F.col("lead_time")
    root = F.when(lead > 0, F.sqrt(lead)).otherwise(F.lit(0.0))
    steps = {
        "calc_safety_stock": z_for_service_level(level) * F.col("std_demand") * root,
        "calc_reorder_point": F.col("avg_demand") * lead + F.col("calc_safety_stock"),
        "holding_cost_total": F.col("calc_safety_stock") * F.lit(float(holding)),
        "risk_cost": F.col("std_demand") * F.lit(float(stockout)),
        "total_cost": F.col("holding_cost_total") + F.col("risk_cost"),
    }
    for name, value in steps.items():
        rows = rows.withColumn(name, half_even(value, 2))
    return rows.withColumn("recommendation", recommend(F.col("calc_safety_stock"), F.col("safety_stock")))


def high_risk(rows: DataFrame) -> DataFrame:
    """Rows whose recomputed buffer exceeds a day of demand."""
    risky = rows.filter(F.col("calc_safety_stock") > F.col("avg_demand"))
    return risky.select(
        "sku_id", "location_id", "avg_demand", "calc_safety_stock", "calc_reorder_point", "recommendation"
    )


def top_cost(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    """The costliest rows; equal costs are ordered by key."""
    return rows.orderBy(F.desc("total_cost"), "sku_id", "location_id").limit(n).select(
        "sku_id", "location_id", "calc_safety_stock", "holding_cost_total", "risk_cost", "total_cost",
        "recommendation",
    )


def _mean(col: str) -> Column:
    """Mean of a column of cents, summed exactly."""
    return half_even(F.sum(F.col(col).cast("decimal(20,2)")).cast("double") / F.count(col), 2)


def scenario_kpis(rows: DataFrame) -> DataFrame:
    risky = F.col("calc_safety_stock") > F.col("avg_demand")
    return rows.agg(
        F.count_distinct("sku_id").alias("filtered_skus"),
        _mean("calc_safety_stock").alias("avg_safety_stock"),
        _mean("calc_reorder_point").alias("avg_reorder_point"),
        F.sum(F.col("total_cost").cast("decimal(20,2)")).cast("double").alias("total_cost"),
        F.count_if(risky).alias("high_risk_rows"),
    )


def scenario_by_sku(rows: DataFrame) -> DataFrame:
    """Mean buffer and summed cost per product, dearest first."""
    return rows.groupBy("sku_id").agg(
        (F.sum(F.col("calc_safety_stock").cast("decimal(20,2)")).cast("double") / F.count("calc_safety_stock"))
        .alias("avg_safety_stock"),
        F.sum(F.col("total_cost").cast("decimal(20,2)")).cast("double").alias("total_cost"),
    ).orderBy(F.desc("total_cost"), "sku_id")


def policy_comparison(rows: DataFrame) -> DataFrame:
    """Current next to recomputed policy."""
    return rows.select(
        "sku_id", "location_id", "avg_demand", "std_demand", "lead_time",
        "safety_stock", "calc_safety_stock", "reorder_point", "calc_reorder_point",
        "holding_cost_total", "risk_cost", "total_cost", "recommendation",
    )
