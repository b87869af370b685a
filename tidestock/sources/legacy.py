"""The earlier extract layout, renamed to the current raw columns.

Both layouts carry the same facts; after renaming, one set of cleaning functions
serves them. Columns only the earlier layout has (echelon, own order segment,
backorders, dates of last movement) travel along and are used where present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_dec
from ..schemas import LEGACY_RAW_SCHEMAS
from .csv import read_raw_layer

# Current name by earlier name; names not listed are the same in both.
RENAMED: dict[str, dict[str, str]] = {
    "dim_location_raw": {"fixed_operating_cost": "operating_cost_per_day"},
    "dim_sku_raw": {"description": "sku_name", "unit_cost": "unit_cost_usd"},
    "dim_service_policy_raw": {
        "customer_segment": "segment",
        "z_score": "safety_stock_multiplier",
        "penalty_stockout_per_unit": "stockout_penalty_per_unit",
        "max_backorder_days": "max_lead_time_days",
        "holding_cost_rate": "carrying_cost_rate_annual",
    },
    "dim_lane_cost_raw": {
        "from_location": "origin_location_id",
        "to_location": "dest_location_id",
        "transit_days_mean": "transit_days",
        "cost_per_unit": "cost_per_unit_usd",
        "cost_per_lb": "cost_per_lb_usd",
    },
    "fact_sales_orders_raw": {
        "ship_to_location": "location_id",
        "qty_ordered": "quantity",
        "price_per_unit": "unit_price_usd",
    },
    "fact_shipments_raw": {
        "from_location": "origin_loc_id",
        "to_location": "dest_loc_id",
        "qty_shipped": "quantity_shipped",
        "delivery_date": "arrival_date",
    },
    "fact_inventory_snapshot_raw": {},
}


def to_current(df: DataFrame, table: str) -> DataFrame:
    rows = df.withColumnsRenamed(RENAMED[table])
    if table == "dim_service_policy_raw":
        # Stated as a fraction here and in percent there.
        percent = (to_dec("target_fill_rate", 20, 6) * 100).cast("string")
        rows = rows.withColumn("target_fill_rate_pct", percent).drop("target_fill_rate")
    return rows


def read_legacy_layer(spark: SparkSession, raw_dir: str, multi_line: bool = False) -> dict[str, DataFrame]:
    layer = read_raw_layer(spark, raw_dir, LEGACY_RAW_SCHEMAS, multi_line)
    return {name: to_current(df, name) for name, df in layer.items()}
