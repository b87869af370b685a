"""Raw text tables to the typed clean layer, one function per table.

A row whose required figure does not read, does not fit its type or breaks its rule
(`READABLE`) is rejected before the last transmission is picked, so it hides no good
row. Tables with such figures are made in two steps: `judge_*` types every row and names the column
at fault, `accepted` picks among the good rows and `rejects` lists the others. Where the judged rows
are stored in between (`plans.pipeline`), the raw table is read once for both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_zero, null_if_before, pct_to_fraction, transit_days
from ..functions.text import (
    ECHELON_BY_TYPE, FLAG_TRUTHY, LOCATION_TYPES, MODE_BY_CARRIER, RANK_BY_SEGMENT, SEGMENTS,
    blank_to_null, clean_enum, clean_text, is_missing, normalize_sku, read_once, remap,
    to_date, to_dec, to_flag, to_int,
)
from ..operators.audit import apply_defaults, union_reports
from ..operators.filters import exclude_status, require_in, require_key, require_positive
from ..operators.impute import impute_by_group, winsor_stats, winsorize
from ..operators.keys import keep_known, last_ingested, latest_per_key, null_if_orphan
from ..schemas import CLEAN_SCHEMAS, CLEAN_TABLES

# Fixed value: lead time in days when neither the product nor its category has one.
DEFAULT_LEAD_TIME = 7


# Columns per table whose loss rejects the row; their checks are those of the table.
READABLE = {
    "dim_sku": ("unit_cost",),
    "dim_service_policy": ("target_fill_rate", "z_score", "penalty_stockout_per_unit"),
    "dim_lane_cost": ("transit_days_mean", "cost_per_unit"),
    "fact_sales_orders": ("order_date", "qty_ordered", "price_per_unit"),
    "fact_inventory_snapshot": ("snapshot_date",),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the clean layout; values that do not fit become NULLs, as do columns the raw data lacks, unless they have a default."""
    have = set(df.columns)
    typed = df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None).cast("string")).try_cast(f.dataType).alias(f.name)
        for f in CLEAN_SCHEMAS[table].fields
    ])
    return apply_defaults(typed, CLEAN_TABLES[table])


#: Names of the columns that judged rows carry besides their own; FAULT is null on good rows.
FAULT, FAULT_KEY = "_fault", "_fault_key"


def judged(rows: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with their judged columns typed, the first column at fault and the row's key as text."""
    spec = CLEAN_TABLES[table]
    columns = READABLE[table] if columns is None else columns
    typed = rows.withColumns({c: F.col(c).try_cast(spec.schema[c].dataType) for c in columns})
    lost = [F.col(c).isNull() | (~F.expr(spec.checks[c]) if c in spec.checks else F.lit(False)) for c in columns]
    fault = read_once(F.coalesce(*[F.when(test, F.lit(c)) for c, test in zip(columns, lost)]))
    keys = F.concat_ws("|", *[F.col(k).cast("string") for k in spec.key if k in rows.columns])
    return typed.withColumns({FAULT: fault, FAULT_KEY: keys})


def rejects(judged_rows: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, key) of the rows at fault."""
    bad = judged_rows.filter(F.col(FAULT).isNotNull())
    return bad.select(F.lit(table).alias("table_name"), F.col(FAULT).alias("column_name"), F.col(FAULT_KEY).alias("key"))


def accepted(judged_rows: DataFrame, table: str, last_only: bool = True) -> DataFrame:
    """Among the good rows the last one loaded per key, in the clean layout; all of them without `last_only`.

    Where rows state when they were updated, the latest text wins first, and a missing one comes before.
    """
    good = judged_rows.filter(F.col(FAULT).isNull()).drop(FAULT, FAULT_KEY)
    if not last_only:
        return conform(good, table)
    updated = [F.col("_updated").desc_nulls_first()] if "_updated" in good.columns else []
    return conform(latest_per_key(good, CLEAN_TABLES[table].key, [*updated, F.col("_ingest_seq").desc_nulls_last()]), table)


def _extra(raw: DataFrame, name: str) -> Column:
    """A column only some raw layouts carry."""
    return F.col(name) if name in raw.columns else F.lit(None).cast("string")


def clean_locations(raw: DataFrame) -> DataFrame:
    rows = require_in(require_key(raw, "location_id"), "location_type", LOCATION_TYPES)
    rows = rows.select(
        clean_text("location_id").alias("location_id"),
        clean_text("location_name").alias("location_name"),
        clean_enum("location_type").alias("location_type"),
        clean_text("region").alias("region"),
        F.coalesce(to_int(_extra(raw, "echelon")), remap("location_type", ECHELON_BY_TYPE)).alias("echelon"),
        to_int("capacity_units").alias("capacity_units"),
        to_dec(_extra(raw, "storage_cost_per_unit")).alias("storage_cost_per_unit"),
        to_dec("operating_cost_per_day").alias("fixed_operating_cost"),
        "_ingest_seq",
    )
    return conform(last_ingested(rows, ["location_id"]), "dim_location")


def judge_skus(raw: DataFrame) -> DataFrame:
    """Category means are taken over all raw rows, before keys or costs are checked."""
    rows = raw.withColumn("category", clean_enum("category"))
    rows = impute_by_group(rows, "lead_time_days", "category", DEFAULT_LEAD_TIME)
    rows = require_key(rows, "sku_id").filter(~is_missing("unit_cost_usd"))
    rows = rows.select(
        normalize_sku("sku_id").alias("sku_id"),
        clean_text("sku_name").alias("description"),
        "category",
        clean_text(_extra(raw, "subcategory")).alias("subcategory"),
        to_dec("unit_cost_usd").alias("unit_cost"),
        to_dec(_extra(raw, "unit_volume_cuft")).alias("unit_volume_cuft"),
        to_dec("unit_weight_lbs").alias("unit_weight_lbs"),
        clean_text("supplier_id").alias("supplier_id"),
        "lead_time_days",
        to_int("reorder_point").alias("reorder_point"),
        to_flag("active").alias("active"),
        to_date(_extra(raw, "last_updated")).alias("last_updated"),
        _extra(raw, "last_updated").alias("_updated"),
        "_ingest_seq",
    )
    return judged(rows, "dim_sku")


def clean_skus(raw: DataFrame) -> DataFrame:
    return accepted(judge_skus(raw), "dim_sku")


def judge_policy(raw: DataFrame) -> DataFrame:
    rows = require_in(raw, "segment", SEGMENTS).select(
        clean_enum("segment").alias("customer_segment"),
        pct_to_fraction(to_dec("target_fill_rate_pct")).alias("target_fill_rate"),
        to_dec("safety_stock_multiplier").alias("z_score"),
        to_dec("stockout_penalty_per_unit").alias("penalty_stockout_per_unit"),
        F.coalesce(to_int(_extra(raw, "priority_rank")), remap("segment", RANK_BY_SEGMENT)).alias("priority_rank"),
        to_int("max_lead_time_days").alias("max_backorder_days"),
        to_int(_extra(raw, "expedite_threshold")).alias("expedite_threshold"),
        to_int("review_period_days").alias("review_period_days"),
        to_dec("carrying_cost_rate_annual").alias("holding_cost_rate"),
        to_int(_extra(raw, "min_order_qty")).alias("min_order_qty"),
        "_ingest_seq",
    )
    return judged(rows, "dim_service_policy")


def clean_policy(raw: DataFrame) -> DataFrame:
    """One row per segment: the last one sent."""
    return accepted(judge_policy(raw), "dim_service_policy")


def judge_lanes(raw: DataFrame, locations: DataFrame) -> DataFrame:
    """Lanes between known locations; a layout that states the mode itself is taken at its word."""
    if "transport_mode" in raw.columns:
        named, mode = raw, clean_enum("transport_mode")
    else:
        named, mode = require_in(raw, "carrier_mode", MODE_BY_CARRIER), remap("carrier_mode", MODE_BY_CARRIER)
    rows = named.select(
        clean_text("lane_id").alias("lane_id"),
        clean_text("origin_location_id").alias("from_location"),
        clean_text("dest_location_id").alias("to_location"),
        mode.alias("transport_mode"),
        to_dec("distance_miles").alias("distance_miles"),
        to_dec("transit_days").alias("transit_days_mean"),
        to_dec(_extra(raw, "transit_days_std")).alias("transit_days_std"),
        to_dec("cost_per_unit_usd").alias("cost_per_unit"),
        to_dec("cost_per_lb_usd").alias("cost_per_lb"),
        "_ingest_seq",
    )
    rows = keep_known(rows, "from_location", locations, "location_id")
    rows = keep_known(rows, "to_location", locations, "location_id")
    return judged(rows, "dim_lane_cost")


def clean_lanes(raw: DataFrame, locations: DataFrame) -> DataFrame:
    return accepted(judge_lanes(raw, locations), "dim_lane_cost")


def sku_segments(raw_skus: DataFrame) -> DataFrame:
    """The latest stated segment per product key: (sku_id, segment)."""
    rows = raw_skus.filter(~is_missing("sku_id") & ~is_missing("segment")).select(
        normalize_sku("sku_id").alias("sku_id"), clean_enum("segment").alias("segment"), "_ingest_seq"
    )
    return last_ingested(rows, ["sku_id"]).select("sku_id", "segment")


def judge_orders(
    raw: DataFrame, raw_skus: DataFrame, skus: DataFrame, locations: DataFrame, segment_source: str = "sku"
) -> DataFrame:
    """Demand lines of known products and places.

    Validity is checked before the last transmission is picked, so a cancelled or
    broken re-send never hides an earlier good row. With ``segment_source="sku"``
    the customer segment follows the product master; with ``"order"`` it is read
    from the order itself and the order is taken as sent, without status, quantity
    or location checks.
    """
    rows = require_key(raw, "order_id")
    if segment_source == "sku":
        rows = exclude_status(rows, "order_status", "CANCELLED")
        rows = require_positive(rows, "quantity", "unit_price_usd")
    rows = rows.select(
        clean_text("order_id").alias("order_id"),
        to_date("order_date").alias("order_date"),
        normalize_sku("sku_id").alias("sku_id"),
        clean_text("customer_id").alias("customer_id"),
        blank_to_null("location_id").alias("ship_to_location"),
        clean_enum(_extra(raw, "customer_segment")).alias("customer_segment"),
        to_int("quantity").alias("qty_ordered"),
        to_dec("unit_price_usd").alias("price_per_unit"),
        clean_text("channel").alias("channel"),
        to_flag(_extra(raw, "priority_flag"), FLAG_TRUTHY).alias("priority_flag"),
        "_ingest_seq",
    )
    if segment_source == "sku":
        rows = keep_known(rows, "ship_to_location", locations, "location_id")
        known = sku_segments(raw_skus).filter(F.col("segment").isin(*SEGMENTS))
        catalogue = keep_known(known, "sku_id", skus, "sku_id")
        rows = rows.join(catalogue, "sku_id").withColumn("customer_segment", F.col("segment"))
    else:
        rows = keep_known(rows, "sku_id", skus, "sku_id")
    # An order taken as sent must still have a day.
    return judged(rows, "fact_sales_orders", None if segment_source == "sku" else ("order_date",))


def clean_orders(
    raw: DataFrame, raw_skus: DataFrame, skus: DataFrame, locations: DataFrame, segment_source: str = "sku"
) -> DataFrame:
    """Valid demand lines, one per order id."""
    return accepted(judge_orders(raw, raw_skus, skus, locations, segment_source), "fact_sales_orders")


def best_lane(lanes: DataFrame) -> DataFrame:
    """Per location pair the quickest lane, then the cheapest, then the first id."""
    picked = latest_per_key(
        lanes, ["from_location", "to_location"],
        [F.asc("transit_days_mean"), F.asc("cost_per_unit"), F.asc("lane_id")],
    )
    return picked.select("from_location", "to_location", "transport_mode", "transit_days_mean")


def prepare_shipments(raw: DataFrame, lanes: DataFrame, as_sent: bool = False) -> DataFrame:
    """Typed shipment rows with the mode and contract time of their best lane.

    An arrival before the departure is cleared, unless shipments are taken as sent.

    A layout that states its own mode keeps it, under the spelling the lanes use.
    """
    stated = ["transport_mode"] if "transport_mode" in raw.columns else []
    flags = [to_flag(c, FLAG_TRUTHY).alias(c) for c in ("on_time_flag", "damage_flag") if c in raw.columns]
    rows = require_key(raw, "shipment_id").select(
        clean_text("shipment_id").alias("shipment_id"),
        blank_to_null("order_id").alias("order_id"),
        clean_text("origin_loc_id").alias("from_location"),
        clean_text("dest_loc_id").alias("to_location"),
        normalize_sku("sku_id").alias("sku_id"),
        read_once(to_int("quantity_shipped")).alias("qty_shipped"),
        to_date("ship_date").alias("ship_date"),
        (to_date("arrival_date") if as_sent else null_if_before(to_date("arrival_date"), to_date("ship_date")))
        .alias("delivery_date"),
        # Statistics filter by this text and parse it; copied to the scan, where raw text is built, it makes a method too long to compile.
        read_once(F.col("freight_cost_usd")).alias("freight_cost_usd"),
        clean_text("carrier").alias("carrier"),
        clean_enum(_extra(raw, "shipment_status")).alias("shipment_status"),
        *[clean_enum(c).alias(c) for c in stated], *flags,
        "_ingest_seq",
    )
    return rows.join(best_lane(lanes).drop(*stated), ["from_location", "to_location"], "left")


def on_time(status: str = "shipment_status") -> Column:
    """True or False where both dates and the contract time are known, else late or unknown."""
    actual = transit_days("delivery_date", "ship_date")
    judged = actual.isNotNull() & F.col("transit_days_mean").isNotNull()
    return F.when(judged, actual <= F.col("transit_days_mean")).when(F.col(status) == "DELAYED", F.lit(False))


def freight_stats(raw: DataFrame, lanes: DataFrame) -> DataFrame:
    """Cap and mean of the freight per transport mode that the lanes give."""
    return winsor_stats(prepare_shipments(raw, lanes), "freight_cost_usd", "transport_mode")


def clean_shipments(
    raw: DataFrame, lanes: DataFrame, locations: DataFrame, skus: DataFrame, orders: DataFrame,
    stats: DataFrame | None = None, as_sent: bool = False,
) -> DataFrame:
    """One row per shipment id with repaired freight.

    The earlier generation takes shipments as sent: whatever their places, products and
    quantities, and with inverted dates.

    Freight statistics see every prepared shipment, also those later dropped as
    duplicates or for unknown keys. They need only the lane ends and the freight
    text, so that pass reads three columns. `stats` takes them stored: their few rows
    are then known to be few, and the join on the mode moves no shipment.
    """
    prepared = prepare_shipments(raw, lanes, as_sent)
    if stats is None:
        stats = winsor_stats(prepared, "freight_cost_usd", "transport_mode")
    rows = prepared
    if not as_sent:
        rows = rows.filter(F.col("qty_shipped") >= 0)
        rows = keep_known(rows, "from_location", locations, "location_id")
        rows = keep_known(rows, "to_location", locations, "location_id")
        rows = keep_known(rows, "sku_id", skus, "sku_id")
    rows = last_ingested(rows, ["shipment_id"])
    punctual = F.col("on_time_flag") if "on_time_flag" in rows.columns else on_time()
    rows = rows.join(stats, "transport_mode", "left").withColumns({
        "freight_cost_usd": winsorize("freight_cost_usd", F.col("cap"), F.col("capped_mean")),
        "on_time_flag": punctual,
    })
    # The check of order ids moves whole rows, so they are cut to the clean layout first.
    rows = rows.select(*[c for c in CLEAN_SCHEMAS["fact_shipments"].names if c in rows.columns])
    rows = null_if_orphan(rows, "order_id", orders, "order_id")
    return conform(rows, "fact_shipments")


def judge_inventory(raw: DataFrame, locations: DataFrame, skus: DataFrame) -> DataFrame:
    rows = require_key(raw, "snapshot_date").select(
        to_date("snapshot_date").alias("snapshot_date"),
        clean_text("location_id").alias("location_id"),
        normalize_sku("sku_id").alias("sku_id"),
        floor_zero(to_int("on_hand_qty")).alias("on_hand_qty"),
        floor_zero(to_int("on_order_qty")).alias("on_order_qty"),
        floor_zero(to_int(_extra(raw, "backorder_qty"))).alias("backorder_qty"),
        to_int(_extra(raw, "safety_stock_qty")).alias("safety_stock_qty"),
        to_int(_extra(raw, "reorder_point_qty")).alias("reorder_point_qty"),
        to_date(_extra(raw, "last_receipt_date")).alias("last_receipt_date"),
        to_date(_extra(raw, "last_issue_date")).alias("last_issue_date"),
        "_ingest_seq",
    )
    rows = keep_known(rows, "location_id", locations, "location_id")
    rows = keep_known(rows, "sku_id", skus, "sku_id")
    return judged(rows, "fact_inventory_snapshot")


def clean_inventory(raw: DataFrame, locations: DataFrame, skus: DataFrame, last_only: bool = True) -> DataFrame:
    """One snapshot per day, location and product; the earlier generation keeps them all (`last_only=False`)."""
    return accepted(judge_inventory(raw, locations, skus), "fact_inventory_snapshot", last_only)


def judged_layer(raw: dict[str, DataFrame], clean: dict[str, DataFrame], segment_source: str = "sku") -> dict[str, DataFrame]:
    """The judged rows of every table that has rejects; `clean` needs the locations and products."""
    locations, skus, raw_skus = clean["dim_location"], clean["dim_sku"], raw["dim_sku_raw"]
    return {
        "dim_sku": judge_skus(raw_skus),
        "dim_service_policy": judge_policy(raw["dim_service_policy_raw"]),
        "dim_lane_cost": judge_lanes(raw["dim_lane_cost_raw"], locations),
        "fact_sales_orders": judge_orders(raw["fact_sales_orders_raw"], raw_skus, skus, locations, segment_source),
        "fact_inventory_snapshot": judge_inventory(raw["fact_inventory_snapshot_raw"], locations, skus),
    }


def rejected_rows(judged_tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, key) of the rows that lost a required figure, over all judged tables."""
    return union_reports(*[rejects(rows, name) for name, rows in judged_tables.items()])


def clean_all(raw: dict[str, DataFrame], segment_source: str = "sku", earlier: bool = False) -> dict[str, DataFrame]:
    """The whole clean layer in dependency order; `earlier` by the rules of the earlier generation."""
    locations = clean_locations(raw["dim_location_raw"])
    skus = clean_skus(raw["dim_sku_raw"])
    lanes = clean_lanes(raw["dim_lane_cost_raw"], locations)
    orders = clean_orders(raw["fact_sales_orders_raw"], raw["dim_sku_raw"], skus, locations, segment_source)
    return {
        "dim_location": locations,
        "dim_sku": skus,
        "dim_service_policy": clean_policy(raw["dim_service_policy_raw"]),
        "dim_lane_cost": lanes,
        "fact_sales_orders": orders,
        "fact_shipments": clean_shipments(raw["fact_shipments_raw"], lanes, locations, skus, orders, as_sent=earlier),
        "fact_inventory_snapshot": clean_inventory(raw["fact_inventory_snapshot_raw"], locations, skus, last_only=not earlier),
    }
