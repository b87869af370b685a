"""Clean layer to analytical marts.

Facts are collapsed to the grain of the mart before any dimension is joined, so
joins see aggregated rows and a hot product or location is reduced map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inventory as inv
from ..functions.numeric import ratio, sd_from_sums, transit_days
from ..operators.keys import join_with_hot_keys, latest_per_key

MIN_OBSERVATION_DAYS = 30
DEMAND_KEYS = ["sku_id", "location_id", "customer_segment"]


@dataclass(frozen=True)
class CostRates:
    """Unit rates of the cost-to-serve model, as exact decimals in text."""

    handling_per_unit: str = "0.50"
    holding_per_year: str = "0.25"
    processing_per_order: str = "2.50"


def daily_demand(orders: DataFrame) -> DataFrame:
    """Ordered quantity per day, product, location and segment."""
    return (
        orders.filter(F.col("ship_to_location").isNotNull())
        .groupBy("order_date", "sku_id", F.col("ship_to_location").alias("location_id"), "customer_segment")
        .agg(
            F.sum("qty_ordered").alias("total_qty_ordered"),
            F.count_distinct("order_id").alias("num_orders"),
            F.avg("price_per_unit").alias("avg_price_per_unit"),
        )
    )


def with_calendar(df: DataFrame, col: str = "order_date") -> DataFrame:
    """Add the Monday and the first of the month of a date."""
    return df.withColumns({
        "week_start": F.date_trunc("week", col).cast("date"),
        "month_start": F.date_trunc("month", col).cast("date"),
    })


def demand_stats(
    orders: DataFrame,
    skus: DataFrame,
    policy: DataFrame,
    min_obs: int = MIN_OBSERVATION_DAYS,
    nulls_as_zero: bool = True,
) -> DataFrame:
    """Demand statistics and formula policy per product, location and segment.

    A group with a single day has no spread: 0 by default, NULL with
    ``nulls_as_zero=False``. The formulas take it as 0 either way.

    Days without orders are not observed days. Grouping the daily rows directly
    equals listing the keys first and joining the days back, since every key comes
    from at least one day. Percentiles are per-group: a group holds one value per
    calendar day at most. The observation filter runs before the joins.
    """
    days = daily_demand(orders)
    qty = F.col("total_qty_ordered")
    stats = (
        days.groupBy(*DEMAND_KEYS)
        .agg(
            F.count("order_date").alias("observation_days"),
            F.sum(qty).alias("_total"),
            F.avg(qty).alias("avg_demand_per_day"),
            F.stddev_samp(qty).alias("std_demand_per_day"),
            F.max(qty).alias("max_demand_per_day"),
            F.min(qty).alias("min_demand_per_day"),
            F.percentile(qty, [0.5, 0.9, 0.95]).alias("_p"),
        )
        .filter(F.col("observation_days") >= min_obs)
    )
    joined = stats.join(skus.select("sku_id", "category", "lead_time_days"), "sku_id").join(
        policy.select("customer_segment", "z_score", "target_fill_rate"), "customer_segment"
    )
    mean, sd, lead, z = (
        F.col(c) for c in ("avg_demand_per_day", "std_demand_per_day", "lead_time_days", "z_score")
    )
    return joined.select(
        *DEMAND_KEYS, "category", "lead_time_days", "z_score", "target_fill_rate",
        "observation_days", "avg_demand_per_day",
        (F.coalesce(sd, F.lit(0.0)) if nulls_as_zero else sd).alias("std_demand_per_day"),
        "max_demand_per_day", "min_demand_per_day",
        F.col("_p")[0].alias("p50_demand"),
        F.col("_p")[1].alias("p90_demand"),
        F.col("_p")[2].alias("p95_demand"),
        inv.coefficient_of_variation(mean, sd).alias("coefficient_of_variation"),
        inv.safety_stock(z, sd, lead).alias("safety_stock_units"),
        inv.reorder_point(mean, z, sd, lead).alias("reorder_point_units"),
        inv.annual_demand(F.col("_total"), F.col("observation_days")).alias("annual_demand_estimate"),
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per location and product."""
    return latest_per_key(snapshots, ["location_id", "sku_id"], [F.desc("snapshot_date")]).select(
        "location_id", "sku_id", "snapshot_date", "on_hand_qty", "on_order_qty", "backorder_qty",
        F.col("safety_stock_qty").alias("current_safety_stock_policy"),
        F.col("reorder_point_qty").alias("current_reorder_point_policy"),
    )


def inventory_position(
    snapshots: DataFrame,
    locations: DataFrame,
    skus: DataFrame,
    demand: DataFrame,
    with_service_status: bool = False,
) -> DataFrame:
    """Latest stock against the recommended policy; one row per demand segment of the pair."""
    places = locations.select("location_id", "location_name", "location_type", "region", "echelon")
    items = skus.select("sku_id", "description", "category", "unit_cost", "lead_time_days")
    advice = demand.select(
        "sku_id", "location_id", "avg_demand_per_day",
        F.col("safety_stock_units").alias("recommended_safety_stock"),
        F.col("reorder_point_units").alias("recommended_reorder_point"),
    )
    rows = (
        latest_snapshot(snapshots)
        .join(places, "location_id")
        .join(items, "sku_id")
        .join(advice, ["sku_id", "location_id"], "left")
    )
    on_hand = F.col("on_hand_qty")
    position = inv.inventory_position(on_hand, F.col("on_order_qty"), F.col("backorder_qty"))
    best_ss, own_ss = F.col("recommended_safety_stock"), F.col("current_safety_stock_policy")
    best_rop, own_rop = F.col("recommended_reorder_point"), F.col("current_reorder_point_policy")
    gap = inv.safety_stock_gap(best_ss, own_ss)
    columns = [
        "location_id", "location_name", "location_type", "region", "echelon", "sku_id", "description",
        "category", "unit_cost", "lead_time_days", F.col("snapshot_date").alias("as_of_date"),
        "on_hand_qty", "on_order_qty", "backorder_qty", position.alias("inventory_position"),
        "current_safety_stock_policy", "current_reorder_point_policy",
        "recommended_safety_stock", "recommended_reorder_point", "avg_demand_per_day",
        inv.days_of_supply(on_hand, F.col("avg_demand_per_day")).alias("days_of_supply"),
        inv.inventory_value(on_hand, F.col("unit_cost")).alias("inventory_value_usd"),
        inv.stock_status(position, on_hand, best_ss, own_ss, best_rop, own_rop).alias("stock_status"),
        gap.alias("safety_stock_gap_units"),
        (gap * F.col("unit_cost").cast("double")).alias("safety_stock_gap_usd"),
    ]
    if with_service_status:
        columns.append(inv.service_level_status(position, best_rop).alias("service_level_status"))
    return rows.select(*columns)


def order_costs(
    orders: DataFrame,
    skus: DataFrame,
    policy: DataFrame,
    shipments: DataFrame,
    locations: DataFrame,
    rates: CostRates = CostRates(),
) -> DataFrame:
    """Cost lines per order and shipment; an order without shipments keeps one line.

    Order ids must be unique. Both facts are shuffled once, also when one order has most shipments.
    """
    sent = shipments.filter(F.col("order_id").isNotNull()).select(
        "order_id", "freight_cost_usd", "qty_shipped", F.col("from_location").alias("_from")
    )
    lines = join_with_hot_keys(orders, sent, "order_id")
    ship_to = locations.select(F.col("location_id").alias("ship_to_location"), F.col("region").alias("ship_to_region"))
    source = locations.select(F.col("location_id").alias("_from"), F.col("location_type").alias("fulfilled_from_type"))
    qty, cost = F.col("qty_ordered"), F.col("unit_cost")
    short = (qty - F.col("qty_shipped")) * F.col("penalty_stockout_per_unit")
    holding = cost * F.col("lead_time_days") * qty * _money(rates.holding_per_year)
    return (
        lines.join(skus.select("sku_id", "unit_cost", "lead_time_days"), "sku_id")
        .join(policy.select("customer_segment", "penalty_stockout_per_unit"), "customer_segment")
        .join(ship_to, "ship_to_location", "left")
        .join(source, "_from", "left")
        .select(
            "order_id", "sku_id", "customer_segment", "ship_to_location", "ship_to_region",
            "fulfilled_from_type", "qty_ordered", "price_per_unit",
            (qty * F.col("price_per_unit")).alias("order_revenue"),
            (qty * cost).alias("product_cost"),
            F.coalesce("freight_cost_usd", F.lit(0).cast("decimal(10,2)")).alias("freight_cost"),
            (qty * _money(rates.handling_per_unit)).alias("warehouse_handling_cost"),
            ratio(holding, F.lit(inv.DAYS_PER_YEAR), 6).alias("carrying_cost"),
            F.coalesce(short, F.lit(0).cast("decimal(10,2)")).alias("stockout_cost"),
            _money(rates.processing_per_order).alias("order_processing_cost"),
        )
    )


def _money(text: str):
    return F.lit(text).cast("decimal(10,4)")


def cost_to_serve(
    orders: DataFrame,
    skus: DataFrame,
    policy: DataFrame,
    shipments: DataFrame,
    locations: DataFrame,
    rates: CostRates = CostRates(),
) -> DataFrame:
    """Cost and margin per segment, region and product over the lines of `order_costs`.

    Every cost line is linear in quantities, so shipments are first summed per
    order and orders per (segment, location, product); prices and rates are applied
    to those sums. An order with n shipments still counts n times, as its n lines
    would. Order ids must be unique. The one large join is order to shipment totals,
    on the id both sides are already grouped by.
    """
    sent = (
        shipments.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("_lines"),
            F.sum("freight_cost_usd").alias("_freight"),
            F.count("qty_shipped").alias("_counted"),
            F.sum("qty_shipped").alias("_shipped"),
        )
    )
    lines = F.coalesce("_lines", F.lit(1))
    units = F.col("qty_ordered") * lines
    summed = (
        orders.join(sent, "order_id", "left")
        .groupBy("customer_segment", "ship_to_location", "sku_id")
        .agg(
            F.count("order_id").alias("_orders"),
            F.sum(lines).alias("_lines"),
            F.sum(units).alias("_units"),
            F.sum(units * F.col("price_per_unit")).alias("_revenue"),
            F.sum("_freight").alias("_freight"),
            F.sum(F.col("qty_ordered") * F.col("_counted") - F.col("_shipped")).alias("_short"),
        )
    )
    regions = locations.select(
        F.col("location_id").alias("ship_to_location"), F.col("region").alias("ship_to_region")
    )
    zero = F.lit(0).cast("decimal(10,2)")
    priced = (
        summed.join(skus.select("sku_id", "unit_cost", "lead_time_days"), "sku_id")
        .join(policy.select("customer_segment", "penalty_stockout_per_unit"), "customer_segment")
        .join(regions, "ship_to_location", "left")
        .groupBy("customer_segment", "ship_to_region", "sku_id")
        .agg(
            F.sum("_orders").alias("num_orders"),
            F.sum("_units").alias("total_units_ordered"),
            F.sum("_revenue").cast("decimal(24,6)").alias("_revenue"),
            F.sum(F.col("_units") * F.col("unit_cost")).cast("decimal(24,6)").alias("_product"),
            F.coalesce(F.sum("_freight"), zero).cast("decimal(24,6)").alias("_freight"),
            (F.sum("_units") * _money(rates.handling_per_unit)).cast("decimal(24,6)").alias("_handling"),
            (F.sum(F.col("_units") * F.col("lead_time_days") * F.col("unit_cost"))).cast("decimal(24,6)").alias("_held"),
            F.coalesce(F.sum(F.col("_short") * F.col("penalty_stockout_per_unit")), zero)
            .cast("decimal(24,6)").alias("_stockout"),
            (F.sum("_lines") * _money(rates.processing_per_order)).cast("decimal(24,6)").alias("_processing"),
        )
    )
    # Carrying cost as exact daily cost: decimals down to 1e-12, rounded only in the output.
    held = (F.col("_held") * _money(rates.holding_per_year)).cast("decimal(26,10)")
    carrying = (held / F.lit(inv.DAYS_PER_YEAR)).cast("decimal(30,12)")
    plain = F.col("_product") + F.col("_freight") + F.col("_handling") + F.col("_stockout") + F.col("_processing")
    total = (plain + carrying).cast("decimal(30,12)")
    revenue, units_sum = F.col("_revenue"), F.col("total_units_ordered")

    def per(num, den, scale):
        d = F.nullif(den.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
        return F.round(num.cast("decimal(26,12)") / d, scale)

    return priced.select(
        "customer_segment", "ship_to_region", "sku_id", "num_orders", "total_units_ordered",
        F.round(revenue, 2).alias("total_revenue"),
        F.round("_product", 2).alias("total_product_cost"),
        F.round("_freight", 2).alias("total_freight_cost"),
        F.round("_handling", 2).alias("total_warehouse_cost"),
        F.round(carrying, 2).alias("total_carrying_cost"),
        F.round("_stockout", 2).alias("total_stockout_cost"),
        F.round("_processing", 2).alias("total_processing_cost"),
        F.round(total, 2).alias("total_cost"),
        F.round(revenue - total, 2).alias("gross_margin"),
        per(total, units_sum, 4).alias("cost_per_unit"),
        per(revenue, units_sum, 4).alias("revenue_per_unit"),
        per((revenue - total) * 100, revenue, 2).alias("margin_pct"),
    )


def network_flow(
    shipments: DataFrame, locations: DataFrame, skus: DataFrame, lanes: DataFrame
) -> DataFrame:
    """Shipped volume, freight and transit times per lane and product.

    Shipments are collapsed to (from, to, mode, product) first. A pair with several
    contract lanes at one price repeats its shipments once per lane; that multiplicity
    enters the sums as a factor instead of as rows. Shipment ids must be unique.
    """
    lead = transit_days("delivery_date", "ship_date")
    flow = (
        shipments.select("*", lead.alias("_days"))
        .groupBy("from_location", "to_location", "transport_mode", "sku_id")
        .agg(
            F.count("shipment_id").alias("num_shipments"),
            F.sum("qty_shipped").alias("_units"),
            F.sum("freight_cost_usd").alias("_freight"),
            F.count("freight_cost_usd").alias("_priced"),
            F.count("_days").alias("_timed"),
            F.sum("_days").alias("_day_sum"),
            F.sum(F.col("_days") * F.col("_days")).alias("_day_squares"),
            F.count_if(F.col("on_time_flag")).alias("_on_time"),
        )
    )
    contracts = lanes.groupBy("from_location", "to_location", "transport_mode", "cost_per_unit").agg(
        F.count(F.lit(1)).alias("_lanes")
    )
    start = locations.select(
        F.col("location_id").alias("from_location"),
        F.col("location_name").alias("from_location_name"), F.col("location_type").alias("from_type"),
    )
    end = locations.select(
        F.col("location_id").alias("to_location"),
        F.col("location_name").alias("to_location_name"), F.col("location_type").alias("to_type"),
    )
    rows = (
        flow.join(start, "from_location")
        .join(end, "to_location")
        .join(skus.select("sku_id", "category"), "sku_id")
        .join(contracts, ["from_location", "to_location", "transport_mode"], "left")
    )
    times = F.coalesce("_lanes", F.lit(1))
    units, freight = F.col("_units"), F.col("_freight")
    paid = freight.cast("decimal(24,6)") / F.nullif(units.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return rows.select(
        "from_location", "from_location_name", "from_type",
        "to_location", "to_location_name", "to_type", "transport_mode", "sku_id", "category",
        "num_shipments",
        (units * times).alias("total_units_shipped"),
        F.round(freight * times, 2).alias("total_freight_cost"),
        ratio(freight, F.col("_priced"), 4).alias("avg_freight_per_shipment"),
        F.round(paid, 4).alias("freight_cost_per_unit"),
        ratio(F.col("_day_sum"), F.col("_timed"), 2).alias("avg_actual_lead_time_days"),
        F.round(
            sd_from_sums(F.col("_timed") * times, F.col("_day_sum") * times, F.col("_day_squares") * times), 4
        ).alias("std_actual_lead_time_days"),
        ratio(F.col("_on_time") * 100, F.col("num_shipments"), 2).alias("on_time_pct"),
        F.col("cost_per_unit").alias("contracted_cost_per_unit"),
        F.round(paid - F.col("cost_per_unit"), 4).alias("freight_variance_per_unit"),
    )


# What each mart offers to its readers.
MART_PURPOSE = {
    "mart_demand_stats": "daily demand mean, spread and percentiles with formula stock policy",
    "mart_inventory_position": "latest stock, cover, status and gap to the recommended policy",
    "mart_cost_to_serve": "cost lines, margin and unit economics by segment, region and product",
    "mart_network_flow": "volume, freight and transit time by lane and product",
    "mart_data_quality_report": "issues found in the raw layer and how each is resolved",
}


def mart_summary(marts: dict[str, DataFrame]) -> DataFrame:
    """Row count and purpose of each mart, sorted by name."""
    from ..operators.audit import row_counts

    pairs = [F.lit(v) for item in MART_PURPOSE.items() for v in item]
    purpose = F.try_element_at(F.create_map(*pairs), F.col("mart_name"))
    return row_counts(marts, label="mart_name").withColumn("purpose", purpose).orderBy("mart_name")


def build_marts(
    raw: dict[str, DataFrame], clean: dict[str, DataFrame], min_obs: int = MIN_OBSERVATION_DAYS,
    demand: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All five marts from one raw and one clean layer; `demand` takes the demand mart as stored."""
    from .quality import quality_issues

    locations, skus, policy = clean["dim_location"], clean["dim_sku"], clean["dim_service_policy"]
    orders, shipments = clean["fact_sales_orders"], clean["fact_shipments"]
    demand = demand_stats(orders, skus, policy, min_obs) if demand is None else demand
    return {
        "mart_demand_stats": demand,
        "mart_inventory_position": inventory_position(
            clean["fact_inventory_snapshot"], locations, skus, demand, with_service_status=True
        ),
        "mart_cost_to_serve": cost_to_serve(orders, skus, policy, shipments, locations),
        "mart_network_flow": network_flow(shipments, locations, skus, clean["dim_lane_cost"]),
        "mart_data_quality_report": quality_issues(raw, with_timestamp=True),
    }
