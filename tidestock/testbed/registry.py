"""Every operator as a named query over the test tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import inventory as inv
from ..functions import text as tx
from ..operators import keys as k
from ..operators.audit import audit_constraints, row_counts
from ..operators.filters import equality_filter, require_key
from ..operators.impute import group_mean_int, winsor_stats, winsorize_impute
from ..plans import clean as cl
from ..plans import marts as m
from ..plans.pipeline import run_pipeline
from ..plans import policy as pol
from ..plans import quality as q
from ..plans import scenario as sc
from ..schemas import CLEAN_SCHEMAS, CLEAN_TABLES, RAW_FILES, RAW_SCHEMAS
from ..sources import tables as store
from ..sources.csv import export_csv, read_raw
from . import adapter
from .oracle import LONGEST_PRICE, PLAIN_NUMBER, REPAIRED, cents, half_away, key, number, statement, whole


def portable(df: DataFrame) -> DataFrame:
    """Types both engines hand over alike: double for decimals, long for integers, text for dates."""
    cast = {T.DecimalType: "double", T.FloatType: "double", T.IntegerType: "long", T.DateType: "string"}
    return df.select(*[
        F.col(f.name).cast(cast[type(f.dataType)]).alias(f.name) if type(f.dataType) in cast else F.col(f.name)
        for f in df.schema.fields
    ])


def rounded(df: DataFrame, scale: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, scale) for c in cols})


class Bed:
    """Derived tables of one data folder.

    Dimensions are stored once per query, as the pipeline does, so that facts join
    tables of known size. Facts are stored where a query reads them more than once
    (`table`) and stay part of one plan otherwise (`plan`). `stored_lines` stores the
    join that both raw facts are derived from, for queries that read them several times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored_lines: bool = False):
        self.spark = spark
        self.raw = adapter.RawLayer(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}
        self._root: str | None = None
        if stored_lines:
            self.raw.keep_lines(self._stored)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def plan(self, name: str) -> DataFrame:
        return self._once(name, lambda: self._build(name))

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        self._root = self._root or store.stage_root(self.spark)
        return store.stage(df, self._root, name)

    def table(self, name: str) -> DataFrame:
        return self._once(f"stored {name}", lambda: self._stored(self.plan(name), name))

    def _build(self, name: str) -> DataFrame:
        raw = self.raw[f"{name}_raw"]
        if name == "dim_location":
            return cl.clean_locations(raw)
        if name == "dim_sku":
            return cl.clean_skus(raw)
        if name == "dim_service_policy":
            return cl.clean_policy(raw)
        if name == "dim_lane_cost":
            return cl.clean_lanes(raw, self.locations)
        if name == "fact_sales_orders":
            return cl.clean_orders(raw, self.raw["dim_sku_raw"], self.skus, self.locations)
        if name == "fact_inventory_snapshot":
            return cl.clean_inventory(raw, self.locations, self.skus)
        orders = self._made.get("stored fact_sales_orders", None) or self.plan("fact_sales_orders")
        return cl.clean_shipments(raw, self.lanes, self.locations, self.skus, orders, self.freight)

    @property
    def locations(self) -> DataFrame:
        return self.table("dim_location")

    @property
    def skus(self) -> DataFrame:
        return self.table("dim_sku")

    @property
    def policy(self) -> DataFrame:
        return self.table("dim_service_policy")

    @property
    def lanes(self) -> DataFrame:
        return self.table("dim_lane_cost")

    @property
    def orders(self) -> DataFrame:
        return self.plan("fact_sales_orders")

    @property
    def shipments(self) -> DataFrame:
        return self.plan("fact_shipments")

    @property
    def stock(self) -> DataFrame:
        return self.plan("fact_inventory_snapshot")

    @property
    def freight(self) -> DataFrame:
        """Freight statistics, stored: a few rows of known size."""
        return self._once("freight", lambda: self._stored(cl.freight_stats(self.raw["fact_shipments_raw"], self.lanes), "freight_stats"))

    @property
    def prepared(self) -> DataFrame:
        return self._once("prepared", lambda: cl.prepare_shipments(self.raw["fact_shipments_raw"], self.lanes))

    @property
    def clean(self) -> dict[str, DataFrame]:
        """The whole clean layer, stored."""
        return {name: self.table(name) for name in CLEAN_TABLES}

    def demand(self, min_obs: int = m.MIN_OBSERVATION_DAYS) -> DataFrame:
        return self._once(f"demand{min_obs}", lambda: m.demand_stats(self.orders, self.skus, self.policy, min_obs))

    @property
    def flow(self) -> DataFrame:
        return self._once("flow", lambda: m.network_flow(self.shipments, self.locations, self.skus, self.lanes))

    @property
    def simulated(self) -> DataFrame:
        return self._once("simulated", lambda: pol.simulate_policy(self.demand(), pol.assign_lead_time(self.flow)))

    @property
    def measured(self) -> DataFrame:
        return self._once("measured", lambda: pol.assign_lead_time(self.flow, mode="lane", shipments=self.shipments))

    @property
    def what_if(self) -> DataFrame:
        return self._once("what_if", lambda: sc.scenario(self.simulated))


@dataclass(frozen=True)
class Query:
    build: Callable[[Bed], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}

#: Queries that read the raw facts more than once, most by way of the shipments, which need freight statistics and orders.
SEVERAL_READS = frozenset(
    "clean_shipments clean_shipments_v1 order_costs cost_to_serve network_flow quality_issues quality_summary score_card cleaning_audit constraint_keys"
    " constraint_audit row_counts clean_row_counts mart_summary lead_times lead_times_lane simulate_policy scenario scenario_one_sku"
    " policy_comparison high_risk high_risk_85 scenario_one_location top_cost scenario_kpis scenario_by_sku orphan_orders".split()
)


def add(name: str, build: Callable[[Bed], DataFrame], sql: str | None = None) -> None:
    REGISTRY[name] = Query(build, statement(sql) if sql else None)


def _counted(df: DataFrame, *cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


# --- column functions -------------------------------------------------------------

add(
    "normalize_sku",
    lambda b: _counted(b.raw["fact_sales_orders_raw"], F.col("sku_id").alias("raw_sku"),
                       tx.normalize_sku("sku_id").alias("sku_id")),
    f"SELECT sku_id AS raw_sku, {key('sku_id')} AS sku_id, count(*) AS n FROM order_raw GROUP BY ALL",
)
add(
    "flag_normalize",
    lambda b: _counted(b.raw["dim_sku_raw"], F.col("active").alias("raw_flag"),
                       tx.to_flag("active").alias("flag")),
    "SELECT active AS raw_flag, upper(trim(active)) IN ('Y', 'YES', '1', 'TRUE', 'T') AS flag, count(*) AS n"
    " FROM sku_raw GROUP BY ALL",
)
add(
    "enum_remap",
    lambda b: _counted(b.raw["dim_lane_cost_raw"], F.col("carrier_mode"),
                       tx.remap("carrier_mode", tx.MODE_BY_CARRIER).alias("transport_mode")),
    "SELECT carrier_mode, CASE WHEN upper(carrier_mode) IN ('TL', 'LTL', 'PARCEL') THEN 'TRUCK'"
    " WHEN upper(carrier_mode) = 'INTERMODAL' THEN 'RAIL' END AS transport_mode, count(*) AS n FROM lane_raw GROUP BY ALL",
)
add(
    "echelon_remap",
    lambda b: _counted(b.raw["dim_location_raw"], tx.clean_enum("location_type").alias("location_type"),
                       tx.remap("location_type", tx.ECHELON_BY_TYPE).cast("long").alias("echelon")),
    "SELECT upper(trim(location_type)) AS location_type, CASE upper(trim(location_type)) WHEN 'DC' THEN 1"
    " WHEN 'RDC' THEN 2 WHEN 'STORE' THEN 3 END::BIGINT AS echelon, count(*) AS n FROM location_raw GROUP BY ALL",
)
add(
    "numeric_guard",
    lambda b: _counted(
        b.raw["fact_shipments_raw"].select(
            tx.is_numeric("freight_cost_usd").alias("freight_is_number"),
            tx.is_signed_int(F.regexp_replace("quantity_shipped", r"\.0$", "")).alias("qty_is_integer"),
            tx.is_missing("freight_cost_usd").alias("freight_missing"),
        ), "freight_is_number", "qty_is_integer", "freight_missing"),
    f"SELECT regexp_full_match(freight, {PLAIN_NUMBER}) AS freight_is_number,"
    " coalesce(regexp_full_match(qty::VARCHAR, '-?[0-9]+'), FALSE) AS qty_is_integer,"
    " trim(coalesce(freight, '')) = '' AS freight_missing, count(*) AS n FROM shipment_raw GROUP BY ALL",
)
add(
    "coerce_numeric",
    lambda b: _counted(sc.coerce_numeric(
        b.raw["fact_shipments_raw"].select(F.col("freight_cost_usd").alias("raw_freight"), F.col("freight_cost_usd").alias("freight")),
        ["freight"]), "raw_freight", "freight"),
    "SELECT freight AS raw_freight, coalesce(try_cast(freight AS DOUBLE), 0) AS freight, count(*) AS n"
    " FROM shipment_raw GROUP BY ALL",
)
_LEVELS = "85 1.04 86 1.08 87 1.13 88 1.17 89 1.23 90 1.28 91 1.34 92 1.41 93 1.48 94 1.55 95 1.65 96 1.75 97 1.88 98 2.05 99 2.33".split()
add(
    "z_lookup",
    lambda b: _counted(
        b.raw["fact_shipments_raw"].select((F.coalesce(tx.to_int("quantity_shipped"), F.lit(0)) % 18 + 83).alias("level")),
        F.col("level").cast("long").alias("level"), inv.z_for_service_level(F.col("level")).alias("z")),
    f"SELECT level, CASE level {' '.join(f'WHEN {a} THEN {z}' for a, z in zip(_LEVELS[::2], _LEVELS[1::2]))} ELSE 1.65 END::DOUBLE AS z,"
    " count(*) AS n FROM (SELECT coalesce(qty, 0) % 18 + 83 AS level FROM shipment_raw) GROUP BY ALL",
)

# --- sources ----------------------------------------------------------------------

_HARD_TEXT = (
    "'say \"' || p_name || '\", then ' || chr(92) || CASE WHEN p_partkey % 3 = 0 THEN chr(10) ELSE ',' END || p_type || chr(92)"
)


def _csv_round_trip(b: Bed) -> DataFrame:
    """Names with quotes, commas, backslashes and line breaks, written as CSV and scanned again."""
    schema = RAW_SCHEMAS["dim_location_raw"]
    stop = F.when(F.col("p_partkey") % 3 == 0, "\n").otherwise(",")
    hard = F.concat(F.lit('say "'), "p_name", F.lit('", then \\'), stop, "p_type", F.lit("\\"))
    made = b.raw.given["part"].select(
        F.col("p_partkey").cast("string").alias("location_id"), hard.alias("location_name"), F.lit(None).cast("string").alias("city"),
        F.lit("").alias("state"), F.lit("DC").alias("location_type"), F.col("p_type").alias("region"),
        F.col("p_size").cast("string").alias("capacity_units"), F.lit("1").alias("operating_cost_per_day"),
    )
    path = f"{store.stage_root(b.spark)}/csv"
    export_csv(made, path)
    return read_raw(b.spark, path, schema, multi_line=True).drop("_ingest_seq")


add(
    "csv_round_trip", _csv_round_trip,
    f"SELECT p_partkey::VARCHAR AS location_id, {_HARD_TEXT} AS location_name, NULL::VARCHAR AS city, NULL::VARCHAR AS state,"
    " 'DC' AS location_type, p_type AS region, p_size::VARCHAR AS capacity_units, '1' AS operating_cost_per_day FROM part",
)

# --- key and group operators ------------------------------------------------------

add(
    "duplicate_count",
    lambda b: k.duplicate_count(b.raw["fact_sales_orders_raw"], "order_id"),
    "SELECT count(*) AS total_rows, count(DISTINCT order_id) AS unique_keys,"
    " count(*) - count(DISTINCT order_id) AS duplicate_rows FROM order_raw",
)
add(
    "semi_known_keys",
    lambda b: _counted(k.keep_known(
        b.raw["fact_sales_orders_raw"].select(tx.normalize_sku("sku_id").alias("sku_id")), "sku_id", b.skus, "sku_id"),
        "sku_id"),
    f"SELECT {key('sku_id')} AS sku_id, count(*) AS n FROM order_raw"
    f" WHERE {key('sku_id')} IN (SELECT sku_id FROM sku) GROUP BY 1",
)
add(
    "orphan_orders",
    lambda b: _counted(k.null_if_orphan(
        b.prepared.select("transport_mode", "order_id"), "order_id", b.orders, "order_id"),
        "transport_mode", F.col("order_id").isNull().alias("orphan")),
    "SELECT transport_mode, order_id NOT IN (SELECT order_id FROM sales) AS orphan, count(*) AS n"
    " FROM ship_ready GROUP BY ALL",
)
add(
    "category_lead_time",
    lambda b: group_mean_int(b.raw["dim_sku_raw"].withColumn("category", tx.clean_enum("category")),
                             "lead_time_days", "category"),
    "SELECT * FROM category_mean",
)
add(
    "freight_stats",
    lambda b: rounded(portable(winsor_stats(b.prepared, "freight_cost_usd", "transport_mode")), 4, "capped_mean"),
    f"SELECT transport_mode, cap_e4 / 10000.0::DOUBLE AS cap, {half_away('capped_sum', 'n * 10000', 4)} AS capped_mean"
    " FROM freight_stat",
)
add(
    "freight_winsorize",
    lambda b: _counted(winsorize_impute(b.prepared, "freight_cost_usd", "transport_mode"),
                       "transport_mode", "freight_cost_usd"),
    f"SELECT transport_mode, freight_cost_usd, count(*) AS n FROM (SELECT s.transport_mode, ({REPAIRED}) / 100.0 AS freight_cost_usd"
    " FROM ship_ready s LEFT JOIN freight_stat f ON s.transport_mode = f.transport_mode) GROUP BY ALL",
)
add("best_lane", lambda b: cl.best_lane(b.lanes),
    "SELECT from_location, to_location, transport_mode, transit_days::DOUBLE AS transit_days_mean FROM lane_best")
add("sku_options", lambda b: k.distinct_values(b.orders, "sku_id"), "SELECT DISTINCT sku_id FROM sales")
add("demand_keys", lambda b: k.distinct_keys(b.orders, "sku_id", "ship_to_location", "customer_segment"),
    "SELECT DISTINCT sku_id, ship_to_location, customer_segment FROM sales")

# --- clean layer ------------------------------------------------------------------

add("rejected_rows", lambda b: _counted(cl.rejected_rows(cl.judged_layer(b.raw, {"dim_location": b.locations, "dim_sku": b.skus})),
                                    "table_name", "column_name", "key"),
    "SELECT *, count(*) AS n FROM rejected GROUP BY ALL")
add("clean_locations", lambda b: b.plan("dim_location"),
    "SELECT *, NULL::DOUBLE AS storage_cost_per_unit FROM location")
add("clean_skus", lambda b: b.plan("dim_sku"),
    "SELECT sku_id, description, category, NULL::VARCHAR AS subcategory, cost_cents / 100.0::DOUBLE AS unit_cost,"
    " NULL::DOUBLE AS unit_volume_cuft, unit_weight_lbs, supplier_id, lead_time_days, reorder_point, active,"
    " NULL::VARCHAR AS last_updated FROM sku")
add("clean_policy", lambda b: b.plan("dim_service_policy"),
    "SELECT customer_segment, round(target_fill_rate, 4) AS target_fill_rate, z_score,"
    " penalty::DOUBLE AS penalty_stockout_per_unit, priority_rank, max_backorder_days, NULL::BIGINT AS expedite_threshold,"
    " review_period_days, holding_cost_rate, NULL::BIGINT AS min_order_qty FROM policy")
add("clean_lanes", lambda b: b.plan("dim_lane_cost"),
    "SELECT lane_id, from_location, to_location, transport_mode, distance_miles::DOUBLE AS distance_miles,"
    " transit_days::DOUBLE AS transit_days_mean, NULL::DOUBLE AS transit_days_std,"
    " unit_e4 / 10000.0::DOUBLE AS cost_per_unit, lb_e3 / 1000.0::DOUBLE AS cost_per_lb FROM lane")
add("clean_orders", lambda b: b.orders,
    "SELECT order_id, order_date::VARCHAR AS order_date, sku_id, customer_id, ship_to_location, customer_segment,"
    " qty_ordered, price_cents / 100.0::DOUBLE AS price_per_unit, channel, FALSE AS priority_flag FROM sales")
add("clean_shipments", lambda b: b.shipments,
    "SELECT shipment_id, order_id, ship_date::VARCHAR AS ship_date, delivery_date::VARCHAR AS delivery_date,"
    " from_location, to_location, sku_id, qty_shipped, transport_mode, freight_cents / 100.0::DOUBLE AS freight_cost_usd,"
    " carrier, on_time_flag, NULL::BOOLEAN AS damage_flag FROM shipment")
add("clean_inventory", lambda b: b.stock,
    "SELECT snapshot_date::VARCHAR AS snapshot_date, location_id, sku_id, on_hand_qty, on_order_qty,"
    " 0::BIGINT AS backorder_qty, NULL::BIGINT AS safety_stock_qty, NULL::BIGINT AS reorder_point_qty,"
    " NULL::VARCHAR AS last_receipt_date, NULL::VARCHAR AS last_issue_date FROM stock")

# The earlier generation's rules, on columns that only its extracts have.
_UPDATED = "CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE (DATE '2024-01-01' + (p_partkey * 37 % 300)::INTEGER)::VARCHAR END"


def _skus_v1(b: Bed) -> DataFrame:
    key = F.col("_ingest_seq")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key * 37 % 300).cast("int")).cast("string")
    raw = b.raw["dim_sku_raw"].withColumn("last_updated", F.when(key % 7 != 3, day))
    return cl.clean_skus(raw).select("sku_id", "description", "unit_cost", "lead_time_days", "last_updated")


add(
    "clean_skus_v1", _skus_v1,
    f"""SELECT {key('sku_id')} AS sku_id, sku_name AS description, {cents('unit_cost_usd')} / 100.0::DOUBLE AS unit_cost,
  coalesce({whole('lead_time_days')}, group_mean, 7) AS lead_time_days, u AS last_updated
FROM sku_raw JOIN (SELECT p_partkey, {_UPDATED} AS u FROM part) ON seq = p_partkey
LEFT JOIN category_mean ON upper(trim(sku_raw.category)) = category_mean.category WHERE {number('unit_cost_usd')} < 1e8
QUALIFY row_number() OVER (PARTITION BY {key('sku_id')} ORDER BY u DESC NULLS FIRST, seq DESC) = 1""",
)
add(
    "clean_shipments_v1",
    lambda b: cl.clean_shipments(b.raw["fact_shipments_raw"], b.lanes, b.locations, b.skus, b.orders, b.freight, as_sent=True),
    f"""SELECT shipment_id, CASE WHEN order_id IN (SELECT order_id FROM sales) THEN order_id END AS order_id,
  ship_date::VARCHAR AS ship_date, arrival_date::VARCHAR AS delivery_date, origin AS from_location, to_location, sku AS sku_id,
  qty AS qty_shipped, s.transport_mode, ({REPAIRED}) / 100.0::DOUBLE AS freight_cost_usd, carrier,
  CASE WHEN arrival_date IS NOT NULL AND transit_days IS NOT NULL THEN arrival_date - ship_date <= transit_days
    WHEN status = 'delayed' THEN FALSE END AS on_time_flag, NULL::BOOLEAN AS damage_flag
FROM (SELECT * FROM ship_ready QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY seq DESC) = 1) s
LEFT JOIN freight_stat f ON s.transport_mode = f.transport_mode""",
)


def _own_policy(b: Bed) -> DataFrame:
    """Snapshots that state backorders and their own policy."""
    k = F.col("_ingest_seq")
    return b.raw["fact_inventory_snapshot_raw"].withColumns({
        "backorder_qty": (k % 30).cast("string"), "safety_stock_qty": F.when(k % 4 > 0, (k % 90).cast("string")),
        "reorder_point_qty": F.when(k % 5 > 0, (k % 60).cast("string"))})


add(
    "clean_inventory_v1",
    lambda b: cl.clean_inventory(_own_policy(b), b.locations, b.skus, last_only=False),
    f"""SELECT snapshot_date::VARCHAR AS snapshot_date, location_id, {key('sku_id')} AS sku_id, greatest(coalesce(on_hand, 0), 0) AS on_hand_qty,
  coalesce(on_order, 0) AS on_order_qty, seq % 30 AS backorder_qty, CASE WHEN seq % 4 > 0 THEN seq % 90 END AS safety_stock_qty,
  CASE WHEN seq % 5 > 0 THEN seq % 60 END AS reorder_point_qty, NULL::VARCHAR AS last_receipt_date, NULL::VARCHAR AS last_issue_date
FROM snapshot_raw WHERE snapshot_date IS NOT NULL AND location_id IN (SELECT location_id FROM location)
  AND {key('sku_id')} IN (SELECT sku_id FROM sku)""",
)

_FROM_CHANNEL = "CASE WHEN left(channel, 1) = '1' THEN ' premium' WHEN left(channel, 1) < '4' THEN 'Standard' ELSE 'BUDGET' END"


def _orders_as_sent(b: Bed) -> DataFrame:
    raw = b.raw["fact_sales_orders_raw"].withColumn("customer_segment", F.expr(_FROM_CHANNEL))
    rows = cl.clean_orders(raw, b.raw["dim_sku_raw"], b.skus, b.locations, segment_source="order")
    return rows.select("order_id", "sku_id", "customer_segment", "qty_ordered", "price_per_unit", "priority_flag")


add(
    "clean_orders_as_sent", _orders_as_sent,
    f"SELECT trim(order_id) AS order_id, {key('sku_id')} AS sku_id, upper(trim({_FROM_CHANNEL})) AS customer_segment,"
    f" round({number('quantity')})::BIGINT AS qty_ordered, CASE WHEN price_cents <= {LONGEST_PRICE} THEN price_cents / 100.0::DOUBLE END"
    f" AS price_per_unit, FALSE AS priority_flag FROM order_raw WHERE {key('sku_id')} IN (SELECT sku_id FROM sku) AND order_date IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY trim(order_id) ORDER BY seq DESC) = 1",
)

# --- marts ------------------------------------------------------------------------

_DAILY_SQL = (
    "SELECT order_date::VARCHAR AS order_date, sku_id, location_id, customer_segment, q AS total_qty_ordered, num_orders,"
    f" {half_away('price_sum * 10000', 'num_orders')} / 1000000.0 AS avg_price_per_unit"
)
add("daily_demand", lambda b: m.daily_demand(b.orders), f"{_DAILY_SQL} FROM day")
add("demand_calendar", lambda b: m.with_calendar(m.daily_demand(b.orders)),
    f"{_DAILY_SQL}, date_trunc('week', order_date)::DATE::VARCHAR AS week_start,"
    " date_trunc('month', order_date)::DATE::VARCHAR AS month_start FROM day")

_STAT_COLS = ("std_demand_per_day", "p50_demand", "p90_demand", "p95_demand", "coefficient_of_variation")


def _demand_sql(source: str) -> str:
    soft = ", ".join(f"round({c}, 4) AS {c}" for c in _STAT_COLS)
    return (
        f"SELECT * EXCLUDE ({', '.join(_STAT_COLS)}) REPLACE (round(target_fill_rate, 4) AS target_fill_rate), {soft}"
        f" FROM {source}"
    )


add("demand_stats", lambda b: rounded(b.demand(), 4, *_STAT_COLS), _demand_sql("demand"))
add("demand_stats_min5", lambda b: rounded(b.demand(5), 4, *_STAT_COLS),
    _demand_sql("demand_all WHERE observation_days >= 5"))
add(
    "latest_snapshot", lambda b: m.latest_snapshot(b.stock),
    "SELECT location_id, sku_id, snapshot_date::VARCHAR AS snapshot_date, on_hand_qty, on_order_qty, 0::BIGINT AS backorder_qty,"
    " NULL::BIGINT AS current_safety_stock_policy, NULL::BIGINT AS current_reorder_point_policy FROM stock_latest",
)
add(
    "inventory_position",
    lambda b: m.inventory_position(b.stock, b.locations, b.skus, b.demand(), with_service_status=True),
    """SELECT s.location_id, location_name, location_type, region, echelon, s.sku_id, description, sku.category,
  cost_cents / 100.0::DOUBLE AS unit_cost, sku.lead_time_days, snapshot_date::VARCHAR AS as_of_date, on_hand_qty, on_order_qty,
  0::BIGINT AS backorder_qty, on_hand_qty + on_order_qty AS inventory_position,
  NULL::BIGINT AS current_safety_stock_policy, NULL::BIGINT AS current_reorder_point_policy,
  safety_stock_units AS recommended_safety_stock, reorder_point_units AS recommended_reorder_point, avg_demand_per_day,
  round(on_hand_qty / avg_demand_per_day) AS days_of_supply, on_hand_qty * cost_cents / 100.0::DOUBLE AS inventory_value_usd,
  CASE WHEN on_hand_qty + on_order_qty < coalesce(safety_stock_units, 0) THEN 'UNDERSTOCKED'
    WHEN on_hand_qty > 2 * coalesce(reorder_point_units, 0) THEN 'OVERSTOCKED' ELSE 'NORMAL' END AS stock_status,
  coalesce(safety_stock_units, 0) AS safety_stock_gap_units,
  coalesce(safety_stock_units, 0) * (cost_cents / 100.0::DOUBLE) AS safety_stock_gap_usd,
  CASE WHEN on_hand_qty + on_order_qty >= reorder_point_units THEN 'SAFE' ELSE 'RISK' END AS service_level_status
FROM stock_latest s JOIN location USING (location_id) JOIN sku ON s.sku_id = sku.sku_id
LEFT JOIN demand d ON s.sku_id = d.sku_id AND s.location_id = d.location_id""",
)
add(
    "inventory_position_v1",
    lambda b: m.inventory_position(
        cl.clean_inventory(_own_policy(b), b.locations, b.skus), b.locations, b.skus, b.demand()
    ).select("location_id", "sku_id", "backorder_qty", "inventory_position", "current_safety_stock_policy", "current_reorder_point_policy",
             "stock_status", "safety_stock_gap_units"),
    """SELECT s.location_id, s.sku_id, seq % 30 AS backorder_qty, on_hand_qty + on_order_qty - seq % 30 AS inventory_position,
  CASE WHEN seq % 4 > 0 THEN seq % 90 END AS current_safety_stock_policy, CASE WHEN seq % 5 > 0 THEN seq % 60 END AS current_reorder_point_policy,
  CASE WHEN on_hand_qty + on_order_qty - seq % 30 < coalesce(safety_stock_units, CASE WHEN seq % 4 > 0 THEN seq % 90 END, 0) THEN 'UNDERSTOCKED'
    WHEN on_hand_qty > 2 * coalesce(reorder_point_units, CASE WHEN seq % 5 > 0 THEN seq % 60 END, 0) THEN 'OVERSTOCKED' ELSE 'NORMAL' END AS stock_status,
  coalesce(safety_stock_units, 0) - coalesce(CASE WHEN seq % 4 > 0 THEN seq % 90 END, 0) AS safety_stock_gap_units
FROM stock_latest s JOIN location USING (location_id) JOIN sku ON s.sku_id = sku.sku_id
LEFT JOIN demand d ON s.sku_id = d.sku_id AND s.location_id = d.location_id""",
)
add(
    "order_costs",
    lambda b: m.order_costs(
        b.table("fact_sales_orders"), b.skus, b.policy, b.table("fact_shipments"), b.locations),
    "SELECT order_id, sku_id, customer_segment, ship_to_location, ship_to_region, fulfilled_from_type, qty_ordered,"
    " price_cents / 100.0::DOUBLE AS price_per_unit, revenue_c / 100.0::DOUBLE AS order_revenue,"
    " product_c / 100.0::DOUBLE AS product_cost, freight_c / 100.0::DOUBLE AS freight_cost,"
    f" handling_c / 100.0::DOUBLE AS warehouse_handling_cost, {half_away('held_c', '146000', 6)} AS carrying_cost,"
    " stockout_c / 100.0::DOUBLE AS stockout_cost, 2.5::DOUBLE AS order_processing_cost FROM order_line",
)
_SERVED_SQL = (
    "SELECT customer_segment, ship_to_region, sku_id, num_orders, units AS total_units_ordered,"
    " rev::DOUBLE / 100 AS total_revenue, prod::DOUBLE / 100 AS total_product_cost, frt::DOUBLE / 100 AS total_freight_cost,"
    f" hnd::DOUBLE / 100 AS total_warehouse_cost, {half_away('held', '146000', 2)} AS total_carrying_cost,"
    " sto::DOUBLE / 100 AS total_stockout_cost, prc::DOUBLE / 100 AS total_processing_cost,"
    f" {half_away('tot', '146000', 2)} AS total_cost, {half_away('rev_x - tot', '146000', 2)} AS gross_margin,"
    f" {half_away('tot', 'units * 146000', 4)} AS cost_per_unit, {half_away('rev', 'units * 100', 4)} AS revenue_per_unit,"
    f" {half_away('(rev_x - tot) * 100', 'rev_x', 2)} AS margin_pct FROM served_total"
)
add("cost_to_serve", lambda b: m.cost_to_serve(
    b.table("fact_sales_orders"), b.skus, b.policy, b.shipments, b.locations), _SERVED_SQL)
add("network_flow", lambda b: b.flow, "SELECT * FROM flow")

# --- quality ----------------------------------------------------------------------

_ISSUE_SQL = {
    ("dim_sku", "sku_id_format"): f"(SELECT count(*) FROM sku_raw WHERE sku_id <> {key('sku_id')})",
    ("dim_sku", "lead_time_null"): "(SELECT count(*) FROM sku_raw WHERE coalesce(lead_time_days, '') = '')",
    ("dim_sku", "active_flag_inconsistent"): "(SELECT count(*) FROM sku_raw WHERE active NOT IN ('Y', 'N', '1', '0'))",
    ("fact_sales_orders", "duplicate_order_id"): "(SELECT count(*) - count(DISTINCT order_id) FROM order_raw)",
    ("fact_shipments", "freight_cost_outlier"):
        "(SELECT count(*) FROM shipment_raw WHERE try_cast(freight AS DOUBLE) > 10000)",
    ("fact_shipments", "freight_cost_null"): "(SELECT count(*) FROM shipment_raw WHERE coalesce(freight, '') = '')",
    ("fact_inventory_snapshot", "negative_on_hand"): "(SELECT count(*) FROM snapshot_raw WHERE on_hand < 0)",
}
add(
    "quality_issues",
    lambda b: q.quality_issues(b.raw).drop("description", "resolution_method"),
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{i}' AS issue_type, {sub} AS records_affected" for (t, i), sub in _ISSUE_SQL.items()
    ),
)


def _summary_sql(table: str, system: str, source: str, ident: str, missing: str, invalid: str, other: str, good: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{system}' AS source_system, count(*) AS total_rows,"
        f" count(DISTINCT {ident}) AS unique_keys, count(*) - count(DISTINCT {ident}) AS duplicate_rows,"
        f" {missing} AS missing_required, {invalid} AS invalid_value, {other} AS other_issue,"
        f" {half_away(f'({good}) * 100', 'count(*)', 1)} AS quality_score_pct FROM {source}"
    )


_NO_FREIGHT = "count(*) FILTER (coalesce(freight, '') = '')"
_NO_CAPACITY = "count(*) FILTER (capacity_units = '')"
_OUTLIERS = (
    "(SELECT count(*) FROM ship_ready WHERE fc * 100 > (SELECT lo * 100 + (hi - lo) * part FROM"
    " (SELECT max(fc) FILTER (r = 99 * (n - 1) // 100) AS lo, max(fc) FILTER (r = (99 * (n - 1) + 99) // 100) AS hi,"
    " max(99 * (n - 1) % 100) AS part FROM (SELECT fc, row_number() OVER (ORDER BY fc) - 1 AS r, count(*) OVER () AS n"
    " FROM ship_ready WHERE fc IS NOT NULL))))"
)
add(
    "quality_summary",
    lambda b: q.quality_summary(b.raw),
    " UNION ALL ".join([
        _summary_sql("dim_sku_raw", "PLM", "sku_raw", "sku_id", "count(*) FILTER (coalesce(lead_time_days, '') = '')",
                     "count(*) FILTER (unit_cost_usd IN ('', 'abc'))",
                     "count(*) FILTER (sku_id <> upper(regexp_replace(sku_id, '[-_]', '', 'g')))", "count(DISTINCT sku_id)"),
        _summary_sql("dim_location_raw", "WMS", "location_raw", "location_id", _NO_CAPACITY, "0",
                     "count(*) FILTER (location_id LIKE 'DC-%')", f"count(*) - {_NO_CAPACITY}"),
        _summary_sql("fact_sales_orders_raw", "ERP", f"order_raw LEFT JOIN sku_segment ss ON {key('order_raw.sku_id')} = ss.sku_id",
                     "order_id", "count(*) FILTER (segment IS NULL)", f"count(*) FILTER ({number('quantity')} <= 0)",
                     "count(*) FILTER (segment NOT IN ('PREMIUM', 'STANDARD', 'BUDGET'))", "count(DISTINCT order_id)"),
        _summary_sql("fact_shipments_raw", "TMS", "shipment_raw", "shipment_id", _NO_FREIGHT,
                     "count(*) FILTER (arrival_date < ship_date)", _OUTLIERS, f"count(*) - {_NO_FREIGHT}"),
        _summary_sql("fact_inventory_snapshot_raw", "WMS", "snapshot_raw",
                     "(day_text || location_id || sku_id)",
                     "count(*) FILTER (on_hand < 0)", "0", "0", "count(*) - count(*) FILTER (on_hand < 0)"),
    ]),
)
add(
    "key_format_report", lambda b: q.key_format_report(b.raw["dim_sku_raw"]),
    f"""SELECT format_type, count, {half_away('count * 100', 'sum(count) OVER ()::BIGINT', 1)} AS pct_of_total
FROM (SELECT CASE WHEN starts_with(sku_id, 'SKU-') THEN 'Format: SKU-001'
    WHEN regexp_matches(sku_id, '^SKU[0-9]') THEN 'Format: SKU001' WHEN starts_with(sku_id, 'sku_') THEN 'Format: sku_001'
    WHEN regexp_matches(sku_id, '^[A-Z]{{3}}[0-9]') THEN 'Format: ABC001' ELSE 'Other format' END AS format_type, count(*) AS count FROM sku_raw GROUP BY 1)""",
)


def _cut(p: int) -> str:
    """Percentile p/100 in 1/100 cents."""
    return (
        f"max(fc) FILTER (r = {p} * (n - 1) // 100) * 100 + (max(fc) FILTER (r = ({p} * (n - 1) + 99) // 100)"
        f" - max(fc) FILTER (r = {p} * (n - 1) // 100)) * max({p} * (n - 1) % 100)"
    )


add(
    "outlier_profile", lambda b: q.outlier_profile(b.raw["fact_shipments_raw"]),
    "SELECT " + ", ".join(
        f"{half_away(f'p{p}', '10000', 2)} AS {name}"
        for p, name in ((25, "p25_freight"), (50, "p50_freight"), (75, "p75_freight"), (99, "p99_freight_cap"))
    ) + f", top / 100.0::DOUBLE AS max_freight_before_cap, {half_away('total', 'n * 100', 2)} AS mean_freight,"
    f" {half_away('top * 100', 'p99', 1)} AS max_to_p99_ratio FROM (SELECT "
    + ", ".join(f"{_cut(p)} AS p{p}" for p in (25, 50, 75, 99))
    + ", max(fc) AS top, sum(fc) AS total, count(*) AS n FROM (SELECT fc, row_number() OVER (ORDER BY fc) - 1 AS r,"
    " count(*) OVER () AS n FROM ship_ready WHERE fc IS NOT NULL))",
)
_SCORED = {"dim_sku_raw": ("sku_raw", "sku_id"), "dim_location_raw": ("location_raw", "location_id"),
           "fact_sales_orders_raw": ("order_raw", "order_id"), "fact_shipments_raw": ("shipment_raw", "shipment_id")}
add(
    "score_card", lambda b: q.score_card(b.raw),
    f"SELECT table_name, {half_away('u * 100', 't', 1)} AS quality_score_pct, CASE WHEN u * 100 >= t * 90 THEN '🟢 GOOD'"
    " WHEN u * 100 >= t * 75 THEN '🟡 NEEDS CLEANING' ELSE '🔴 POOR' END AS status FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(DISTINCT {c}) AS u, count(*) AS t FROM {src}" for name, (src, c) in _SCORED.items()
    ) + ")",
)
_FREIGHT_GIVEN = "(SELECT count(*) FROM shipment_raw WHERE coalesce(freight, '') <> '')"
_AUDIT_SQL = {
    "SKU standardization": (f"(SELECT count(DISTINCT {key('sku_id')}) FROM sku_raw)", "(SELECT count(*) FROM sku_raw)"),
    "Lead time imputation": ("(SELECT count(*) FROM sku)", "(SELECT count(*) FROM sku_raw WHERE lead_time_days <> '')"),
    "Order deduplication": ("(SELECT count(*) FROM sales)", "(SELECT count(*) FROM order_raw)"),
    "Freight outlier capping": ("(SELECT count(*) FROM shipment WHERE freight_cents > 0)", _FREIGHT_GIVEN),
    "Freight NULL imputation": ("(SELECT count(freight_cents) FROM shipment)", _FREIGHT_GIVEN),
    "Negative inventory correction": (
        "(SELECT count(*) FROM stock WHERE on_hand_qty = 0)", "(SELECT count(*) FROM snapshot_raw WHERE on_hand < 0)"),
}
add(
    "cleaning_audit", lambda b: q.cleaning_audit(b.raw, b.clean).drop("method"),
    " UNION ALL ".join(
        f"SELECT '{fix}' AS fix_applied, {after} AS records_after_clean, {before} AS records_before_clean"
        for fix, (after, before) in _AUDIT_SQL.items()
    ),
)


def _audit_sql() -> str:
    """Rule by rule over the raw-typed tables, which keep every row the clean ones do."""
    src = {"location": "dim_location", "sku": "dim_sku", "policy": "dim_service_policy", "lane": "dim_lane_cost",
           "sales": "fact_sales_orders", "shipment": "fact_shipments", "stock": "fact_inventory_snapshot"}
    pk = {"location": "location_id", "sku": "sku_id", "policy": "customer_segment", "lane": "lane_id", "sales": "order_id",
          "shipment": "shipment_id", "stock": "snapshot_date,location_id,sku_id"}
    fk = {"lane": {"from_location": "location.location_id", "to_location": "location.location_id"},
          "sales": {"sku_id": "sku.sku_id", "ship_to_location": "location.location_id"},
          "shipment": {"order_id": "sales.order_id", "from_location": "location.location_id",
                       "to_location": "location.location_id", "sku_id": "sku.sku_id"},
          "stock": {"location_id": "location.location_id", "sku_id": "sku.sku_id"}}
    parts = []
    for t, name in src.items():
        cols = pk[t]
        parts.append(f"SELECT '{name}' AS table_name, 'unique' AS rule, '{cols}' AS column_name,"
                     f" (SELECT count(*) - count(DISTINCT ({cols})) FROM {t}) AS violations")
        for col, ref in fk.get(t, {}).items():
            dim, dcol = ref.split(".")
            parts.append(f"SELECT '{name}', 'reference', '{col}', (SELECT count(*) FROM {t} WHERE {col} IS NOT NULL"
                         f" AND {col} NOT IN (SELECT {dcol} FROM {dim}))")
    return " UNION ALL ".join(parts)


add("constraint_keys", lambda b: audit_constraints(b.clean).filter(F.col("rule").isin("unique", "reference")), _audit_sql())

def _raw_rules(b: Bed) -> DataFrame:
    """The declared rules against orders and shipments before cleaning, where they do break."""
    orders = b.raw["fact_sales_orders_raw"].select(
        tx.clean_text("order_id").alias("order_id"), tx.to_date("order_date").alias("order_date"),
        tx.normalize_sku("sku_id").alias("sku_id"), "customer_id", F.col("location_id").alias("ship_to_location"),
        tx.to_int("quantity").alias("qty_ordered"), tx.to_dec("unit_price_usd", 10, 2).alias("price_per_unit"), "channel",
        F.lit(False).alias("priority_flag"))
    orders = orders.join(cl.sku_segments(b.raw["dim_sku_raw"]).withColumnRenamed("segment", "customer_segment"), "sku_id", "left")
    shipments = b.prepared.withColumns({
        "freight_cost_usd": tx.to_dec("freight_cost_usd", 38, 2), "on_time_flag": cl.on_time(), "damage_flag": F.lit(None).cast("boolean")})
    return audit_constraints(
        {"dim_location": b.locations, "dim_sku": b.skus, "fact_sales_orders": orders, "fact_shipments": shipments}
    ).filter(F.col("table_name").isin("fact_sales_orders", "fact_shipments")).filter("violations > 0")


_KNOWN_ORDER = "IN (SELECT trim(order_id) FROM order_raw)"
add(
    "constraint_audit", _raw_rules,
    f"""SELECT * FROM (
  SELECT 'fact_sales_orders' AS table_name, 'not_null' AS rule, 'qty_ordered' AS column_name, count(*) AS violations
    FROM order_raw WHERE quantity = ''
  UNION ALL SELECT 'fact_sales_orders', 'not_null', 'order_date', count(*) FROM order_raw WHERE order_date IS NULL
  UNION ALL SELECT 'fact_sales_orders', 'not_null', 'price_per_unit', count(*) FROM order_raw WHERE price_cents > {LONGEST_PRICE}
  UNION ALL SELECT 'fact_sales_orders', 'not_null', 'customer_segment', count(*) FROM order_raw
    WHERE {key('sku_id')} NOT IN (SELECT sku_id FROM sku_segment)
  UNION ALL SELECT 'fact_sales_orders', 'check', 'qty_ordered', count(*) FROM order_raw WHERE {whole('quantity')} <= 0
  UNION ALL SELECT 'fact_sales_orders', 'unique', 'order_id', count(*) - count(DISTINCT trim(order_id)) FROM order_raw
  UNION ALL SELECT 'fact_sales_orders', 'reference', 'sku_id', count(*) FROM order_raw WHERE {key('sku_id')} NOT IN (SELECT sku_id FROM sku)
  UNION ALL SELECT 'fact_sales_orders', 'reference', 'ship_to_location', count(*) FROM order_raw
    WHERE location_id NOT IN (SELECT location_id FROM location)
  UNION ALL SELECT 'fact_shipments', 'check', 'qty_shipped', count(*) FROM ship_ready WHERE qty < 0
  UNION ALL SELECT 'fact_shipments', 'unique', 'shipment_id', count(*) - count(DISTINCT shipment_id) FROM ship_ready
  UNION ALL SELECT 'fact_shipments', 'reference', 'order_id', count(*) FROM ship_ready WHERE order_id <> '' AND order_id NOT {_KNOWN_ORDER}
  UNION ALL SELECT 'fact_shipments', 'reference', 'sku_id', count(*) FROM ship_ready WHERE sku NOT IN (SELECT sku_id FROM sku)
  UNION ALL SELECT 'fact_shipments', 'reference', 'from_location', count(*) FROM ship_ready WHERE origin NOT IN (SELECT location_id FROM location)
  UNION ALL SELECT 'fact_shipments', 'reference', 'to_location', count(*) FROM ship_ready
    WHERE to_location NOT IN (SELECT location_id FROM location)) WHERE violations > 0""",
)


def _counts_sql(label: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {label}, (SELECT count(*) FROM {t}) AS row_count" for n, t in names.items())


_RAW_NAMES = {"dim_location_raw": "location_raw", "dim_sku_raw": "sku_raw", "dim_service_policy_raw": "policy_raw",
              "dim_lane_cost_raw": "lane_raw", "fact_sales_orders_raw": "order_raw", "fact_shipments_raw": "shipment_raw",
              "fact_inventory_snapshot_raw": "snapshot_raw"}
_CLEAN_NAMES = {"dim_location": "location", "dim_sku": "sku", "dim_service_policy": "policy", "dim_lane_cost": "lane",
                "fact_sales_orders": "sales", "fact_shipments": "shipment", "fact_inventory_snapshot": "stock"}
_MART_NAMES = {"mart_demand_stats": "demand", "mart_cost_to_serve": "served", "mart_network_flow": "flow",
               "mart_inventory_position": "(SELECT s.sku_id FROM stock_latest s LEFT JOIN demand d"
                                          " ON s.sku_id = d.sku_id AND s.location_id = d.location_id)",
               "mart_data_quality_report": "range(7)"}
add("row_counts", lambda b: row_counts(b.raw.load_all()).orderBy("table_name"), _counts_sql("table_name", _RAW_NAMES))
add("clean_row_counts", lambda b: row_counts(b.clean).orderBy("table_name"), _counts_sql("table_name", _CLEAN_NAMES))
add(
    "mart_summary",
    lambda b: m.mart_summary(m.build_marts(b.raw, b.clean)).drop("purpose"),
    _counts_sql("mart_name", _MART_NAMES),
)


def _pipeline_row_counts(b: Bed) -> DataFrame:
    """The raw tables written as extracts in load order, and every stage run on them.

    Orders and shipments are many: those of one id stand in the order they were sent, in one file, which
    is the order that counts, and need no sort of all their text.
    """
    root = store.stage_root(b.spark)
    b.raw.sent_lines()
    for name, schema in RAW_SCHEMAS.items():
        rows = b.raw[name] if name in adapter.LINE_FACTS else b.raw[name].orderBy("_ingest_seq")
        export_csv(rows.select(*schema.names), f"{root}/raw/{RAW_FILES[name]}", compression="gzip")
    stored = run_pipeline(b.spark, f"{root}/raw", f"{root}/out")
    return stored.withColumn("digest", F.when(~F.col("table_name").endswith("_raw"), F.col("digest")))


def _digest(table: str, schema: T.StructType, sql: str) -> str:
    """Row count and digest of a statement's rows, by the columns and types of the stored table."""
    def text(f: T.StructField) -> str:
        if isinstance(f.dataType, T.DecimalType):
            return f"round({f.name} * {10 ** f.dataType.scale})::HUGEINT::VARCHAR"
        return f"{f.name}::VARCHAR" if not isinstance(f.dataType, T.IntegralType) else f"{f.name}::BIGINT::VARCHAR"

    row = " || '|' || ".join(f"coalesce('=' || {text(f)}, '-')" for f in sorted(schema.fields, key=lambda f: f.name))
    return (
        f"SELECT '{table}' AS table_name, count(*) AS row_count, coalesce(sum(('0x' || md5({row})[1:12])::BIGINT), 0)::VARCHAR AS digest"
        f" FROM ({sql})"
    )


_STORED_SERVED = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("customer_segment", "ship_to_region", "sku_id")],
    *[T.StructField(c, T.LongType()) for c in ("num_orders", "total_units_ordered")],
    *[T.StructField(c, T.DecimalType(21, 2)) for c in (
        "total_revenue", "total_product_cost", "total_freight_cost", "total_warehouse_cost", "total_carrying_cost", "total_stockout_cost",
        "total_processing_cost", "total_cost", "gross_margin", "margin_pct")],
    *[T.StructField(c, T.DecimalType(21, 4)) for c in ("cost_per_unit", "revenue_per_unit")],
])
_REJECTED = T.StructType([T.StructField(c, T.StringType()) for c in ("table_name", "column_name", "key")])
_CLEAN_QUERIES = {"dim_location": "clean_locations", "dim_sku": "clean_skus", "dim_service_policy": "clean_policy", "dim_lane_cost": "clean_lanes",
                  "fact_sales_orders": "clean_orders", "fact_shipments": "clean_shipments", "fact_inventory_snapshot": "clean_inventory"}


def _pipeline_sql() -> str:
    """Raw extracts and marts with floating columns are counted; every other stored table is compared whole."""
    counted = {**_RAW_NAMES, **{n: t for n, t in _MART_NAMES.items() if n != "mart_cost_to_serve"}, "opt_inventory_policy": "sim_base"}
    parts = [f"SELECT *, NULL::VARCHAR AS digest FROM ({_counts_sql('table_name', counted)})"]
    parts += [_digest(name, CLEAN_SCHEMAS[name], REGISTRY[query].sql) for name, query in _CLEAN_QUERIES.items()]
    parts.append(_digest("mart_cost_to_serve", _STORED_SERVED, REGISTRY["cost_to_serve"].sql))
    parts.append(_digest("rejected_rows", _REJECTED, "SELECT table_name, column_name, key FROM rejected"))
    return " UNION ALL ".join(parts)


add("pipeline_row_counts", _pipeline_row_counts, _pipeline_sql())

# --- policy and scenario ----------------------------------------------------------

add("lead_times", lambda b: pol.assign_lead_time(b.flow), "SELECT sku_id, location_id, days AS avg_lead_time FROM lead")
add("lead_times_lane", lambda b: rounded(b.measured, 6, "avg_lead_time"),
    "SELECT sku_id, location_id, round(days, 6) AS avg_lead_time FROM measured")
add("simulate_policy", lambda b: b.simulated, "SELECT * FROM simulated")
_WHAT_IF = (
    "sku_id, location_id, avg_demand, std_demand, lead_time, safety_stock, calc_safety_stock, reorder_point,"
    " calc_reorder_point, holding_cost_total, risk_cost, total_cost, recommendation"
)
add("scenario", lambda b: b.what_if, "SELECT * FROM what_if")
add("scenario_one_sku", lambda b: sc.scenario(b.simulated, level=99, holding=3.5, stockout=25.0, sku="SKU007"),
    "SELECT * FROM what_if_99")
add("policy_comparison", lambda b: sc.policy_comparison(b.what_if), f"SELECT {_WHAT_IF} FROM what_if")
add("high_risk", lambda b: sc.high_risk(b.what_if),
    "SELECT sku_id, location_id, avg_demand, calc_safety_stock, calc_reorder_point, recommendation FROM what_if"
    " WHERE calc_safety_stock > avg_demand")
add("high_risk_85", lambda b: sc.high_risk(sc.scenario(b.simulated, level=85)),
    "SELECT sku_id, location_id, avg_demand, calc_safety_stock, calc_reorder_point, recommendation FROM what_if_85"
    " WHERE calc_safety_stock > avg_demand")
add("scenario_one_location", lambda b: sc.scenario(b.simulated, location="LOC-07"), "SELECT * FROM what_if_place")
add("top_cost", lambda b: sc.top_cost(b.what_if),
    "SELECT sku_id, location_id, calc_safety_stock, holding_cost_total, risk_cost, total_cost, recommendation FROM what_if"
    " ORDER BY total_cost DESC, sku_id, location_id LIMIT 5")


def _exact(col: str) -> str:
    return f"sum(round({col} * 100)::BIGINT)"


add(
    "scenario_kpis", lambda b: sc.scenario_kpis(b.what_if),
    f"SELECT count(DISTINCT sku_id) AS filtered_skus,"
    f" round_even({_exact('calc_safety_stock')}::DOUBLE / 100 / count(*) * 100, 0) / 100 AS avg_safety_stock,"
    f" round_even({_exact('calc_reorder_point')}::DOUBLE / 100 / count(*) * 100, 0) / 100 AS avg_reorder_point,"
    f" {_exact('total_cost')}::DOUBLE / 100 AS total_cost, count(*) FILTER (calc_safety_stock > avg_demand) AS high_risk_rows"
    " FROM what_if",
)
add(
    "scenario_by_sku", lambda b: sc.scenario_by_sku(b.what_if),
    f"SELECT sku_id, {_exact('calc_safety_stock')}::DOUBLE / 100 / count(*) AS avg_safety_stock,"
    f" {_exact('total_cost')}::DOUBLE / 100 AS total_cost FROM what_if GROUP BY 1",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(name, build):
        return lambda spark, sf_dir: portable(build(Bed(spark, sf_dir, stored_lines=name in SEVERAL_READS)))

    return {name: runner(name, query.build) for name, query in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in REGISTRY.items() if query.sql}
