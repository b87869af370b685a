"""Raw extracts derived from the test tables.

Every raw table is a row-wise projection of the given tables (with equi-joins for
lookups): its row count follows theirs. The rules plant the defects the cleaning
layer repairs: mixed key spellings, blanks, garbage, re-sent rows, unknown keys,
inverted dates, outliers. `oracle.py` states the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import read_once


class Source(dict):
    """The given tables by name, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self[name]


def _s(e: Column | str) -> Column:
    return (F.col(e) if isinstance(e, str) else e).cast("string")


def _mod(name: str, n: int) -> Column:
    return F.col(name) % n


def _div(name: str, n: int) -> Column:
    return F.floor(F.col(name) / n).cast("long")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def _money(cents: Column) -> Column:
    """Whole cents as '12.34'."""
    return F.concat(_s(F.floor(cents / 100).cast("long")), F.lit("."), F.lpad(_s(cents % 100), 2, "0"))


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sku(spelling: Column, number: Column) -> Column:
    return F.concat(_pick(spelling, "SKU-", "SKU", "sku_", "Sku-", "SKU "), F.lpad(_s(number), 3, "0"))


def _loc(number: Column) -> Column:
    return F.concat(F.lit("LOC-"), F.lpad(_s(number), 2, "0"))


def sku_raw(src: Source) -> DataFrame:
    k, number = F.col("p_partkey"), _mod("p_partkey", 40)
    size = F.concat(_s("p_size"), F.lit(".0"))
    segment = F.when(number % 5 == 0, "PREMIUM").when(number % 5 == 4, "BUDGET").otherwise("STANDARD")
    return src["part"].select(
        F.when(k % 43 == 11, F.concat(F.lit("ABC"), F.lpad(_s(number), 3, "0")))
        .otherwise(_sku(_div("p_partkey", 40) % 5, number)).alias("sku_id"),
        F.col("p_name").alias("sku_name"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_type")).alias("category"),
        F.when(k % 50 == 7, "").when(k % 50 == 8, "abc").when(k % 50 == 9, "123456789012")
        .otherwise(_money(_cents("p_retailprice"))).alias("unit_cost_usd"),
        F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, "").when(k % 64 == 2, "n/a").otherwise(size)
        .alias("lead_time_days"),
        F.concat(F.lit("SUP"), F.lpad(_s(k % 25), 3, "0")).alias("supplier_id"),
        F.when(k % 9 == 0, "").otherwise(F.concat(_s("p_size"), F.lit(".5"))).alias("unit_weight_lbs"),
        F.lit(None).cast("string").alias("shelf_life_days"),
        F.concat(_s(k * 7 % 500), F.lit(".5")).alias("reorder_point"),
        _s(k % 50).alias("min_order_qty"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 2 == 1, F.lower(segment)).otherwise(segment).alias("segment"),
        _pick(k % 6, "Y", "YES", "y", "1", "true", "N").alias("active"),
        k.alias("_ingest_seq"),
    )


def location_raw(src: Source) -> DataFrame:
    nation = src["nation"].join(
        src["region"], F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = src["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    kind = F.when(n < 6, "DC").when(n < 16, "RDC").when(n < 24, "STORE").otherwise("HUB")
    return rows.select(
        F.when(k % 47 == 13, F.concat(F.lit("DC-"), _s(n))).when(k % 3 == 0, F.concat(F.lit(" "), _loc(n))).otherwise(_loc(n))
        .alias("location_id"),
        F.concat("n_name", F.lit(" hub ")).alias("location_name"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("S"), _s(n)).alias("state"),
        F.when(k % 2 == 0, F.concat(F.lower(kind), F.lit(" "))).otherwise(kind).alias("location_type"),
        F.col("r_name").alias("region"),
        F.when(k % 7 == 0, "").otherwise(_s((k * 13 % 900) * 1000)).alias("capacity_units"),
        F.concat(_s(k * 37 % 5000), F.lit(".25")).alias("operating_cost_per_day"),
        k.alias("_ingest_seq"),
    )


def policy_raw(src: Source) -> DataFrame:
    """A row per customer class and version that occur; the last class is no known segment, the last version wins.

    The third version of a class states a fill rate that does not read and is rejected.
    """
    kinds = src["customer"].select(_mod("c_custkey", 4).alias("k"), (_div("c_custkey", 4) % 3).alias("v")).distinct()
    k, v = F.col("k"), F.col("v")
    # Policy parameters per segment.
    return kinds.select(
        _pick(k, " premium", "Standard", "BUDGET ", "trial").alias("segment"),
        F.when(v == 2, "high").otherwise(_pick(k, "99.5", "97.0", "92.0", "50.0")).alias("target_fill_rate_pct"),
        _pick(k, "98.0", "95.0", "90.0", "50.0").alias("target_cycle_service_lvl"),
        _pick(k, "2", "5", "10", "30").alias("max_lead_time_days"),
        _pick(k, "2.33", "1.65", "1.28", "0.5").alias("safety_stock_multiplier"),
        _s(_pick(k, "1", "7", "14", "30").cast("long") + 1 - v).alias("review_period_days"),
        _pick(k, "7", "21", "45", "60").alias("order_up_to_days"),
        _pick(k, "0.25", "0.2", "0.18", "0.1").alias("carrying_cost_rate_annual"),
        _pick(k, "85.0", "35.0", "12.0", "1.0").alias("stockout_penalty_per_unit"),
        F.lit(None).cast("string").alias("notes"),
        (v * 4 + k).alias("_ingest_seq"),
    )


def lane_raw(src: Source) -> DataFrame:
    """Up to two lanes per location pair, each sent as often as customers point at it."""
    k, s, d = F.col("c_custkey"), _mod("c_custkey", 25), F.col("c_nationkey")
    second = _div("c_custkey", 25) % 2
    return src["customer"].select(
        F.concat(F.lit("LANE-"), _s(s), F.lit("-"), _s(d), F.lit("-"), _s(second)).alias("lane_id"),
        F.concat(_loc(s), F.lit(" ")).alias("origin_location_id"),
        _loc(d).alias("dest_location_id"),
        _s((s * 97 + d * 31) % 2500 + 50).alias("distance_miles"),
        F.when(k % 31 == 5, "fast").otherwise(_s((s + d + second) % 4 + 1)).alias("transit_days"),
        F.concat(_s((s * 7 + d * 3 + second * 11) % 20 + 1), F.lit("."), F.lpad(_s(k % 10000), 4, "0"))
        .alias("cost_per_unit_usd"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("0."), F.lpad(_s(k % 1000), 3, "0"))).alias("cost_per_lb_usd"),
        _pick((s + d + second) % 5, "TL", "ltl", "Parcel", "INTERMODAL", "Air").alias("carrier_mode"),
        _pick(k % 2, "Spot", "Dedicated").alias("contract_type"),
        k.alias("_ingest_seq"),
    )


#: Raw facts that are derived from the order lines row by row.
LINE_FACTS = ("fact_sales_orders_raw", "fact_shipments_raw")

#: The order of lines that share an order and a number, and so an id in the raw facts.
SENT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _seq(lines: DataFrame) -> Column:
    """A total order over rows that share an id; the position is the last resort, as in a file scan.

    As with a scan, the position also keeps later filters from being merged into the
    text expressions, which would build each text once per use. Stored lines carry the number of
    their transmission, which takes the place of five columns in every later shuffle.
    """
    if SENT in lines.columns:
        return read_once(F.col(SENT))
    return F.struct(*SENT_ORDER, F.monotonically_increasing_id().alias("position"))


#: What the raw facts take from the lines, and the name under which `RawLayer` keeps them stored.
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
                "o_orderstatus", "o_orderdate", "o_orderpriority", "c_custkey", "c_nationkey"]
LINES, SENT, SUPPLIERS = "order_lines", "sent", "suppliers"


def _lines(src: Source) -> DataFrame:
    """Order lines with their order and customer; orders meet customers first, as they are fewer than lines."""
    if LINES in src:
        return src[LINES]
    orders = src["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = src["customer"].select("c_custkey", "c_nationkey")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return src["lineitem"].join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(*LINE_COLUMNS)


def _order_key() -> Column:
    return F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"))


def order_raw(src: Source) -> DataFrame:
    qty, cents = F.col("l_quantity").cast("long"), _cents("l_extendedprice")
    price = F.floor((cents * 2 + qty) / (qty * 2)).cast("long")
    lines = _lines(src)
    return lines.select(
        F.when(_mod("l_partkey", 17) == 0, F.concat(F.lit(" "), _order_key())).otherwise(_order_key()).alias("order_id"),
        F.when(_mod("l_partkey", 59) == 0, "soon").otherwise(_s(F.col("o_orderdate").cast("date"))).alias("order_date"),
        F.concat(F.lit("C"), _s("c_custkey")).alias("customer_id"),
        _sku(_mod("l_suppkey", 5), _mod("l_partkey", 42)).alias("sku_id"),
        _loc(F.col("c_nationkey")).alias("location_id"),
        F.when(_mod("l_suppkey", 29) == 0, "0").when(_mod("l_partkey", 53) == 0, "")
        .when(_mod("l_partkey", 61) == 0, "0.4").otherwise(_s("l_quantity")).alias("quantity"),
        F.when(_mod("l_partkey", 67) == 0, "123456789012.00").otherwise(_money(price)).alias("unit_price_usd"),
        F.when((F.col("l_returnflag") == "R") & (F.col("o_orderstatus") == "O"), " cancelled")
        .when((F.col("l_returnflag") == "N") & (F.col("o_orderstatus") == "F"), F.lit(None))
        .otherwise("SHIPPED").alias("order_status"),
        F.col("o_orderpriority").alias("channel"),
        _s(F.date_add(F.col("o_orderdate").cast("date"), 7)).alias("promised_delivery_date"),
        _seq(lines).alias("_ingest_seq"),
    )


def shipment_raw(src: Source) -> DataFrame:
    supplier = src["supplier"].select("s_suppkey", "s_nationkey")
    rows = _lines(src)
    if SUPPLIERS in rows.columns:
        rows = rows.select("*", F.inline(SUPPLIERS))
    else:
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    freight = F.floor(_cents("l_extendedprice") * 3 / 100).cast("long")
    ship = F.col("l_shipdate").cast("date")
    return rows.select(
        F.concat(F.lit("SH"), _order_key(), F.lit("-"), _s(_mod("l_suppkey", 3))).alias("shipment_id"),
        F.when(_mod("l_orderkey", 97) == 0, "").otherwise(_order_key()).alias("order_id"),
        _loc(F.col("s_nationkey")).alias("origin_loc_id"),
        F.concat(F.lit(" "), _loc(F.col("c_nationkey"))).alias("dest_loc_id"),
        _sku(_mod("l_suppkey", 5), _mod("l_partkey", 42)).alias("sku_id"),
        F.when(_mod("l_suppkey", 41) == 0, "")
        .otherwise(_s(F.col("l_quantity") - _mod("l_orderkey", 3))).alias("quantity_shipped"),
        _s(ship).alias("ship_date"),
        F.when(_mod("l_partkey", 19) == 0, "")
        .otherwise(_s(F.date_add(ship, (_mod("l_partkey", 9) - 1).cast("int")))).alias("arrival_date"),
        F.when(_mod("l_partkey", 13) == 0, F.lit(None)).when(_mod("l_partkey", 101) == 0, "N/A")
        .when(_mod("l_orderkey", 307) == 0, "200000000000000")
        .when(_mod("l_orderkey", 211) == 0, _money(freight * 100)).otherwise(_money(freight))
        .alias("freight_cost_usd"),
        F.concat(F.lit("CR"), _s(_mod("l_suppkey", 7))).alias("carrier"),
        F.when(_mod("l_orderkey", 5) == 0, "delayed").otherwise("DELIVERED").alias("shipment_status"),
        _s(F.col("l_quantity") * 2).alias("weight_lbs"),
        _s(F.lit(1)).alias("pallet_count"),
        _seq(rows).alias("_ingest_seq"),
    )


def snapshot_raw(src: Source) -> DataFrame:
    k = F.col("event_id")
    on_hand = F.floor("value").cast("long") - 20
    return src["events"].select(
        F.concat(F.lit("SNAP-"), _s(k)).alias("snapshot_id"),
        F.when(k % 211 == 0, "").when(k % 223 == 0, "yesterday").otherwise(_s(F.col("ts").cast("date"))).alias("snapshot_date"),
        _loc(_mod("user_id", 25)).alias("location_id"),
        _sku(k % 5, _div("event_id", 3) % 42).alias("sku_id"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(_s(on_hand)).alias("on_hand_qty"),
        F.when(k % 13 == 0, "").otherwise(_s(k % 100)).alias("on_order_qty"),
        _s(k % 10).alias("reserved_qty"),
        _s(on_hand - k % 10).alias("available_qty"),
        F.col("event_type").alias("snapshot_source"),
        F.lit(None).cast("string").alias("days_of_supply"),
        k.alias("_ingest_seq"),
    )


RAW_TABLES = {
    "dim_location_raw": location_raw,
    "dim_sku_raw": sku_raw,
    "dim_service_policy_raw": policy_raw,
    "dim_lane_cost_raw": lane_raw,
    "fact_sales_orders_raw": order_raw,
    "fact_shipments_raw": shipment_raw,
    "fact_inventory_snapshot_raw": snapshot_raw,
}


class RawLayer(dict):
    """The raw tables by name, each derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.given = Source(spark, sf_dir)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = RAW_TABLES[name](self.given)
        return self[name]

    def keep_lines(self, stored: Callable[[DataFrame, str], DataFrame]) -> None:
        """Join the order lines once, for queries that read the raw facts more than once; `stored` keeps a table under a name.

        Lines that share an id are numbered in the order they were sent, by the key they were joined on.
        """
        alike = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*SENT_ORDER)
        self.given[LINES] = stored(_lines(self.given).withColumn(SENT, F.row_number().over(alike)), LINES)

    def sent_lines(self) -> None:
        """Lines with their suppliers, those that share an id in one task and in the order they were sent.

        What is derived from them row by row keeps both, so the facts can be written as extracts without
        another shuffle. Suppliers come along as a list, as a later join might deal the lines out anew.
        """
        suppliers = self.given["supplier"].groupBy("s_suppkey").agg(F.collect_list(F.struct("s_nationkey")).alias(SUPPLIERS))
        alike = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*SENT_ORDER)
        lines = _lines(self.given).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(*LINE_COLUMNS, SUPPLIERS)
        numbered = lines.withColumn(SENT, F.row_number().over(alike))
        self.given[LINES] = numbered.sortWithinPartitions("l_orderkey", "l_linenumber", SENT)

    def load_all(self) -> RawLayer:
        for name in RAW_TABLES:
            self[name]
        return self
