import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures
from tidestock.operators.audit import apply_defaults
from tidestock.plans import clean as cl
from tidestock.plans import marts as m
from tidestock.plans import quality as q
from tidestock.schemas import CLEAN_TABLES


@pytest.fixture(scope="module")
def raw(spark):
    return fixtures.raw_tables(spark)


@pytest.fixture(scope="module")
def clean(raw):
    return {name: df.cache() for name, df in cl.clean_all(raw).items()}


def cents(value):
    return Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP)


def orders_of(rows, *lines):
    df = rows("order_id string, d string, sku_id string, ship_to_location string, customer_segment string, qty_ordered int, p string",
              *lines)
    return df.withColumns({"order_date": F.to_date("d"), "price_per_unit": F.col("p").cast("decimal(10,2)")})


def test_demand_stats(rows, clean):
    lines = [(f"A{i}", f"2024-01-{i + 1:02d}", "SKU001", "LOC-C", "PREMIUM", qty, "2.00") for i, qty in enumerate([4, 6, 9])]
    lines += [("B", "2024-01-03", "SKU001", "LOC-C", "PREMIUM", 3, "3.00"), ("C", "2024-01-03", "SKU002", "LOC-C", "STANDARD", 3, "3.00"),
              ("D", "2024-01-03", "SKU001", None, "PREMIUM", 99, "3.00")]
    orders = orders_of(rows, *lines)
    day = {str(r.order_date): r for r in m.daily_demand(orders).filter("sku_id = 'SKU001'").collect()}
    assert (day["2024-01-03"].total_qty_ordered, day["2024-01-03"].num_orders) == (12, 2)
    assert day["2024-01-03"].avg_price_per_unit == Decimal("2.500000")
    got = {r.sku_id: r for r in m.demand_stats(orders, clean["dim_sku"], clean["dim_service_policy"], 1).collect()}
    r, totals = got["SKU001"], [4, 6, 12]
    sd, mean = np.std(totals, ddof=1), np.mean(totals)
    assert (r.observation_days, r.max_demand_per_day, r.min_demand_per_day) == (3, 12, 4)
    assert r.std_demand_per_day == pytest.approx(sd) and r.p90_demand == pytest.approx(np.percentile(totals, 90))
    assert r.safety_stock_units == np.rint(2.33 * sd * np.sqrt(27))
    assert r.reorder_point_units == np.rint(mean * 27 + 2.33 * sd * np.sqrt(27))
    assert r.annual_demand_estimate == 2677.0
    # One observed day: no spread, so no buffer.
    assert (got["SKU002"].std_demand_per_day, got["SKU002"].safety_stock_units) == (0.0, 0.0)
    assert m.demand_stats(orders, clean["dim_sku"], clean["dim_service_policy"], 3).count() == 1
    bare = m.demand_stats(orders, clean["dim_sku"], clean["dim_service_policy"], 1, nulls_as_zero=False)
    assert [(r.std_demand_per_day, r.safety_stock_units) for r in bare.filter("sku_id = 'SKU002'").collect()] == [(None, 0.0)]
    week = m.with_calendar(m.daily_demand(orders)).filter("order_date = '2024-01-03'").first()
    assert (str(week.week_start), str(week.month_start)) == ("2024-01-01", "2024-01-01")


def test_inventory_position(rows, clean):
    demand = rows("sku_id string, location_id string, avg_demand_per_day double, safety_stock_units double, reorder_point_units double",
                  ("SKU001", "LOC-C", 4.0, 50.0, 120.0))
    mart = m.inventory_position(clean["fact_inventory_snapshot"], clean["dim_location"], clean["dim_sku"], demand, True)
    got = {r.sku_id: r for r in mart.collect()}
    r = got["SKU001"]
    assert (str(r.as_of_date), r.inventory_position, r.stock_status, r.service_level_status) == ("2024-02-02", 30, "UNDERSTOCKED", "RISK")
    assert (r.days_of_supply, r.inventory_value_usd, r.safety_stock_gap_usd) == (8.0, Decimal("360.00"), 600.0)
    other = got["SKU002"]
    assert (other.avg_demand_per_day, other.days_of_supply, other.stock_status, other.service_level_status) == (None, None, "NORMAL", "RISK")
    # Two segments for the pair repeat the snapshot.
    twice = demand.unionByName(demand)
    assert m.inventory_position(clean["fact_inventory_snapshot"], clean["dim_location"], clean["dim_sku"], twice).count() == 3


def test_order_costs_repeat_per_shipment(clean):
    args = (clean["fact_sales_orders"], clean["dim_sku"], clean["dim_service_policy"], clean["fact_shipments"], clean["dim_location"])
    lines = m.order_costs(*args).collect()
    assert Counter(r.order_id for r in lines) == {"O1": 2, "O2": 1, "O3": 1, "O9": 1}
    first = {r.stockout_cost: r for r in lines if r.order_id == "O1"}
    assert set(first) == {Decimal("595.0000"), Decimal("255.0000")} or {float(v) for v in first} == {595.0, 255.0}
    assert {float(r.stockout_cost) for r in lines if r.order_id == "O2"} == {0.0}
    assert {r.fulfilled_from_type for r in lines if r.order_id == "O2"} == {None}


def test_cost_to_serve_equals_its_order_lines(spark, rows, clean):
    """The pre-summed mart against a plain sum over the fanned-out lines, with one hot order."""
    rng = random.Random(7)
    lines = [(f"O{i}", "2024-01-01", f"SKU00{rng.randint(1, 4)}", rng.choice(["LOC-A", "LOC-B", "LOC-C"]),
              rng.choice(["PREMIUM", "STANDARD", "BUDGET"]), rng.randint(1, 40), f"{rng.randint(100, 9999) / 100:.2f}") for i in range(120)]
    orders = orders_of(rows, *lines)
    sent = [(f"S{i}", "O0" if i < 70 else f"O{rng.randint(0, 80)}", rng.randint(0, 50), rng.choice([None, f"{rng.randint(1, 99999) / 100:.2f}"]))
            for i in range(200)] + [("S999", None, 5, "1.00")]
    ships = rows("shipment_id string, order_id string, qty_shipped int, f string", *sent).select(
        "*", F.col("f").cast("decimal(10,2)").alias("freight_cost_usd"), F.lit("LOC-A").alias("from_location"))
    args = (orders, clean["dim_sku"], clean["dim_service_policy"], ships, clean["dim_location"])
    sku = {r.sku_id: r for r in clean["dim_sku"].collect()}
    expected = {}
    for r in m.order_costs(*args).collect():
        e = expected.setdefault((r.customer_segment, r.ship_to_region, r.sku_id), {"orders": set(), "units": 0, "rev": 0, "cost": 0})
        e["orders"].add(r.order_id)
        e["units"] += r.qty_ordered
        e["rev"] += r.order_revenue
        carrying = sku[r.sku_id].unit_cost * sku[r.sku_id].lead_time_days * r.qty_ordered * Decimal("0.25") / 365
        assert abs(r.carrying_cost - carrying) <= Decimal("0.0000005")
        e["cost"] += r.product_cost + r.freight_cost + r.warehouse_handling_cost + carrying + r.stockout_cost + r.order_processing_cost
    got = m.cost_to_serve(*args).collect()
    assert len(got) == len(expected)
    for r in got:
        e = expected[(r.customer_segment, r.ship_to_region, r.sku_id)]
        assert (r.num_orders, r.total_units_ordered, r.total_revenue) == (len(e["orders"]), e["units"], cents(e["rev"]))
        assert (r.total_cost, r.gross_margin) == (cents(e["cost"]), cents(e["rev"] - e["cost"]))
        assert float(r.cost_per_unit) == pytest.approx(float(e["cost"] / e["units"]), abs=5.1e-5)
        assert float(r.margin_pct) == pytest.approx(float((e["rev"] - e["cost"]) / e["rev"] * 100), abs=5.1e-3)


def test_network_flow_equals_fanned_out_rows(spark, rows, clean):
    """Lane multiplicity as a factor against rows repeated per lane."""
    rng = random.Random(3)
    data = []
    for i in range(300):
        start = rng.randint(1, 20)
        data.append((f"S{i}", rng.choice(["LOC-A", "LOC-B"]), rng.choice(["LOC-B", "LOC-C"]), rng.choice(["TRUCK", "RAIL", None]), f"SKU00{rng.randint(1, 2)}",
                     rng.randint(0, 9), rng.choice([None, f"{rng.randint(1, 99999) / 100:.2f}"]), f"2024-01-{start:02d}",
                     rng.choice([None, f"2024-01-{start + rng.randint(0, 8):02d}"]), rng.choice([True, False, None])))
    ships = rows("shipment_id string, from_location string, to_location string, transport_mode string, sku_id string, qty_shipped int, f string,"
                 " a string, b string, on_time_flag boolean", *data).select(
        "*", F.col("f").cast("decimal(10,2)").alias("freight_cost_usd"), F.to_date("a").alias("ship_date"), F.to_date("b").alias("delivery_date"))
    # Two lanes at one price and one at another for the same pair and mode.
    lanes = rows("lane_id string, from_location string, to_location string, transport_mode string, c string",
                 ("1", "LOC-B", "LOC-C", "TRUCK", "1.5"), ("2", "LOC-B", "LOC-C", "TRUCK", "1.5"), ("3", "LOC-B", "LOC-C", "TRUCK", "2.25"),
                 ("4", "LOC-A", "LOC-B", "RAIL", "3")).withColumn("cost_per_unit", F.col("c").cast("decimal(10,4)"))
    fanned = ships.join(lanes.select("from_location", "to_location", "transport_mode", "cost_per_unit"),
                        ["from_location", "to_location", "transport_mode"], "left")
    keys = ["from_location", "to_location", "transport_mode", "sku_id", "cost_per_unit"]
    days = F.datediff("delivery_date", "ship_date")
    expected = {tuple(r[k] for k in keys): r for r in fanned.groupBy(*keys).agg(
        F.count_distinct("shipment_id").alias("n"), F.sum("qty_shipped").alias("u"), F.sum("freight_cost_usd").alias("f"),
        F.avg(days).alias("mean"), F.stddev_samp(days).alias("sd"),
        F.avg(F.when(F.col("on_time_flag"), 1.0).otherwise(0.0)).alias("ot")).collect()}
    got = m.network_flow(ships, clean["dim_location"], clean["dim_sku"], lanes).collect()
    assert len(got) == len(expected)
    for r in got:
        e = expected[(r.from_location, r.to_location, r.transport_mode, r.sku_id, r.contracted_cost_per_unit)]
        assert (r.num_shipments, r.total_units_shipped, r.total_freight_cost) == (e.n, e.u, e.f)
        assert float(r.on_time_pct) == pytest.approx(e.ot * 100, abs=5.1e-3)
        for mine, theirs, tol in ((r.avg_actual_lead_time_days, e["mean"], 5.1e-3), (r.std_actual_lead_time_days, e.sd, 5.1e-5)):
            assert (mine is None) == (theirs is None)
            assert mine is None or float(mine) == pytest.approx(theirs, abs=tol)


def test_reports(raw, clean):
    issues = {r.issue_type: r.records_affected for r in q.quality_issues(raw).collect()}
    assert issues == {"sku_id_format": 5, "lead_time_null": 2, "active_flag_inconsistent": 2, "duplicate_order_id": 1,
                      "freight_cost_outlier": 0, "freight_cost_null": 1, "negative_on_hand": 1}
    assert "run_timestamp" in q.quality_issues(raw, with_timestamp=True).columns
    summary = {r.table_name: r for r in q.quality_summary(raw).collect()}
    assert (summary["dim_sku_raw"].missing_required, summary["dim_sku_raw"].invalid_value) == (2, 1)
    orders = summary["fact_sales_orders_raw"]
    # The unknown product has no segment; SKU004 carries an unknown one.
    assert (orders.total_rows, orders.unique_keys, orders.missing_required, orders.invalid_value, orders.other_issue) == (12, 11, 1, 1, 1)
    ships = summary["fact_shipments_raw"]
    assert (ships.missing_required, ships.invalid_value, ships.other_issue, float(ships.quality_score_pct)) == (1, 1, 1, 87.5)
    assert summary["fact_inventory_snapshot_raw"].missing_required == 1
    formats = {r.format_type: (r["count"], float(r.pct_of_total)) for r in q.key_format_report(raw["dim_sku_raw"]).collect()}
    assert formats == {"Format: SKU-001": (1, 14.3), "Format: sku_001": (1, 14.3), "Format: SKU001": (2, 28.6), "Other format": (3, 42.9)}
    profile = q.outlier_profile(raw["fact_shipments_raw"]).first()
    values = [50, 100, 200, 300, 9900]
    assert float(profile.p50_freight) == 200 and float(profile.p99_freight_cap) == pytest.approx(np.percentile(values, 99))
    assert float(profile.mean_freight) == np.mean(values) and float(profile.max_freight_before_cap) == 9900
    card = [(r.table_name, r.status.split(" ", 1)[1]) for r in q.score_card(raw).collect()]
    assert card == [("dim_location_raw", "NEEDS CLEANING"), ("fact_shipments_raw", "NEEDS CLEANING"),
                    ("fact_sales_orders_raw", "GOOD"), ("dim_sku_raw", "GOOD")]
    audit = {r.fix_applied: (r.records_after_clean, r.records_before_clean) for r in q.cleaning_audit(raw, clean).collect()}
    assert audit["Order deduplication"] == (4, 12) and audit["Negative inventory correction"] == (2, 1)
    assert audit["Freight NULL imputation"] == (4, 7) and audit["SKU standardization"][1] == 7
    assert set(m.build_marts(raw, clean, 1)) == set(m.MART_PURPOSE)
    assert apply_defaults(clean["dim_sku"], CLEAN_TABLES["dim_sku"]).filter("active is null").count() == 0
