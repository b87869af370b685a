"""The clean layer over hand-written rows with one defect each."""

import datetime as dt
from decimal import Decimal

import pytest

import fixtures
from tidestock.operators.audit import audit_constraints
from tidestock.plans import clean as cl
from tidestock.schemas import CLEAN_SCHEMAS, RAW_SCHEMAS
from tidestock.sources import tables


@pytest.fixture(scope="module")
def raw(spark):
    return fixtures.raw_tables(spark)


@pytest.fixture(scope="module")
def clean(raw):
    return {name: df.cache() for name, df in cl.clean_all(raw).items()}


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_layouts(clean):
    for name, df in clean.items():
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in CLEAN_SCHEMAS[name].fields]


def test_locations(clean):
    got = by(clean["dim_location"], "location_id")
    assert set(got) == {"LOC-A", "LOC-B", "LOC-C"}
    assert (got["LOC-B"].location_type, got["LOC-B"].echelon, got["LOC-B"].capacity_units) == ("RDC", 2, None)
    assert (got["LOC-C"].location_name, got["LOC-C"].fixed_operating_cost) == ("Gamma Store", Decimal("2.00"))


def test_skus(clean):
    got = by(clean["dim_sku"], "sku_id")
    assert set(got) == {"SKU001", "SKU002", "SKU003", "SKU004"}
    # Category mean of 33 and 20 is 26.5, rounded away from zero.
    assert (got["SKU001"].description, got["SKU001"].unit_cost, got["SKU001"].lead_time_days) == ("Valve II", Decimal("12.00"), 27)
    assert (got["SKU002"].lead_time_days, got["SKU002"].active, got["SKU002"].category) == (27, True, "PACKAGING")
    # Only the row without a cost has a lead time in its category; it still feeds the mean.
    assert (got["SKU003"].lead_time_days, got["SKU003"].reorder_point, got["SKU003"].active) == (5, 34, True)
    assert (got["SKU004"].reorder_point, got["SKU004"].active) == (-3, False)


def test_policy(clean):
    got = by(clean["dim_service_policy"], "customer_segment")
    assert set(got) == {"PREMIUM", "STANDARD", "BUDGET"}
    assert (got["PREMIUM"].target_fill_rate, got["PREMIUM"].priority_rank) == (Decimal("0.9950"), 1)
    assert (got["BUDGET"].max_backorder_days, got["BUDGET"].holding_cost_rate) == (11, None)


def test_lanes(clean, spark):
    got = by(clean["dim_lane_cost"], "lane_id")
    assert {k: v.transport_mode for k, v in got.items()} == {"L1": "TRUCK", "L2": "RAIL", "L3": "TRUCK", "L4": "TRUCK"}
    assert got["L3"].from_location == "LOC-B" and got["L3"].distance_miles is None
    best = {(r.from_location, r.to_location): r.transport_mode for r in cl.best_lane(clean["dim_lane_cost"]).collect()}
    assert best == {("LOC-A", "LOC-B"): "RAIL", ("LOC-B", "LOC-C"): "TRUCK"}


def test_orders(clean):
    got = by(clean["fact_sales_orders"], "order_id")
    assert set(got) == {"O1", "O2", "O3", "O9"}
    # The cancelled re-send is dropped before the last row is picked.
    assert (got["O1"].qty_ordered, got["O1"].customer_segment) == (12, "PREMIUM")
    assert (got["O2"].qty_ordered, got["O9"].price_per_unit) == (5, Decimal("9.99"))
    assert got["O3"].priority_flag is False and got["O3"].order_date == dt.date(2024, 1, 2)


def test_orders_with_own_segment(raw, clean):
    from pyspark.sql import functions as F

    sent = raw["fact_sales_orders_raw"].withColumn("customer_segment", F.lit(" gold")).withColumn("priority_flag", F.lit("yes"))
    got = by(cl.clean_orders(sent, raw["dim_sku_raw"], clean["dim_sku"], clean["dim_location"], "order"), "order_id")
    assert set(got) == {"O1", "O2", "O3", "O4", "O6", "O7", "O8", "O9"}
    assert got["O1"].customer_segment == "GOLD" and got["O1"].priority_flag is True
    assert got["O8"].qty_ordered is None


def test_shipments(clean):
    got = by(clean["fact_shipments"], "shipment_id")
    assert set(got) == {"S1", "S2", "S3", "S4", "S5"}
    # Truck freights 100, 200, 300 and 9900 count, though three of those rows are dropped or replaced.
    cap = Decimal("300") + Decimal("0.97") * Decimal("9600")
    mean = ((Decimal(600) + cap) / 4).quantize(Decimal("0.01"))
    assert (got["S1"].freight_cost_usd, got["S2"].freight_cost_usd) == (Decimal("100.00"), mean)
    assert (got["S3"].freight_cost_usd, got["S3"].transport_mode) == (Decimal("50.00"), "RAIL")
    assert (got["S5"].freight_cost_usd, got["S5"].transport_mode) == (None, None)
    assert (got["S3"].delivery_date, got["S4"].order_id, got["S5"].order_id, got["S3"].order_id) == (None, None, None, "O3")
    flags = {k: v.on_time_flag for k, v in got.items()}
    assert flags == {"S1": True, "S2": False, "S3": False, "S4": None, "S5": None}


def test_inventory(clean):
    got = {(str(r.snapshot_date), r.location_id, r.sku_id): r for r in clean["fact_inventory_snapshot"].collect()}
    assert set(got) == {("2024-02-01", "LOC-C", "SKU001"), ("2024-02-02", "LOC-C", "SKU001"), ("2024-02-02", "LOC-B", "SKU002")}
    last = got[("2024-02-02", "LOC-C", "SKU001")]
    assert (last.on_hand_qty, last.on_order_qty, last.backorder_qty) == (30, 0, 0)
    assert got[("2024-02-01", "LOC-C", "SKU001")].on_hand_qty == 0
    assert got[("2024-02-02", "LOC-B", "SKU002")].on_hand_qty == 0


def test_clean_layer_keeps_its_promises(clean):
    assert audit_constraints(clean).filter("violations > 0").count() == 0


def _raw(spark, name, *lines):
    schema = RAW_SCHEMAS[name]
    data = [(*line, i) for i, line in enumerate(lines)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in schema.names) + ", _ingest_seq int")


def test_rows_that_lose_a_required_figure_are_rejected(spark):
    sku = lambda k, cost: (k, "Valve", "Pipes", cost, "5", "S", "1", "", "1", "1", "BUDGET", "Y")
    raw = _raw(spark, "dim_sku_raw", sku("A1", "10"), sku("a-1", "abc"), sku("B", "123456789012"), sku("C", "0"), sku("D", "2.345"))
    assert {r.sku_id: float(r.unit_cost) for r in cl.clean_skus(raw).collect()} == {"A1": 10.0, "D": 2.35}
    assert sorted((r.table_name, r.column_name, r.key) for r in cl.rejects(cl.judge_skus(raw), "dim_sku").collect()) == [
        ("dim_sku", "unit_cost", k) for k in ("A1", "B", "C")]

    skus = cl.clean_skus(raw)
    places = _raw(spark, "dim_location_raw", ("L", "n", "c", "s", "DC", "r", "1", "1"))
    places = cl.clean_locations(places)
    order = lambda k, day, qty, price: (k, day, "C", "A1", "L", qty, price, "OK", "web", "")
    orders = _raw(spark, "fact_sales_orders_raw", order("1", "2024-01-01", "1", "5"), order("1", "soon", "9", "5"), order("2", "2024-01-01", "0.4", "5"),
                  order("3", "2024-01-01", "2", "123456789012"), order("4", "", "2", "5"))
    kept = cl.clean_orders(orders, raw, skus, places).collect()
    assert [(r.order_id, r.qty_ordered) for r in kept] == [("1", 1)]
    lost = cl.rejects(cl.judge_orders(orders, raw, skus, places), "fact_sales_orders").collect()
    assert sorted((r.column_name, r.key) for r in lost) == [("order_date", "1"), ("order_date", "4"), ("price_per_unit", "3"), ("qty_ordered", "2")]

    snap = lambda day, qty: ("S", day, "L", "A1", qty, "", "", "", "", "")
    stock = _raw(spark, "fact_inventory_snapshot_raw", snap("2024-01-01", "1"), snap("bad", "2"), snap("worse", "3"), snap("", "4"))
    assert [r.on_hand_qty for r in cl.clean_inventory(stock, places, skus).collect()] == [1]
    assert cl.rejects(cl.judge_inventory(stock, places, skus), "fact_inventory_snapshot").count() == 2


def test_good_and_rejected_rows_come_from_one_stored_pass(spark, tmp_path):
    """Both read the judged rows, each only its own part, and neither reads the raw table again."""
    line = lambda k, day, qty: ("S", day, "L", f"A{k}", str(qty), "", "", "", "", "")
    raw = _raw(spark, "fact_inventory_snapshot_raw", *[line(k % 3, "bad" if k % 5 == 0 else f"2024-01-{k % 9 + 1:02d}", k) for k in range(40)])
    raw = tables.stage(raw, str(tmp_path), "raw")
    sku = lambda k: (f"A{k}", "V", "P", "10", "5", "S", "1", "", "1", "1", "BUDGET", "Y")
    skus = cl.clean_skus(_raw(spark, "dim_sku_raw", sku(0), sku(1)))
    places = cl.clean_locations(_raw(spark, "dim_location_raw", ("L", "n", "c", "s", "DC", "r", "1", "1")))
    judged = tables.stage(cl.judge_inventory(raw, places, skus), str(tmp_path), "judged", by=cl.FAULT)
    good, bad = cl.accepted(judged, "fact_inventory_snapshot"), cl.rejects(judged, "fact_inventory_snapshot")
    assert good.collect() and sorted(map(tuple, good.collect())) == sorted(map(tuple, cl.clean_inventory(raw, places, skus).collect()))
    assert bad.count() == sum(k % 3 != 2 for k in range(0, 40, 5))
    parts = {"good": good, "bad": bad}
    plans = {n: df.select("*")._jdf.queryExecution().executedPlan().toString() for n, df in parts.items()}
    assert all("/judged/" in f for df in parts.values() for f in df.inputFiles()) and all(p.count("FileScan") == 1 for p in plans.values())
    assert "PartitionFilters: [isnull(_fault" in plans["good"] and "PartitionFilters: [isnotnull(_fault" in plans["bad"]


def test_the_last_policy_of_a_segment_wins(spark):
    line = lambda segment, fill, z: (segment, fill, "98", "2", z, "1", "7", "0.25", "85", "n")
    raw = _raw(spark, "dim_service_policy_raw", line("premium", "99", "2.0"), line(" PREMIUM", "98", "2.5"), line("PREMIUM", "bad", "3"))
    assert [(r.customer_segment, float(r.z_score)) for r in cl.clean_policy(raw).collect()] == [("PREMIUM", 2.5)]
