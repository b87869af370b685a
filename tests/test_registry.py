"""The registry against the SQL oracle on the smallest data, and the driver contract."""

import importlib.util
import os

import duckdb
import pytest
from pyspark.sql import Window

from conftest import TESTDATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(path):
    spec = importlib.util.spec_from_file_location(os.path.basename(path)[:-3], path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def check():
    return load(os.path.join(ROOT, "tools", "check_oracle.py"))


@pytest.fixture(scope="module")
def con(check):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "clean_skus", "clean_orders", "demand_stats_min5", "freight_stats", "network_flow", "cost_to_serve",
    "quality_summary", "inventory_position", "constraint_audit", "csv_round_trip", "rejected_rows", "lead_times_lane",
])
def test_query_agrees_with_sql(spark, check, con, name):
    problem, n, _, _ = check.compare(spark, con, name, TESTDATA)
    assert not problem and n > 0


def test_contract(spark):
    entry = load(os.path.join(ROOT, "__spark_entry__.py"))
    from tidestock.testbed import registry

    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "safety_stock_units" in df.columns


def test_facts_join_dimensions_without_shuffling_first(spark, check):
    """The order rows meet stored dimensions in map-side joins; the first exchange is the one by order id."""
    from tidestock.testbed.registry import Bed

    plan = Bed(spark, TESTDATA).orders._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(order_id" in line]
    assert len(exchanges) == 1
    assert not any("Exchange hashpartitioning(ship_to_location" in line for line in plan.splitlines())
    assert "row_number(), 1, Partial" in plan


def test_stored_lines_give_the_same_rows_and_are_joined_once(spark, tmp_path):
    """Lines sent again under one id keep their order; the raw facts are scans of the stored lines."""
    from pyspark.sql import functions as F
    from tidestock.testbed.registry import SEVERAL_READS, Bed

    days = [f"2024-01-0{d} 00:00:00" for d in (3, 1, 2)]
    lines = [(o, o % 3, 1, n, float(q), 10.0 * q + i, "N", day) for o in range(1, 30) for n in (1, 2) for i, (q, day) in enumerate(zip((5, 6, 7), days))]
    tables = {
        "lineitem": spark.createDataFrame(lines + lines[:40], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                                          " l_extendedprice double, l_returnflag string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")),
        "orders": spark.createDataFrame([(o, o % 4, "F", o) for o in range(2, 30)], "o_orderkey long, o_custkey long, o_orderstatus string, o int")
                       .select("o_orderkey", "o_custkey", "o_orderstatus", F.to_timestamp(F.lit("2024-01-01")).alias("o_orderdate"), F.lit("1-HIGH").alias("o_orderpriority")),
        "customer": spark.createDataFrame([(c, 7) for c in range(4)], "c_custkey long, c_nationkey long"),
        "supplier": spark.createDataFrame([(1, 7)], "s_suppkey long, s_nationkey long"),
    }
    for name, df in tables.items():
        df.repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    plain, stored = Bed(spark, str(tmp_path)), Bed(spark, str(tmp_path), stored_lines=True)
    for fact, key in (("fact_sales_orders_raw", "order_id"), ("fact_shipments_raw", "shipment_id")):
        rows = []
        for bed in (plain, stored):
            raw = bed.raw[fact]
            place = F.row_number().over(Window.partitionBy(key).orderBy("_ingest_seq"))
            rows.append(sorted(map(str, raw.withColumn("_ingest_seq", place).collect())))
        assert rows[0] == rows[1] and len(rows[0]) > 150
        assert "Join" not in stored.raw["fact_sales_orders_raw"]._jdf.queryExecution().executedPlan().toString()
    assert {"clean_shipments", "mart_summary", "quality_summary"} <= SEVERAL_READS


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_extracts_of_lines_need_no_sort_of_their_text(spark, tmp_path, threshold):
    """Lines of one id are written in the order they were sent, by the shuffle that joins them; suppliers may repeat."""
    from pyspark.sql import functions as F
    from tidestock.schemas import RAW_SCHEMAS
    from tidestock.sources.csv import export_csv, read_raw
    from tidestock.testbed.adapter import LINE_FACTS
    from tidestock.testbed.registry import Bed

    days = [f"2024-01-{d:02d} 00:00:00" for d in (9, 1, 5, 7)]
    lines = [(o, o % 3 + 1, 1 + o % 5, n, float(q), 10.0 * q + i, "N", day) for i, (q, day) in enumerate(zip((5, 6, 7, 8), days)) for o in range(1, 60) for n in (1, 2)]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                                          " l_extendedprice double, l_returnflag string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")),
        "orders": spark.createDataFrame([(o, o % 4, "F", o) for o in range(2, 60)], "o_orderkey long, o_custkey long, o_orderstatus string, o int")
                       .select("o_orderkey", "o_custkey", "o_orderstatus", F.to_timestamp(F.lit("2024-01-01")).alias("o_orderdate"), F.lit("1-HIGH").alias("o_orderpriority")),
        "customer": spark.createDataFrame([(c, 7) for c in range(4)], "c_custkey long, c_nationkey long"),
        "supplier": spark.createDataFrame([(1, 7), (2, None), (2, 3), (3, 4), (3, 4), (None, 5)], "s_suppkey long, s_nationkey long"),
    }
    for name, df in tables.items():
        df.repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    plain, sent = Bed(spark, str(tmp_path)), Bed(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        sent.raw.sent_lines()
        for fact, key, day in zip(LINE_FACTS, ("order_id", "shipment_id"), ("quantity", "ship_date")):
            names = RAW_SCHEMAS[fact].names
            made = sent.raw[fact].select(*names)
            assert "rangepartitioning" not in made._jdf.queryExecution().executedPlan().toString()
            export_csv(made, f"{tmp_path}/{fact}", compression="gzip")
            read = read_raw(spark, f"{tmp_path}/{fact}", RAW_SCHEMAS[fact])
            got = [(r[key], r[day]) for r in read.orderBy("_ingest_seq").collect()]
            want = [(r[key], r[day]) for r in plain.raw[fact].orderBy("_ingest_seq").collect()]
            order = lambda rows: sorted((k, [d for i, d in rows if i == k]) for k in {i for i, _ in rows})
            assert order(got) == order(want) and len(got) > 250
            bare = lambda df: sorted(str(r) for r in df.select(*[F.expr(f"nullif(trim({n}), '')").alias(n) for n in names]).collect())
            assert bare(read) == bare(plain.raw[fact])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_freight_statistics_are_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes uncompiled; raw freight text is built once a row, not once a use."""
    import re

    from tidestock.plans.clean import freight_stats
    from tidestock.testbed.registry import Bed

    bed = Bed(spark, TESTDATA, stored_lines=True)
    stats = freight_stats(bed.raw["fact_shipments_raw"], bed.lanes)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stats.select("*")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 5 and max(sizes) < 8000
    assert "RLIKE(CASE" not in plan.toString()
