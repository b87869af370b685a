"""Raw extracts to policy and scenario tables, one stored layer at a time.

Each layer is written before the next one reads it. Later joins then plan with the
stored sizes of the dimensions, and a lost executor costs a re-read of the last
layer, not a replay of the whole chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.audit import table_digests
from ..sources import tables as store
from ..sources.csv import export_csv, read_raw_layer
from ..sources.legacy import read_legacy_layer
from . import clean as cl
from .marts import MIN_OBSERVATION_DAYS, build_marts, demand_stats
from .policy import assign_lead_time, simulate_policy
from .scenario import scenario


def run_pipeline(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    min_obs: int = MIN_OBSERVATION_DAYS,
    sims: int = 2000,
    seed: int = 42,
    segment_source: str = "sku",
    lead_time: str = "hash",
    tasks: int | None = None,
    layout: str = "current",
    multi_line: bool = False,
) -> DataFrame:
    """Run every stage and return the row count and digest of each stored table.

    layout "earlier" reads the earlier extract layout and follows its rules for shipments and
    stock (taken as sent); segment_source "order" takes orders
    as sent; lead_time "lane" takes measured lead times; tasks spreads the simulation.
    """
    raw_root, clean_root, mart_root = (f"{out_dir}/{layer}" for layer in ("raw", "clean", "marts"))

    def keep(writer, df: DataFrame, root: str, name: str) -> DataFrame:
        writer(df, root, name)
        return store.read_table(spark, root, name)

    earlier = layout == "earlier"
    scanned = read_legacy_layer(spark, raw_dir, multi_line) if earlier else read_raw_layer(spark, raw_dir, multi_line=multi_line)
    raw = {n: keep(store.overwrite_table, df, raw_root, n) for n, df in scanned.items()}

    def cleaned(name: str, df: DataFrame) -> DataFrame:
        return keep(store.write_clean, df, clean_root, name)

    loc = cleaned("dim_location", cl.clean_locations(raw["dim_location_raw"]))
    judged_root, judged = store.stage_root(spark), {}

    def picked(name: str, rows: DataFrame, last_only: bool = True) -> DataFrame:
        """Judged rows are stored once, good ones apart from those at fault, which the list of rejects reads later."""
        judged[name] = store.stage(rows, judged_root, name, by=cl.FAULT, codec=store.CODEC)
        return cleaned(name, cl.accepted(judged[name], name, last_only))

    sku = picked("dim_sku", cl.judge_skus(raw["dim_sku_raw"]))
    policy = picked("dim_service_policy", cl.judge_policy(raw["dim_service_policy_raw"]))
    lanes = picked("dim_lane_cost", cl.judge_lanes(raw["dim_lane_cost_raw"], loc))
    orders = picked(
        "fact_sales_orders", cl.judge_orders(raw["fact_sales_orders_raw"], raw["dim_sku_raw"], sku, loc, segment_source)
    )
    freight = keep(store.overwrite_table, cl.freight_stats(raw["fact_shipments_raw"], lanes), clean_root, "freight_stats")
    ships = cleaned("fact_shipments", cl.clean_shipments(raw["fact_shipments_raw"], lanes, loc, sku, orders, freight, as_sent=earlier))
    stock = picked("fact_inventory_snapshot", cl.judge_inventory(raw["fact_inventory_snapshot_raw"], loc, sku), last_only=not earlier)
    clean = {
        "dim_location": loc, "dim_sku": sku, "dim_service_policy": policy, "dim_lane_cost": lanes,
        "fact_sales_orders": orders, "fact_shipments": ships, "fact_inventory_snapshot": stock,
    }

    rejected = keep(store.overwrite_table, cl.rejected_rows(judged), clean_root, "rejected_rows")

    # The demand mart is read by the inventory mart and the simulation, so it is stored first.
    demand = keep(store.write_mart, demand_stats(orders, sku, policy, min_obs), mart_root, "mart_demand_stats")
    marts = {"mart_demand_stats": demand} | {
        n: keep(store.write_mart, df, mart_root, n)
        for n, df in build_marts(raw, clean, min_obs, demand).items() if n != "mart_demand_stats"
    }
    lead = assign_lead_time(marts["mart_network_flow"], mode=lead_time, seed=seed, shipments=ships)
    simulated = simulate_policy(demand, lead, sims=sims, seed=seed, tasks=tasks)
    store.write_policy(simulated, mart_root)
    chosen = store.read_table(spark, mart_root, store.POLICY_TABLE)
    export_csv(scenario(chosen), f"{out_dir}/scenario")
    stored = {**raw, **clean, **marts, "rejected_rows": rejected, store.POLICY_TABLE: chosen}
    return table_digests(stored).orderBy("table_name")
