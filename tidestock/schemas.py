"""Table layouts and the rules the clean layer promises to keep."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T


def _text(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names.split()])


# Raw layer: every field is nullable text, in file order.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "dim_location_raw": _text(
        "location_id location_name city state location_type region capacity_units operating_cost_per_day"
    ),
    "dim_sku_raw": _text(
        "sku_id sku_name category unit_cost_usd lead_time_days supplier_id unit_weight_lbs"
        " shelf_life_days reorder_point min_order_qty segment active"
    ),
    "dim_service_policy_raw": _text(
        "segment target_fill_rate_pct target_cycle_service_lvl max_lead_time_days"
        " safety_stock_multiplier review_period_days order_up_to_days carrying_cost_rate_annual"
        " stockout_penalty_per_unit notes"
    ),
    "dim_lane_cost_raw": _text(
        "lane_id origin_location_id dest_location_id distance_miles transit_days"
        " cost_per_unit_usd cost_per_lb_usd carrier_mode contract_type"
    ),
    "fact_sales_orders_raw": _text(
        "order_id order_date customer_id sku_id location_id quantity unit_price_usd"
        " order_status channel promised_delivery_date"
    ),
    "fact_shipments_raw": _text(
        "shipment_id order_id origin_loc_id dest_loc_id sku_id quantity_shipped ship_date"
        " arrival_date freight_cost_usd carrier shipment_status weight_lbs pallet_count"
    ),
    "fact_inventory_snapshot_raw": _text(
        "snapshot_id snapshot_date location_id sku_id on_hand_qty on_order_qty reserved_qty"
        " available_qty snapshot_source days_of_supply"
    ),
}

# Raw layer of the earlier extract layout; `tidestock.sources.legacy` reads it.
LEGACY_RAW_SCHEMAS: dict[str, T.StructType] = {
    "dim_location_raw": _text(
        "location_id location_name location_type region echelon capacity_units"
        " storage_cost_per_unit fixed_operating_cost"
    ),
    "dim_sku_raw": _text(
        "sku_id description category subcategory unit_cost unit_volume_cuft unit_weight_lbs"
        " supplier_id lead_time_days reorder_point active last_updated"
    ),
    "dim_service_policy_raw": _text(
        "customer_segment target_fill_rate z_score penalty_stockout_per_unit priority_rank"
        " max_backorder_days expedite_threshold review_period_days holding_cost_rate min_order_qty"
    ),
    "dim_lane_cost_raw": _text(
        "lane_id from_location to_location transport_mode distance_miles transit_days_mean"
        " transit_days_std cost_per_unit cost_per_lb"
    ),
    "fact_sales_orders_raw": _text(
        "order_id order_date sku_id customer_id ship_to_location customer_segment qty_ordered"
        " price_per_unit channel priority_flag"
    ),
    "fact_shipments_raw": _text(
        "shipment_id order_id ship_date delivery_date from_location to_location sku_id qty_shipped"
        " transport_mode freight_cost_usd carrier on_time_flag damage_flag"
    ),
    "fact_inventory_snapshot_raw": _text(
        "snapshot_date location_id sku_id on_hand_qty on_order_qty backorder_qty safety_stock_qty"
        " reorder_point_qty last_receipt_date last_issue_date"
    ),
}

RAW_FILES: dict[str, str] = {
    "dim_location_raw": "locations.csv",
    "dim_sku_raw": "sku_master.csv",
    "dim_service_policy_raw": "service_policy.csv",
    "dim_lane_cost_raw": "lane_costs.csv",
    "fact_sales_orders_raw": "sales_orders.csv",
    "fact_shipments_raw": "shipments.csv",
    "fact_inventory_snapshot_raw": "inventory_snapshots.csv",
}


@dataclass(frozen=True)
class TableSpec:
    """Layout of one clean table with its key, row checks and references."""

    schema: T.StructType
    key: tuple[str, ...]
    checks: Mapping[str, str] = field(default_factory=dict)
    refs: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    lengths: Mapping[str, int] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


_PLAIN = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(),
}


def _layout(text: str) -> T.StructType:
    """Fields as 'name:type', with '!' after a required one and 'p.s' for a decimal."""
    fields = []
    for item in text.split():
        name, kind = item.rstrip("!").split(":")
        known = _PLAIN.get(kind) or T.DecimalType(*map(int, kind.split(".")))
        fields.append(T.StructField(name, known, not item.endswith("!")))
    return T.StructType(fields)


def _spec(layout: str, key: str, **rules) -> TableSpec:
    return TableSpec(_layout(layout), tuple(key.split()), **rules)


_LOCATION = ("dim_location", "location_id")
_SKU = ("dim_sku", "sku_id")

CLEAN_TABLES: dict[str, TableSpec] = {
    "dim_location": _spec(
        "location_id:string! location_name:string! location_type:string!"
        " region:string! echelon:int! capacity_units:int"
        " storage_cost_per_unit:10.4 fixed_operating_cost:12.2",
        "location_id",
        checks={
            "location_type": "location_type in ('DC', 'RDC', 'STORE')",
            "echelon": "echelon between 1 and 3",
        },
        lengths={"location_id": 50, "location_name": 100, "location_type": 20, "region": 50},
    ),
    "dim_sku": _spec(
        "sku_id:string! description:string! category:string!"
        " subcategory:string unit_cost:10.2! unit_volume_cuft:10.4"
        " unit_weight_lbs:10.4 supplier_id:string lead_time_days:int!"
        " reorder_point:int active:boolean! last_updated:date",
        "sku_id",
        checks={"unit_cost": "unit_cost > 0"},
        lengths={"sku_id": 50, "description": 200, "category": 50, "subcategory": 50, "supplier_id": 50},
        defaults={"active": True},
    ),
    "dim_service_policy": _spec(
        "customer_segment:string! target_fill_rate:6.4!"
        " z_score:6.4! penalty_stockout_per_unit:10.2!"
        " priority_rank:int! max_backorder_days:int expedite_threshold:int"
        " review_period_days:int holding_cost_rate:6.4 min_order_qty:int",
        "customer_segment",
        checks={
            "customer_segment": "customer_segment in ('PREMIUM', 'STANDARD', 'BUDGET')",
            "target_fill_rate": "target_fill_rate between 0 and 1",
            "z_score": "z_score > 0",
            "priority_rank": "priority_rank between 1 and 3",
        },
        lengths={"customer_segment": 20},
    ),
    "dim_lane_cost": _spec(
        "lane_id:string! from_location:string! to_location:string!"
        " transport_mode:string! distance_miles:8.2"
        " transit_days_mean:5.2! transit_days_std:5.2"
        " cost_per_unit:10.4! cost_per_lb:10.4",
        "lane_id",
        checks={
            "transport_mode": "transport_mode in ('TRUCK', 'AIR', 'RAIL')",
            "transit_days_mean": "transit_days_mean > 0",
            "cost_per_unit": "cost_per_unit >= 0",
        },
        refs={"from_location": _LOCATION, "to_location": _LOCATION},
        lengths={"lane_id": 50, "from_location": 50, "to_location": 50, "transport_mode": 20},
    ),
    "fact_sales_orders": _spec(
        "order_id:string! order_date:date! sku_id:string!"
        " customer_id:string ship_to_location:string customer_segment:string!"
        " qty_ordered:int! price_per_unit:10.2! channel:string"
        " priority_flag:boolean",
        "order_id",
        checks={
            "customer_segment": "customer_segment in ('PREMIUM', 'STANDARD', 'BUDGET')",
            "qty_ordered": "qty_ordered > 0",
            "price_per_unit": "price_per_unit > 0",
        },
        refs={"sku_id": _SKU, "ship_to_location": _LOCATION},
        lengths={
            "order_id": 50, "sku_id": 50, "customer_id": 50, "ship_to_location": 50,
            "customer_segment": 20, "channel": 30,
        },
        defaults={"priority_flag": False},
    ),
    "fact_shipments": _spec(
        "shipment_id:string! order_id:string ship_date:date delivery_date:date"
        " from_location:string to_location:string sku_id:string qty_shipped:int"
        " transport_mode:string freight_cost_usd:10.2 carrier:string"
        " on_time_flag:boolean damage_flag:boolean",
        "shipment_id",
        checks={
            "qty_shipped": "qty_shipped >= 0",
            "transport_mode": "transport_mode in ('TRUCK', 'AIR', 'RAIL')",
            "freight_cost_usd": "freight_cost_usd >= 0",
        },
        refs={
            "order_id": ("fact_sales_orders", "order_id"),
            "from_location": _LOCATION, "to_location": _LOCATION, "sku_id": _SKU,
        },
        lengths={
            "shipment_id": 50, "order_id": 50, "from_location": 50, "to_location": 50,
            "sku_id": 50, "transport_mode": 20, "carrier": 50,
        },
    ),
    "fact_inventory_snapshot": _spec(
        "snapshot_date:date! location_id:string! sku_id:string!"
        " on_hand_qty:int! on_order_qty:int backorder_qty:int safety_stock_qty:int"
        " reorder_point_qty:int last_receipt_date:date last_issue_date:date",
        "snapshot_date location_id sku_id",
        checks={
            "on_hand_qty": "on_hand_qty >= 0",
            "on_order_qty": "on_order_qty >= 0",
            "backorder_qty": "backorder_qty >= 0",
            "safety_stock_qty": "safety_stock_qty >= 0",
        },
        refs={"location_id": _LOCATION, "sku_id": _SKU},
        lengths={"location_id": 50, "sku_id": 50},
        defaults={"on_order_qty": 0, "backorder_qty": 0},
    ),
}

CLEAN_SCHEMAS: dict[str, T.StructType] = {name: spec.schema for name, spec in CLEAN_TABLES.items()}

POLICY_SCHEMA = _layout(
    "sku_id:string location_id:string avg_demand:double std_demand:double"
    " lead_time:int reorder_point:double safety_stock:double"
)
