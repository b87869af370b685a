"""Raw-layer quality reports and the before/after cleaning audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import (
    count_date_inversion, count_like, count_missing, count_negative, count_nonstandard,
    count_not_in, count_not_positive, count_over, count_present,
)
from ..functions.numeric import ratio
from ..functions.text import (
    SEGMENTS, is_numeric, normalize_sku, score_band, sku_format, to_dec,
)
from ..operators.audit import union_reports
from ..operators.quantiles import percentiles_from_counts, value_counts
from .clean import sku_segments

# Thresholds and vocabularies of the reports.
FREIGHT_OUTLIER = 10000
STANDARD_FLAGS = ("Y", "N", "1", "0")
OLD_LOCATION_PATTERN = "DC-%"
SOURCE_SYSTEM = {
    "dim_sku_raw": "PLM",
    "dim_location_raw": "WMS",
    "fact_sales_orders_raw": "ERP",
    "fact_shipments_raw": "TMS",
    "fact_inventory_snapshot_raw": "WMS",
}

# What each issue means and how the clean layer resolves it.
ISSUE_NOTES = {
    "sku_id_format": ("product keys spelled with separators or lower case", "one upper-case spelling"),
    "lead_time_null": ("products without a lead time", "rounded mean of the category"),
    "active_flag_inconsistent": ("active flags outside Y, N, 1, 0", "mapped to true or false"),
    "duplicate_order_id": ("order ids sent more than once", "last valid transmission kept"),
    "freight_cost_outlier": ("freight above the plausible limit", "capped at the mode's 99th percentile"),
    "freight_cost_null": ("shipments without freight", "mean of the mode after capping"),
    "negative_on_hand": ("snapshots with negative stock", "floored at zero"),
}


def _count_rows(df: DataFrame, table: str, issues: dict[str, Column]) -> DataFrame:
    """One scan of `df`: a row per issue with its count, description and resolution."""
    counted = df.agg(*[agg.alias(name) for name, agg in issues.items()])
    rows = F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(name).alias("issue_type"),
            F.col(name).alias("records_affected"),
            F.lit(ISSUE_NOTES[name][0]).alias("description"),
            F.lit(ISSUE_NOTES[name][1]).alias("resolution_method"),
        )
        for name in issues
    ])
    return counted.select(F.inline(rows))


def quality_issues(raw: dict[str, DataFrame], with_timestamp: bool = False) -> DataFrame:
    """The audit trail: seven known issues with the number of raw rows they touch."""
    report = union_reports(
        _count_rows(raw["dim_sku_raw"], "dim_sku", {
            "sku_id_format": count_nonstandard("sku_id"),
            "lead_time_null": count_missing("lead_time_days"),
            "active_flag_inconsistent": count_not_in("active", STANDARD_FLAGS),
        }),
        _count_rows(raw["fact_sales_orders_raw"], "fact_sales_orders", {
            "duplicate_order_id": F.count(F.lit(1)) - F.count_distinct("order_id"),
        }),
        _count_rows(raw["fact_shipments_raw"], "fact_shipments", {
            "freight_cost_outlier": count_over("freight_cost_usd", FREIGHT_OUTLIER),
            "freight_cost_null": count_missing("freight_cost_usd"),
        }),
        _count_rows(raw["fact_inventory_snapshot_raw"], "fact_inventory_snapshot", {
            "negative_on_hand": count_negative("on_hand_qty"),
        }),
    )
    return report.withColumn("run_timestamp", F.current_timestamp()) if with_timestamp else report


def _summary(
    df: DataFrame, table: str, key: Column, missing: Column, invalid: Column, other: Column, score: str = "good"
) -> DataFrame:
    """Counts of one raw table. `score` names what is rated: unique keys, or rows without a fault."""
    rows = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(key).alias("unique_keys"),
        missing.alias("missing_required"),
        invalid.alias("invalid_value"),
        other.alias("other_issue"),
    )
    good = {
        "unique": F.col("unique_keys"),
        "complete": F.col("total_rows") - F.col("missing_required"),
        "valid": F.col("total_rows") - F.col("invalid_value"),
    }[score]
    return rows.select(
        F.lit(table).alias("table_name"), F.lit(SOURCE_SYSTEM[table]).alias("source_system"),
        "total_rows", "unique_keys", (F.col("total_rows") - F.col("unique_keys")).alias("duplicate_rows"),
        "missing_required", "invalid_value", "other_issue",
        ratio(good * 100, F.col("total_rows"), 1).alias("quality_score_pct"),
    )


def _order_segments(orders: DataFrame, raw_skus: DataFrame) -> DataFrame:
    """(rows, segment) of raw orders, from the order itself or else the product master.

    Orders are counted per product before the lookup, so it joins counts, not rows.
    """
    if "customer_segment" in orders.columns:
        return orders.groupBy(F.col("customer_segment").alias("segment")).agg(F.count(F.lit(1)).alias("rows"))
    per_sku = orders.groupBy(normalize_sku("sku_id").alias("sku_id")).agg(F.count(F.lit(1)).alias("rows"))
    return per_sku.join(sku_segments(raw_skus), "sku_id", "left").select("rows", "segment")


def freight_outliers(shipments: DataFrame, p: float = 0.99) -> DataFrame:
    """One row: how many readable freights lie above the overall percentile."""
    counts = value_counts(shipments, [], _freight())
    limit = percentiles_from_counts(counts, [], {"limit": p}, few_groups=True, with_above=True)
    return limit.select(F.coalesce("limit_above", F.lit(0)).alias("outliers"))


def _freight() -> Column:
    return F.when(is_numeric("freight_cost_usd"), to_dec("freight_cost_usd", 30, 6))


def quality_summary(raw: dict[str, DataFrame]) -> DataFrame:
    """Size, key and fault counts per raw table under generic column names.

    missing_required: lead time, capacity, segment, freight. invalid_value: cost,
    quantity, date order, negative stock. other_issue: key spelling, old location
    names, unknown segments, freight above the 99th percentile.
    """
    zero = F.lit(0).cast("long")
    skus, orders, shipments = raw["dim_sku_raw"], raw["fact_sales_orders_raw"], raw["fact_shipments_raw"]
    stripped = F.upper(F.translate("sku_id", "-_", ""))
    cost = to_dec("unit_cost_usd")
    parts = [
        _summary(
            skus, "dim_sku_raw", F.col("sku_id"), count_missing("lead_time_days"),
            F.count_if(cost.isNull() | (cost <= 0)), F.count_if(F.col("sku_id") != stripped), "unique",
        ),
        _summary(
            raw["dim_location_raw"], "dim_location_raw", F.col("location_id"),
            count_missing("capacity_units"), zero, count_like("location_id", OLD_LOCATION_PATTERN), "complete",
        ),
    ]
    seg = _order_segments(orders, skus).agg(
        F.coalesce(F.sum(F.when(F.col("segment").isNull(), F.col("rows"))), zero).alias("_no_segment"),
        F.coalesce(F.sum(F.when(~F.col("segment").isin(*SEGMENTS), F.col("rows"))), zero).alias("_odd_segment"),
    )
    base = _summary(
        orders, "fact_sales_orders_raw", F.col("order_id"), zero, count_not_positive("quantity"), zero, "unique"
    )
    parts.append(_attach(base, seg, missing_required="_no_segment", other_issue="_odd_segment"))
    base = _summary(
        shipments, "fact_shipments_raw", F.col("shipment_id"), count_missing("freight_cost_usd"),
        count_date_inversion("arrival_date", "ship_date"), zero, "complete",
    )
    parts.append(_attach(base, freight_outliers(shipments), other_issue="outliers"))
    snapshot_key = F.concat("snapshot_date", "location_id", "sku_id")
    parts.append(_summary(
        raw["fact_inventory_snapshot_raw"], "fact_inventory_snapshot_raw", snapshot_key,
        zero, count_negative("on_hand_qty"), zero, "valid",
    ))
    # The stock row reports its fault in the first column, as its score does.
    parts[-1] = parts[-1].withColumns({"missing_required": F.col("invalid_value"), "invalid_value": zero})
    return union_reports(*parts)


def _merge_rows(*rows: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _attach(row: DataFrame, extra: DataFrame, **columns: str) -> DataFrame:
    """Replace columns of a one-row frame by values of another."""
    merged = _merge_rows(row, extra)
    return merged.withColumns({name: F.col(src) for name, src in columns.items()}).select(*row.columns)


def pct_of_total(df: DataFrame, count: str = "count", scale: int = 1) -> DataFrame:
    """Share of each (already grouped) row in the overall count."""
    overall = F.sum(count).over(Window.partitionBy())
    return df.withColumn("pct_of_total", ratio(F.col(count) * 100, overall, scale))


def key_format_report(raw_skus: DataFrame, col: str = "sku_id") -> DataFrame:
    """Spellings of the product key, most frequent first."""
    groups = raw_skus.groupBy(sku_format(col).alias("format_type")).agg(F.count(F.lit(1)).alias("count"))
    return pct_of_total(groups).orderBy(F.desc("count"), "format_type")


def outlier_profile(shipments: DataFrame) -> DataFrame:
    """Quartiles, 99th percentile, extreme and mean of the readable freights."""
    counts = value_counts(shipments, [], _freight())
    cuts = percentiles_from_counts(counts, [], {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}, few_groups=True)
    weight = F.col("_c").cast("decimal(13,0)")
    stats = counts.agg(
        F.max("_v").alias("top"),
        ratio(F.sum(F.col("_v") * weight), F.sum("_c"), 2).alias("mean"),
    )
    return _merge_rows(cuts, stats).select(
        F.round("p25", 2).alias("p25_freight"),
        F.round("p50", 2).alias("p50_freight"),
        F.round("p75", 2).alias("p75_freight"),
        F.round("p99", 2).alias("p99_freight_cap"),
        F.round("top", 2).alias("max_freight_before_cap"),
        F.col("mean").alias("mean_freight"),
        ratio(F.col("top"), F.col("p99"), 1).alias("max_to_p99_ratio"),
    )


def score_card(raw: dict[str, DataFrame]) -> DataFrame:
    """Key uniqueness per table in percent with its band, worst first."""
    keys = {
        "dim_sku_raw": "sku_id",
        "dim_location_raw": "location_id",
        "fact_sales_orders_raw": "order_id",
        "fact_shipments_raw": "shipment_id",
    }
    parts = [
        raw[table].agg(F.count_distinct(key).alias("_keys"), F.count(F.lit(1)).alias("_rows"))
        .select(F.lit(table).alias("table_name"), ratio(F.col("_keys") * 100, F.col("_rows"), 12).alias("_score"))
        for table, key in keys.items()
    ]
    return union_reports(*parts).orderBy("_score", "table_name").select(
        "table_name", F.round("_score", 1).alias("quality_score_pct"), score_band("_score").alias("status")
    )


def _audit_row(df: DataFrame, fix: str, method: str, after: Column, before: Column) -> DataFrame:
    return df.select(
        F.lit(fix).alias("fix_applied"), after.alias("records_after_clean"),
        before.alias("records_before_clean"), F.lit(method).alias("method"),
    )


def cleaning_audit(raw: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """What each repair started from and ended with, all counted from the data."""
    def one(df: DataFrame, **aggs: Column) -> DataFrame:
        return df.agg(*[a.alias(n) for n, a in aggs.items()])

    skus = _merge_rows(
        one(raw["dim_sku_raw"], rows=F.count(F.lit(1)), keys=F.count_distinct(normalize_sku("sku_id")),
            stated=count_present("lead_time_days")),
        one(clean["dim_sku"], filled=F.count("lead_time_days")),
    )
    orders = _merge_rows(
        one(raw["fact_sales_orders_raw"], rows=F.count(F.lit(1))),
        one(clean["fact_sales_orders"], kept=F.count(F.lit(1))),
    )
    ships = _merge_rows(
        one(raw["fact_shipments_raw"], stated=count_present("freight_cost_usd")),
        one(clean["fact_shipments"], positive=F.count_if(F.col("freight_cost_usd") > 0),
            known=F.count("freight_cost_usd")),
    )
    stock = _merge_rows(
        one(raw["fact_inventory_snapshot_raw"], negative=count_negative("on_hand_qty")),
        one(clean["fact_inventory_snapshot"], empty=F.count_if(F.col("on_hand_qty") == 0)),
    )
    rows = [
        (skus, "SKU standardization", "one spelling per product key", "keys", "rows"),
        (skus, "Lead time imputation", "rounded category mean", "filled", "stated"),
        (orders, "Order deduplication", "last valid transmission per order id", "kept", "rows"),
        (ships, "Freight outlier capping", "capped at the mode's 99th percentile", "positive", "stated"),
        (ships, "Freight NULL imputation", "mode mean after capping", "known", "stated"),
        (stock, "Negative inventory correction", "floored at zero", "empty", "negative"),
    ]
    return union_reports(*[_audit_row(df, fix, how, F.col(a), F.col(b)) for df, fix, how, a, b in rows])
