"""Hand-written raw rows with the defects the cleaning layer repairs, in load order."""

LOCATIONS = [
    ("LOC-A", "Alpha DC", "A", "AA", "DC", "North", "1000", "12.5"),
    (" LOC-B ", "Beta RDC ", "B", "BB", " rdc", "South", "", "7"),
    ("LOC-C", "Gamma Store old", "C", "CC", "STORE", "South", "50", "1"),
    ("LOC-C", "Gamma Store", "C", "CC", "STORE", "South", "60", "2"),
    ("", "No key", "D", "DD", "DC", "North", "1", "1"),
    ("LOC-X", "Bad type", "E", "EE", "HUB", "North", "1", "1"),
]
SKUS = [
    ("SKU-001", "Valve", "Packaging", "10.00", "33.0", "S1", "1.5", "", "100.0", "5", "PREMIUM", "Y"),
    ("sku_002", "Pump", "packaging ", "20.00", None, "S1", "", "", "", "5", "standard", "yes"),
    ("Sku-003", "Pipe", "Cold", "5.00", "", "S2", "2", "", "33.5", "5", "BUDGET", "1"),
    ("SKU 004", "Hose", "PACKAGING", "8.00", "20", "S2", "2", "", "-2.5", "5", "OTHER", "N"),
    ("SKU005", "No cost", "Cold", "", "5", "S2", "2", "", "1", "5", "BUDGET", "Y"),
    (" ", "No key", "Cold", "1", "5", "S2", "2", "", "1", "5", "BUDGET", "Y"),
    ("SKU001", "Valve II", "Packaging", "12.00", "abc", "S1", "1.5", "", "100.0", "5", None, "true"),
]
POLICY = [
    ("premium", "99.5", "98", "2", "2.33", "1", "7", "0.25", "85.0", "n"),
    ("STANDARD", "97.0", "95", "5", "1.65", "7", "21", "0.2", "35.0", "n"),
    ("Budget", "92", "90", "10.5", "1.28", "14", "45", "", "12.0", "n"),
    ("GOLD", "92", "90", "10", "1.28", "14", "45", "0.1", "12.0", "n"),
]
LANES = [
    ("L1", "LOC-A", "LOC-B", "100", "3", "4.00", "0.2", "TL", "x"),
    ("L2", "LOC-A", "LOC-B", "100", "3", "3.00", "", "intermodal", "x"),
    ("L3", " LOC-B", "LOC-C", "", "2", "1.00", "", "Parcel", "x"),
    ("L4", "LOC-B", "LOC-C", "10", "2", "1.00", "", "LTL", "x"),
    ("L5", "LOC-A", "LOC-C", "10", "2", "1.00", "", "AIR", "x"),
    ("L6", "LOC-A", "LOC-X", "10", "2", "1.00", "", "TL", "x"),
]
ORDERS = [
    ("O1", "2024-01-01", "C1", "SKU-001", "LOC-C", "10", "30.00", "SHIPPED", "web", ""),
    ("O1", "2024-01-01", "C1", "sku_001", "LOC-C", "12", "30.00", None, "web", ""),
    (" O1", "2024-01-01", "C1", "SKU001", "LOC-C", "12", "30.00", " cancelled", "web", ""),
    ("O2", "2024-01-02", "C1", "SKU 001", "LOC-C", "4.5", "31.00", "SHIPPED", "web", ""),
    ("O3", "2024-01-02", "C2", "SKU002", "LOC-B", "7", "40.00", "SHIPPED", "web", ""),
    ("O4", "2024-01-02", "C2", "SKU002", "LOC-B", "0", "40.00", "SHIPPED", "web", ""),
    ("O5", "2024-01-02", "C2", "SKU999", "LOC-B", "1", "40.00", "SHIPPED", "web", ""),
    ("O6", "2024-01-02", "C2", "SKU002", "LOC-X", "1", "40.00", "SHIPPED", "web", ""),
    ("O7", "2024-01-02", "C2", "SKU004", "LOC-B", "1", "40.00", "SHIPPED", "web", ""),
    ("O8", "2024-01-02", "C2", "SKU003", "LOC-B", "", "40.00", "SHIPPED", "web", ""),
    ("O9", "2024-01-03", "C2", "SKU003", "LOC-B", "5", "9.99", "SHIPPED", "web", ""),
    ("", "2024-01-03", "C2", "SKU003", "LOC-B", "5", "9.99", "SHIPPED", "web", ""),
]
SHIPMENTS = [
    ("S1", "O1", "LOC-B", "LOC-C", "SKU-001", "5", "2024-01-02", "2024-01-04", "100.00", "c", "OK", "", ""),
    ("S2", "O1", "LOC-B", "LOC-C", "SKU-001", "9", "2024-01-02", "2024-01-05", "200.00", "c", "OK", "", ""),
    ("S3", "O3", "LOC-A", "LOC-B", "SKU002", "7", "2024-01-03", "2024-01-01", "", "c", "delayed", "", ""),
    ("S4", "O404", "LOC-A", "LOC-B", "SKU002", "7", "2024-01-03", "", "50.00", "c", "OK", "", ""),
    ("S5", "", "LOC-A", "LOC-C", "SKU002", "1", "2024-01-03", "2024-01-09", "n/a", "c", "OK", "", ""),
    ("S6", "O3", "LOC-B", "LOC-C", "SKU002", "", "2024-01-03", "", "9900.00", "c", "OK", "", ""),
    ("S7", "O9", "LOC-B", "LOC-C", "SKU999", "1", "2024-01-03", "", "300.00", "c", "OK", "", ""),
    ("S2", "O1", "LOC-B", "LOC-C", "SKU-001", "9", "2024-01-02", "2024-01-05", "bad", "c", "OK", "", ""),
]
SNAPSHOTS = [
    ("N1", "2024-02-01", "LOC-C", "SKU-001", "-5", "10", "", "", "wms", ""),
    ("N2", "2024-02-02", "LOC-C", "SKU 001", "40", "", "", "", "wms", ""),
    ("N3", "2024-02-02", "LOC-C", "sku_001", "30", "-3", "", "", "wms", ""),
    ("N4", "", "LOC-C", "SKU001", "30", "1", "", "", "wms", ""),
    ("N5", "2024-02-02", "LOC-B", "SKU002", None, "2", "", "", "wms", ""),
    ("N6", "2024-02-02", "LOC-X", "SKU002", "1", "2", "", "", "wms", ""),
]
DATA = {
    "dim_location_raw": LOCATIONS, "dim_sku_raw": SKUS, "dim_service_policy_raw": POLICY, "dim_lane_cost_raw": LANES,
    "fact_sales_orders_raw": ORDERS, "fact_shipments_raw": SHIPMENTS, "fact_inventory_snapshot_raw": SNAPSHOTS,
}


def write_csv(folder):
    """The rows as extract files; NULL and blank both become empty fields."""
    import csv

    from tidestock.schemas import RAW_FILES, RAW_SCHEMAS

    for name, data in DATA.items():
        with open(folder / RAW_FILES[name], "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(RAW_SCHEMAS[name].names)
            out.writerows([["" if v is None else v for v in row] for row in data])


def raw_tables(spark):
    from pyspark.sql import types as T

    from tidestock.schemas import RAW_SCHEMAS

    tables = {}
    for name, data in DATA.items():
        schema = T.StructType(RAW_SCHEMAS[name].fields + [T.StructField("_ingest_seq", T.LongType())])
        tables[name] = spark.createDataFrame([(*row, i) for i, row in enumerate(data)], schema)
    return tables
