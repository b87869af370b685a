import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import fixtures
from tidestock.plans.clean import clean_all
from tidestock.plans.pipeline import run_pipeline
from tidestock.schemas import LEGACY_RAW_SCHEMAS, RAW_FILES, RAW_SCHEMAS
from tidestock.sources import csv as src
from tidestock.sources import legacy
from tidestock.sources import tables as store


def test_pipeline_runs_and_reruns(spark, tmp_path):
    fixtures.write_csv(tmp_path)
    out = str(tmp_path / "out")
    first = {r.table_name: r.row_count for r in run_pipeline(spark, str(tmp_path), out, min_obs=1, sims=20).collect()}
    assert first["fact_sales_orders_raw"] == 12 and first["fact_sales_orders"] == 4
    assert first["fact_shipments"] == 5 and first["fact_inventory_snapshot"] == 3
    assert first["mart_demand_stats"] == 3 and first["mart_data_quality_report"] == 7
    again = {r.table_name: r.row_count for r in run_pipeline(spark, str(tmp_path), out, min_obs=1, sims=20).collect()}
    assert again == first
    policy = store.read_mart(spark, f"{out}/marts", store.POLICY_TABLE)
    exported = spark.read.option("header", True).csv(f"{out}/scenario")
    assert exported.count() == policy.count() and "recommendation" in exported.columns


def test_header_mismatch_raises(spark, tmp_path):
    (tmp_path / "sku.csv").write_text("sku_id,description,category\nA,B,C\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        src.read_raw(spark, str(tmp_path / "sku.csv"), RAW_SCHEMAS["dim_sku_raw"]).collect()


def test_blank_fields_are_null_and_order_is_load_order(spark, tmp_path):
    schema = RAW_SCHEMAS["dim_location_raw"]
    for part in (1, 2):
        lines = [",".join(schema.names)] + [f'P{part}-{i},"a, b",,"",DC,r,1,1' for i in range(500)]
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = src.read_raw(spark, str(tmp_path), schema)
        assert df.rdd.getNumPartitions() > 2
        ids = [r.location_id for r in df.orderBy("_ingest_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [f"P{p}-{i}" for p in (1, 2) for i in range(500)]
    first = df.first()
    assert first.location_name == "a, b" and first.city is None and first.state is None


def _location_lines(tmp_path, *lines, name="x.csv"):
    (tmp_path / name).write_text("\n".join([",".join(RAW_SCHEMAS["dim_location_raw"].names), *lines]) + "\n")
    return str(tmp_path / name)


def test_quotes_commas_and_backslashes(spark, tmp_path):
    path = _location_lines(
        tmp_path, 'L1,"Big ""North"" hub, A",c,s,DC,r,1,2', 'L2,"back\\",c,s,DC,r,1,2', 'L3,plain\\,c,s,DC,r,1,2', 'L4,"a""",,"",DC,r,1,2')
    rows = {r.location_id: r for r in src.read_raw(spark, path, RAW_SCHEMAS["dim_location_raw"]).collect()}
    assert [rows[f"L{i}"].location_name for i in (1, 2, 3, 4)] == ['Big "North" hub, A', "back\\", "plain\\", 'a"']
    assert all(r.city == "c" and r.operating_cost_per_day == "2" for k, r in rows.items() if k != "L4")
    assert rows["L4"].city is None and rows["L4"].state is None


@pytest.mark.parametrize("line", ["L3,short,c", "L4,n,c,s,DC,r,1,2,EXTRA", 'L5,"line\nbreak",c,s,DC,r,1,2'])
def test_broken_rows_stop_the_read(spark, tmp_path, line):
    path = _location_lines(tmp_path, "L1,n,c,s,DC,r,1,2", line)
    frame = src.read_raw(spark, path, RAW_SCHEMAS["dim_location_raw"])
    with pytest.raises(Exception, match="(?i)malformed"):
        frame.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        frame.select("location_id").collect()


def test_line_breaks_on_request(spark, tmp_path):
    path = _location_lines(tmp_path, 'L5,"line\nbreak, ""x""",c,s,DC,r,1,2', "L6,n,c,s,DC,r,1,2")
    rows = src.read_raw(spark, path, RAW_SCHEMAS["dim_location_raw"], multi_line=True).orderBy("_ingest_seq").collect()
    assert [(r.location_id, r.location_name) for r in rows] == [("L5", 'line\nbreak, "x"'), ("L6", "n")]


def _quoted_file(path, rows, seed, end="\n"):
    """Rows of text as CSV with every kind of trouble inside quotes."""
    rng = random.Random(seed)
    schema = RAW_SCHEMAS["dim_location_raw"]
    parts = ["\n", "\n\n", "a, b", '""', ",", "é中", "plain", "\\", '"",""\n', " ", "\r\nx"]
    lines = [",".join(schema.names)]
    for k in range(rows):
        name = "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 12])))
        lines.append(f'P{k},"{name}",c,,"DC",r{k},"",{k}')
    path.write_bytes((end.join(lines) + rng.choice(["", end, end + end])).encode())


@pytest.mark.parametrize("size", [64, 333, 1 << 20])
def test_line_breaks_in_any_number_of_splits(spark, tmp_path, size):
    """Blocks that end anywhere, also inside quotes and over several blocks, give what one task per file gives."""
    schema = RAW_SCHEMAS["dim_location_raw"]
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        _quoted_file(tmp_path / f"f{k}.csv", [40, 25, 0][k], k, end)
    _location_lines(tmp_path, "L1,n" + 'x,"' + "long\n" * 200 + '",s,DC,r,1,2', name="f3.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = src.read_raw(spark, str(tmp_path), schema, multi_line=True)
        rows = [tuple(r)[:-1] for r in got.orderBy("_ingest_seq").collect()]
        blocks = got.select("_ingest_seq.block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for k in range(4):
        whole = spark.read.schema(schema).options(header=True, multiLine=True, **src.FORMAT).csv(str(tmp_path / f"f{k}.csv"))
        want += [tuple(r) for r in whole.collect()]
    # Spark turns line ends inside quotes into those of the file's own kind; here they stay.
    plain = lambda rows: [tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows]
    assert plain(rows) == plain(want) and len(rows) == 66 and (blocks > 3) == (size < 1000)
    assert any("\n" in (r[1] or "") for r in rows)


def test_quoted_files_that_are_broken(spark, tmp_path):
    schema = RAW_SCHEMAS["dim_location_raw"]
    path = _location_lines(tmp_path, 'L1,"never closed,c,s,DC,r,1,2', "L2,n,c,s,DC,r,1,2")
    with pytest.raises(ValueError, match="left open"):
        src.read_raw(spark, path, schema, multi_line=True)
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_raw(spark, _location_lines(tmp_path, 'L1,"a\nb",c', name="y.csv"), schema, multi_line=True)
    (tmp_path / "z.csv").write_text("location_id,name\nA,B\n")
    with pytest.raises(Exception, match="(?i)header|malformed"):
        src.read_raw(spark, str(tmp_path / "z.csv"), schema, multi_line=True).collect()
    names = ",".join(schema.names).replace("region", "area")
    (tmp_path / "w.csv").write_text(f"{names}\nL1,n,c,s,DC,r,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.read_raw(spark, str(tmp_path / "w.csv"), schema, multi_line=True).collect()


def test_files_load_in_numeric_order(spark, tmp_path):
    for part in (10, 2, 1):
        _location_lines(tmp_path, f"L,part {part},c,s,DC,r,1,2", name=f"part{part}.csv")
    rows = src.read_raw(spark, str(tmp_path), RAW_SCHEMAS["dim_location_raw"]).orderBy("_ingest_seq").collect()
    assert [r.location_name for r in rows] == ["part 1", "part 2", "part 10"]


@pytest.mark.parametrize("multi_line", [False, True])
def test_rows_carry_the_number_of_their_file(spark, tmp_path, multi_line):
    """Not the text of its path, which went through every sort and shuffle; names with blanks and signs are found."""
    folder = tmp_path / "a b%20ü+#1"
    folder.mkdir()
    for part in (10, 2, 1):
        _location_lines(folder, f"L,part {part},c,s,DC,r,1,2", name=f"part {part}%.csv")
    df = src.read_raw(spark, str(folder), RAW_SCHEMAS["dim_location_raw"], multi_line)
    assert df.schema["_ingest_seq"].dataType["file"].dataType.simpleString() == "int"
    assert [(r.location_name, r.file) for r in df.orderBy("_ingest_seq").select("location_name", "_ingest_seq.file").collect()] == [("part 1", 0), ("part 2", 1), ("part 10", 2)]


def test_policy_and_earlier_layout_use_the_same_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'sku_id,location_id,avg_demand,std_demand,lead_time,reorder_point,safety_stock\n"A ""1""\\",X,1,2,3,4,5\n')
    assert src.read_policy(spark, str(tmp_path / "p.csv")).first().sku_id == 'A "1"\\'
    (tmp_path / "p.csv").write_text("sku_id,location_id,avg_demand,std_demand,lead_time,reorder_point,safety_stock\nA,X,1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_policy(spark, str(tmp_path / "p.csv")).collect()
    names = LEGACY_RAW_SCHEMAS["dim_location_raw"].names
    (tmp_path / RAW_FILES["dim_location_raw"]).write_text(",".join(names) + '\nL,"a, ""b""",DC,r,1,2,3,4\n')
    layer = src.read_raw_layer(spark, str(tmp_path), {"dim_location_raw": LEGACY_RAW_SCHEMAS["dim_location_raw"]})
    assert legacy.to_current(layer["dim_location_raw"], "dim_location_raw").first().location_name == 'a, "b"'


def test_compressed_extracts_read_back_in_order(spark, tmp_path):
    schema = RAW_SCHEMAS["dim_location_raw"]
    made = spark.range(0, 900, 1, 3).select(F.col("id").cast("string").alias("location_id"), *[F.lit('a "b",').alias(n) for n in schema.names[1:]])
    src.export_csv(made, str(tmp_path / "out"), compression="gzip")
    assert [f for f in os.listdir(tmp_path / "out") if f.startswith("part") and f.endswith(".csv.gz")]
    rows = src.read_raw(spark, str(tmp_path / "out"), schema).orderBy("_ingest_seq").collect()
    assert [r.location_id for r in rows] == [str(k) for k in range(900)] and rows[5].region == 'a "b",'


def test_export_reads_back(spark, tmp_path):
    made = spark.createDataFrame([('say "x", y\\', 1.5), ("\\", 2.0)], "a string, b double")
    src.export_csv(made, str(tmp_path / "out"))
    back = src._scan(spark, str(tmp_path / "out"), made.select(made.a, made.b.cast("string")).schema)
    assert sorted((r.a, float(r.b)) for r in back.collect()) == sorted(map(tuple, made.collect()))


def test_policy_csv_and_preview(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "sku_id,location_id,avg_demand,std_demand,lead_time,reorder_point,safety_stock\nA,X,10.5,,4,oops,2\n")
    row = src.read_policy(spark, str(tmp_path / "p.csv")).first()
    assert (row.avg_demand, row.std_demand, row.lead_time, row.reorder_point) == (10.5, 0.0, 4.0, 0.0)
    assert store.preview(spark.range(50)).count() == 5


def test_staged_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = store.stage_root(spark)
    assert root != store.stage_root(spark)
    assert root.startswith(shared or spark.sparkContext.getCheckpointDir())
    staged = store.stage(spark.range(5), root, "t")
    assert staged.count() == 5 and "FileScan" in staged._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_can_be_removed(spark):
    root = store.stage_root(spark)
    store.stage(spark.range(5), root, "t")
    before = set(store._roots[spark.sparkContext.applicationId])
    folder = root.removeprefix("file:")
    assert root in before and os.path.isdir(folder)
    kept, store._roots[spark.sparkContext.applicationId] = before - {root}, [root]
    store.remove_stages(spark)
    assert not os.path.exists(folder) and spark.sparkContext.applicationId not in store._roots
    store._roots[spark.sparkContext.applicationId] = list(kept)


def test_earlier_layout_cleans_with_the_same_functions(spark, tmp_path):
    data = {
        "dim_location_raw": ["LOC-A,Alpha,DC,North,1,100,0.5,12.5", "LOC-C,Gamma,STORE,South,3,,,1"],
        "dim_sku_raw": ["sku_001,Valve,Packaging,Sub,10.00,0.25,1.5,S1,33,100,true,2024-01-02"],
        "dim_service_policy_raw": ["premium,0.995,2.33,85,1,2,3,1,0.25,10"],
        "dim_lane_cost_raw": ["L1,LOC-A,LOC-C,air,10,2,0.5,1.25,0.1"],
        "fact_sales_orders_raw": ["O1,2024-01-01,SKU-001,C1,LOC-C,premium,5,9.99,web,yes"],
        "fact_shipments_raw": ["S1,O1,2024-01-02,2024-01-09,LOC-A,LOC-C,SKU 001,5, air,10.00,c,Y,N",
                               "S2,O2,2024-01-02,2024-01-09,LOC-A,LOC-C,SKU 001,5,AIR,,c,,1"],
        "fact_inventory_snapshot_raw": ["2024-01-05,LOC-C,SKU001,-4,7,2,6,9,2024-01-01,"],
    }
    for name, lines in data.items():
        (tmp_path / RAW_FILES[name]).write_text("\n".join([",".join(LEGACY_RAW_SCHEMAS[name].names), *lines]) + "\n")
    clean = {n: df.collect() for n, df in clean_all(legacy.read_legacy_layer(spark, str(tmp_path)), "order").items()}
    assert [r.storage_cost_per_unit is None for r in sorted(clean["dim_location"])] == [False, True]
    sku, policy, lane = clean["dim_sku"][0], clean["dim_service_policy"][0], clean["dim_lane_cost"][0]
    assert (sku.subcategory, str(sku.last_updated), float(sku.unit_volume_cuft)) == ("Sub", "2024-01-02", 0.25)
    assert (float(policy.target_fill_rate), policy.expedite_threshold, policy.min_order_qty) == (0.995, 3, 10)
    assert (lane.transport_mode, float(lane.transit_days_std)) == ("AIR", 0.5)
    order = clean["fact_sales_orders"][0]
    assert (order.customer_segment, order.priority_flag, order.ship_to_location) == ("PREMIUM", True, "LOC-C")
    ships = {r.shipment_id: r for r in clean["fact_shipments"]}
    assert (ships["S1"].transport_mode, ships["S1"].on_time_flag, ships["S1"].damage_flag) == ("AIR", True, False)
    assert (float(ships["S2"].freight_cost_usd), ships["S2"].on_time_flag, ships["S2"].order_id) == (10.0, False, None)
    stock = clean["fact_inventory_snapshot"][0]
    assert (stock.on_hand_qty, stock.backorder_qty, stock.safety_stock_qty, stock.reorder_point_qty) == (0, 2, 6, 9)


class _Fails(Exception):
    pass


def _rows(spark, root):
    return sorted(r[0] for r in store.read_table(spark, root, "t").collect())


def test_a_failed_reload_leaves_the_former_table(spark, tmp_path):
    root = str(tmp_path)
    store.overwrite_table(spark.range(5).toDF("x"), root, "t")
    before = store.read_table(spark, root, "t")
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 777, F.raise_error(F.lit("midway"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="midway"):
        store.overwrite_table(broken, root, "t")
    assert _rows(spark, root) == [0, 1, 2, 3, 4]
    store.overwrite_table(store.read_table(spark, root, "t").select((F.col("x") * 2).alias("x")), root, "t")  # reads what it replaces
    assert _rows(spark, root) == [0, 2, 4, 6, 8]
    assert sorted(r[0] for r in before.collect()) == [0, 1, 2, 3, 4]  # a query that began earlier


def test_a_reload_that_stops_before_its_mark_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.overwrite_table(spark.range(3).toDF("x"), root, "t")
    mark = store._Folder.mark
    monkeypatch.setattr(store._Folder, "mark", lambda self, name: (_ for _ in ()).throw(_Fails()) if not name.startswith("_") else mark(self, name))
    with pytest.raises(_Fails):
        store.overwrite_table(spark.range(9).toDF("x"), root, "t")
    monkeypatch.setattr(store._Folder, "mark", mark)
    assert _rows(spark, root) == [0, 1, 2]
    store.overwrite_table(spark.range(4).toDF("x"), root, "t")
    assert _rows(spark, root) == [0, 1, 2, 3]


def test_versions_expire(spark, tmp_path):
    root = str(tmp_path)
    for n in range(1, 6):
        store.overwrite_table(spark.range(n).toDF("x"), root, "t")
    kept = [d for d in os.listdir(tmp_path / "t") if d.startswith("v-")]
    assert len(kept) == store.KEPT_VERSIONS and _rows(spark, root) == [0, 1, 2, 3, 4]
    os.utime(tmp_path / "t" / kept[0], (0, 0))
    (tmp_path / "t" / "v-left").mkdir()
    os.utime(tmp_path / "t" / "v-left", (0, 0))
    (tmp_path / "t" / "v-now").mkdir()
    store.overwrite_table(spark.range(2).toDF("x"), root, "t")
    left = os.listdir(tmp_path / "t")
    assert "v-left" not in left and "v-now" in left and _rows(spark, root) == [0, 1]


def test_tables_without_versions_are_read(spark, tmp_path):
    spark.range(3).toDF("x").write.parquet(f"{tmp_path}/t")
    assert _rows(spark, str(tmp_path)) == [0, 1, 2]
    store.overwrite_table(spark.range(2).toDF("x"), str(tmp_path), "t")
    assert _rows(spark, str(tmp_path)) == [0, 1]


def test_two_reloads_at_once(spark, tmp_path):
    root, frames = str(tmp_path), [spark.range(n).toDF("x") for n in (2, 3, 4, 5)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: store.overwrite_table(df, root, "t"), frames))
    assert len(_rows(spark, root)) in (2, 3, 4, 5)
    assert [n for n, _ in store._marks(store._Folder(spark, f"{root}/t/log"))] == [3, 4]
