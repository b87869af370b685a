import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestock.operators import audit, filters, impute, keys, quantiles
from tidestock.schemas import CLEAN_TABLES, TableSpec, _layout


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_orders_nulls_as_asked(rows):
    df = rows("k string, d string", ("a", "1"), ("a", None), ("b", "2"), ("b", "9"))
    first = {r.k: r.d for r in keys.latest_per_key(df, ["k"], [F.desc_nulls_first("d")]).collect()}
    last = {r.k: r.d for r in keys.latest_per_key(df, ["k"], [F.desc_nulls_last("d")]).collect()}
    assert first == {"a": None, "b": "9"}
    assert last == {"a": "1", "b": "9"}


def test_latest_per_key_reduces_before_the_shuffle(spark):
    df = spark.range(1000).select(F.floor(F.col("id") / 1000).alias("k"), F.col("id").alias("_ingest_seq"))
    got = keys.last_ingested(df, ["k"])
    assert [r._ingest_seq for r in got.collect()] == [999]
    assert "row_number(), 1, Partial" in plan_of(got)


def test_keep_known_and_orphans(rows):
    fact = rows("id int, k string", (1, "a"), (2, "x"), (3, None))
    dim = rows("key string", ("a",), ("a",), ("b",))
    assert [r.id for r in keys.keep_known(fact, "k", dim, "key").collect()] == [1]
    repaired = keys.null_if_orphan(fact, "k", dim, "key").orderBy("id").collect()
    assert [(r.id, r.k) for r in repaired] == [(1, "a"), (2, None), (3, None)]


def test_rows_without_a_key_spread_over_a_shuffled_join(spark):
    fact = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("k"), "id")
    dim = spark.range(0, 4000, 6).select(F.col("id").cast("string").alias("key"))
    joined = keys.null_if_orphan(fact, "k", dim.hint("merge"), "key")
    assert joined.count() == 4000 and joined.filter("k is not null").count() == 667
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = keys.null_if_orphan(fact, "k", dim, "key").filter("k is null")
        sizes = [r["count"] for r in plain.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_duplicates_and_options(rows):
    df = rows("k string", ("b",), ("a",), ("a",), (None,))
    assert keys.duplicate_count(df, "k").first().asDict() == {"total_rows": 4, "unique_keys": 2, "duplicate_rows": 2}
    assert [r.k for r in keys.distinct_values(df, "k").collect()] == [None, "a", "b"]


def brute(values, p):
    """Linear interpolation on exact fractions."""
    v = sorted(values)
    pos = Decimal(str(p)) * (len(v) - 1)
    low = int(pos)
    high = min(low + (pos != low), len(v) - 1)
    return v[low] + (v[high] - v[low]) * (pos - low)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spread_percentiles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for g in range(4):
        # One group holds most rows, one a single row; values repeat, cross zero and span decades.
        for _ in range([900, 60, 1, 7][g]):
            cents = rng.choice([rng.randint(-500, 500), rng.randint(0, 10**6), 4242])
            data.append((None if g == 3 else f"g{g}", Decimal(cents) / 100))
    df = spark.createDataFrame(data, "g string, v decimal(20,2)").repartition(5)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = quantiles.spread_percentiles(df, ["g"], F.col("v"), wanted).collect()
    assert len(got) == 4
    for row in got:
        values = [v for g, v in data if g == row.g]
        for alias, p in wanted.items():
            assert row[alias] == brute(values, p), (row.g, p)
    counts = quantiles.value_counts(df, ["g"], F.col("v"))
    for row in quantiles.percentiles_from_counts(counts, ["g"], wanted, with_above=True).collect():
        values = [v for g, v in data if g == row.g]
        assert all(row[f"{a}_above"] == sum(v > brute(values, p) for v in values) for a, p in wanted.items())
    overall = quantiles.spread_percentiles(df, [], F.col("v"), wanted).first()
    assert all(overall[a] == brute([v for _, v in data], p) for a, p in wanted.items())


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v decimal(20,2)")
    assert quantiles.spread_percentiles(empty, [], F.col("v"), {"p": 0.5}).collect()[0].p is None


def test_impute_by_group(rows):
    df = rows("id int, c string, v string", (1, "x", "33.0"), (2, "x", "20"), (3, "x", None), (4, "x", "abc"), (5, "y", ""), (6, None, ""))
    got = {r.id: r.v for r in impute.impute_by_group(df, "v", "c", 7).collect()}
    assert got == {1: 33, 2: 20, 3: 27, 4: 27, 5: 7, 6: 7}


def test_winsorize_impute(rows):
    plain = [("T", f"{v}.00") for v in range(1, 101)]
    df = rows("m string, v string", *plain, ("T", "99000.00"), ("T", None), ("T", "n/a"), ("R", "5.005"), ("R", ""), (None, "7.00"), (None, ""))
    cap = brute([Decimal(v) for v in range(1, 101)] + [Decimal(99000)], 0.99)
    values = [min(Decimal(v), cap) for v in list(range(1, 101)) + [99000]]
    mean = round(sum(values) / len(values), 2)
    got = impute.winsorize_impute(df, "v", "m").collect()
    trucks = [r.v for r in got if r.m == "T"]
    assert max(trucks) == round(cap, 2) and trucks.count(mean) >= 2 and len(trucks) == 103
    assert sorted(r.v for r in got if r.m == "R") == [Decimal("5.01"), Decimal("5.01")]
    assert sorted((r.v for r in got if r.m is None), key=str) == [Decimal("7.00"), None]


def test_every_group_and_every_length_takes_part(rows):
    long = "2" + "0" * 14
    df = rows("m string, v string", ("SEA", "1"), ("SEA", long), ("AIR", "9"), ("AIR", "7" * 23), ("X", "8" * 60), ("X", "4"))
    got = {r.m: r for r in impute.winsor_stats(df, "v", "m").collect()}
    assert got["SEA"].cap == 1 + (Decimal(long) - 1) * Decimal("0.99")
    assert got["SEA"].capped_mean == (1 + got["SEA"].cap) / 2
    assert got["AIR"].cap > Decimal("7" * 22) and got["X"].cap == 4
    fixed = impute.winsorize_impute(df, "v", "m").collect()
    assert {r.v for r in fixed if r.m == "SEA"} == {Decimal(1), None}


def test_winsor_stats_scan_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(1000).select(F.lit("T").alias("m"), F.col("id").cast("string").alias("v")).write.parquet(path)
    df = impute.winsor_stats(spark.read.parquet(path), "v", "m")
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1


def test_filters(rows):
    df = rows("k string, s string, q string", ("a", None, "1"), (" ", "x", "2"), ("b", " Cancelled", "0"), ("c", "ok", "bad"))
    assert filters.require_key(df, "k").count() == 3
    assert filters.exclude_status(df, "s", "CANCELLED").count() == 3
    assert filters.require_positive(df, "q").count() == 2
    assert filters.require_in(df, "s", ["X", "OK"]).count() == 2
    assert filters.equality_filter(df, k="a", s=None).count() == 1
    assert filters.equality_filter(df, k=None).count() == 4


def test_audit_counts_each_rule(rows):
    spec = TableSpec(_layout("k:string! n:int ref:string"), ("k",), checks={"n": "n > 0"},
                     refs={"ref": ("dim", "id")}, lengths={"k": 2})
    specs = {"t": spec, "dim": TableSpec(_layout("id:string!"), ("id",))}
    t = rows("k string, n int, ref string", ("a", 1, "x"), ("a", 0, "y"), ("abc", None, "y"), (None, -1, None))
    dim = rows("id string", ("x",))
    got = {(r.table_name, r.rule, r.column_name): r.violations for r in audit.audit_constraints({"t": t, "dim": dim}, specs).collect()}
    assert got == {
        ("t", "not_null", "k"): 1, ("t", "check", "n"): 2, ("t", "max_length", "k"): 1, ("t", "unique", "k"): 1,
        ("t", "reference", "ref"): 2, ("dim", "not_null", "id"): 0, ("dim", "unique", "id"): 0,
    }


def test_defaults_and_counts(rows):
    df = rows("order_id string, priority_flag boolean", ("a", None), ("b", True))
    filled = audit.apply_defaults(df, CLEAN_TABLES["fact_sales_orders"])
    assert [r.priority_flag for r in filled.orderBy("order_id").collect()] == [False, True]
    assert audit.apply_defaults(df.select("order_id"), CLEAN_TABLES["fact_sales_orders"]).filter("priority_flag").count() == 0
    assert [tuple(r) for r in audit.row_counts({"x": df, "y": df.limit(0)}).orderBy("table_name").collect()] == [("x", 2), ("y", 0)]


def test_table_digests_do_not_depend_on_order_and_see_every_cell(spark, rows):
    ddl = "a string, b decimal(10,2), c date, d boolean, e int, _ingest_seq int"
    day = datetime.date(2024, 2, 29)
    data = [("x", Decimal("1.50"), day, True, 1, 1), (None, None, None, None, None, 2), ("", Decimal("-0.01"), day, False, -3, 3), ("x", Decimal("1.50"), day, True, 1, 4)]
    one = lambda data: audit.table_digests({"t": rows(ddl, *data)}).first()
    first = one(data)
    assert (first.row_count, one(data[::-1]).digest) == (4, first.digest)
    assert one([(*r[:5], 99) for r in data]).digest == first.digest  # the load order is no content
    for k in range(5):
        other = ["y", Decimal("1.51"), datetime.date(2024, 3, 1), False, 2]
        changed = [tuple(other[i] if i == k and n == 0 else v for i, v in enumerate(r)) for n, r in enumerate(data)]
        assert one(changed).digest != first.digest
    assert one([("", *data[1][1:]), *data[:1], *data[2:]]).digest != first.digest  # NULL is not the empty text
    assert one([]).digest == "0" and audit.table_digests({"f": spark.range(2).selectExpr("id / 3 AS x")}).first().digest is None


def test_hot_keys_are_joined_apart(spark, rows, tmp_path):
    """As a plain outer join, with a key that has most rows, keys without rows, unknown keys and nulls."""
    many = [("hot", k) for k in range(400)] + [(f"k{k % 40}", k) for k in range(90)] + [(None, 1), ("unknown", 2)]
    one = rows("k string, a int", *[(f"k{k}", k) for k in range(60)], ("hot", -1))
    many = rows("k string, b int", *many)
    got = keys.join_with_hot_keys(one, many, "k")
    key = lambda r: tuple(map(str, r))
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(key, got.collect())) == sorted(map(key, one.join(many, "k", "left").collect()))
    assert keys.join_with_hot_keys(one, many.limit(0), "k").count() == 61 and keys.join_with_hot_keys(one.limit(0), many, "k").count() == 0
    one.write.parquet(f"{tmp_path}/one")
    many.write.parquet(f"{tmp_path}/many")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(keys.join_with_hot_keys(spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/many"), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1


def test_frequent_keys_finds_every_hot_key(spark):
    df = spark.range(30_000).selectExpr("cast(if(id % 3 = 0, id % 2, id) AS string) AS k")
    assert {"0", "1"} <= {r.k for r in keys.frequent_keys(df, "k", most=20, tracked=1000).collect()}


def test_keys_and_references_take_one_read_and_one_shuffle(spark, tmp_path):
    spec = TableSpec(_layout("id:string! ref:string"), ("id", "ref"), refs={"ref": ("dim", "d")})
    specs = {"t": spec, "dim": TableSpec(_layout("d:string!"), ("d",))}
    spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "zz"), ("b", "zz"), ("c", "zz")], "id string, ref string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("x",), ("x",), ("y",)], "d string").write.parquet(f"{tmp_path}/dim")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("t", "dim")}
    df = audit._key_rules(tables, specs)
    plan = plan_of(df)
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
    got = {(r.table_name, r.rule, r.column_name): r.violations for r in df.collect()}
    assert got == {("t", "unique", "id,ref"): 2, ("t", "reference", "ref"): 3, ("dim", "unique", "d"): 1}
