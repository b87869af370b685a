"""Row counts and the data audit that stands in for enforced constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLEAN_TABLES, TableSpec


def union_reports(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame], label: str = "table_name", count: str = "row_count") -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias(count)).select(F.lit(name).alias(label), count)
        for name, df in tables.items()
    ]
    return union_reports(*parts)


def apply_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Fill columns that have a declared default, adding those that are absent."""
    for name, value in spec.defaults.items():
        own = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(own, F.lit(value)))
    return df


def _row_rules(name: str, spec: TableSpec, df: DataFrame) -> DataFrame:
    rules = [("not_null", c, F.count_if(F.col(c).isNull())) for c in spec.required]
    rules += [("check", c, F.count_if(~F.expr(rule))) for c, rule in spec.checks.items()]
    rules += [("max_length", c, F.count_if(F.length(c) > n)) for c, n in spec.lengths.items()]
    counted = df.agg(*[agg.alias(f"_{i}") for i, (_, _, agg) in enumerate(rules)])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("table_name"), F.lit(kind).alias("rule"),
            F.lit(col).alias("column_name"), F.col(f"_{i}").alias("violations"),
        )
        for i, (kind, col, _) in enumerate(rules)
    ])
    return counted.select(F.inline(rows))


def _value(*columns: str):
    """Key values as one text; null where a column is null, except that a key of several columns may hold nulls."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def _key_rules(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """Unique keys and references of all tables, counted together.

    Every row gives one value per key or reference, named by the key it belongs to, and equal values
    combine map-side. So each table is read once, there is one shuffle, and a hot value is a row per task.
    """
    rules, parts, slots = [], [], {}
    for name in tables:
        slots[name, specs[name].key] = 1  # the first counter of a key is its own table's
    for name, df in tables.items():
        spec = specs[name]
        own = [("unique", spec.key, (name, spec.key))]
        own += [("reference", (col,), (dim, (key,))) for col, (dim, key) in spec.refs.items() if dim in tables]
        used = []
        for kind, columns, target in own:
            slot = 0 if kind == "unique" else slots.setdefault(target, 1)
            slots[target] = max(slots[target], slot + 1)
            code = list(slots).index(target)
            used.append(F.struct(F.lit(code).alias("target"), _value(*columns).alias("value"), F.lit(slot).alias("slot")))
            rules.append((name, kind, columns, code, F.col(f"_{slot}")))
        parts.append(df.select(F.explode(F.array(*used)).alias("use")).select("use.*"))
    # A key is met by few rules: a row carries a number for its key and as many counters as any key needs.
    counts = [F.count_if(F.col("slot") == i).alias(f"_{i}") for i in range(max(slots.values()))]
    met = union_reports(*parts).groupBy("target", "value").agg(*counts)
    totals = []
    for i, (_, kind, _, code, n) in enumerate(rules):
        surplus = F.when(n > 0, n - 1) if kind == "unique" else F.when(F.col("value").isNotNull() & (F.col("_0") == 0), n)
        totals.append(F.coalesce(F.sum(F.when(F.col("target") == code, surplus)), F.lit(0)).alias(f"_r{i}"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(kind).alias("rule"), F.lit(",".join(columns)).alias("column_name"), F.col(f"_r{i}").alias("violations"))
        for i, (name, kind, columns, _, _) in enumerate(rules)
    ])
    return met.agg(*totals).select(F.inline(rows))


def audit_constraints(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] = CLEAN_TABLES
) -> DataFrame:
    """(table_name, rule, column_name, violations) for every declared rule: one read of each table for the
    rules of its rows, one for its keys."""
    parts = [_row_rules(name, specs[name], df) for name, df in tables.items()]
    return union_reports(*parts, _key_rules(tables, specs))


def _text(name: str, kind: T.DataType):
    """A column as text that any engine writes alike; decimals as whole numbers of their last digit."""
    if isinstance(kind, T.DecimalType):
        return (F.col(name) * F.lit(10**kind.scale).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return F.col(name).cast("string")


#: Types whose values have one exact text; floating sums depend on the order they are added in.
EXACT = (T.StringType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.BooleanType)


def row_digest(schema: T.StructType):
    """A number of 48 bits from all columns of a row, by name; NULL and the empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), _text(f.name, f.dataType)), F.lit("-")) for f in sorted(schema.fields, key=lambda f: f.name)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")


def table_digests(tables: Mapping[str, DataFrame], without: Sequence[str] = ("_ingest_seq",)) -> DataFrame:
    """(table_name, row_count, digest): the digest is the sum of the rows' digests, whatever their order.

    Equal tables have equal digests; NULL stands where a column has no exact text, and for a table without rows 0.
    """
    parts = []
    for name, df in tables.items():
        df = df.drop(*without)
        exact = all(isinstance(f.dataType, EXACT) for f in df.schema.fields)
        total = F.coalesce(F.sum(row_digest(df.schema)), F.lit(0).cast("decimal(30,0)")).cast("string") if exact else F.lit(None).cast("string")
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), total.alias("digest")).select(F.lit(name).alias("table_name"), "row_count", "digest"))
    return union_reports(*parts)
