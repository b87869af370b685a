"""CSV extracts in, scenario tables out.

Quotes are doubled inside quoted fields and a backslash is an ordinary character, on
reading and on writing. A row with too few or too many fields stops the read, as does
a header that does not match.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scenario import coerce_numeric
from ..schemas import POLICY_SCHEMA, RAW_FILES, RAW_SCHEMAS
from . import quoted
from .tables import stage, stage_root

#: How fields are written; a row with another number of fields, or broken quotes, stops the read.
FORMAT = {"nullValue": "", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def _scan(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """All fields of a row are parsed, whatever a query selects, so that every row is checked whole."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, columnPruning=False, **FORMAT).csv(path)


def natural_order(path: str) -> bytes:
    """Path text that sorts numbers by value, so part2 comes before part10."""
    return re.sub("[0-9]+", lambda number: number.group().rjust(40, "0"), path).encode()


def _file_numbers(scan: DataFrame) -> DataFrame:
    """(path, file): the place of each file of a scan in natural order.

    A row then carries a number, not the text of a path, through every later sort and shuffle.
    """
    listed = scan.inputFiles()
    places = {order: place for place, order in enumerate(sorted(set(map(natural_order, listed))))}
    # Rows name a file without authority by one slash, listings by three.
    paths = {form: places[natural_order(file)] for file in listed for form in (file, re.sub("^([^:/]+):///", r"\1:/", file))}
    table = pa.table({"path": pa.array(list(paths), pa.string()), "file": pa.array(list(paths.values()), pa.int32())})
    return scan.sparkSession.createDataFrame(table)


def _with_sequence(rows: DataFrame, scan: DataFrame, names: list[str], file: Column, block: Column, row: Column) -> DataFrame:
    """The named fields and `_ingest_seq`; a file that the scan does not list stops the read."""
    placed = rows.select(*names, file.alias("_path"), block.alias("_block"), row.alias("_row"))
    numbered = placed.join(F.broadcast(_file_numbers(scan)), F.col("_path") == F.col("path"), "left")
    number = F.coalesce("file", F.raise_error(F.concat(F.lit("no number for file "), "_path")).cast("int"))
    return numbered.select(*names, F.struct(number.alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row")).alias("_ingest_seq"))


def read_raw(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """All-text scan of one extract with its load order in `_ingest_seq`.

    A header that does not match `schema`, or a row with another number of fields, raises
    instead of shifting columns. Empty fields read as NULL. Line breaks inside quotes need
    `multi_line`, which finds the records first (`quoted`), in as many tasks as the file has
    blocks; without it such a row raises too. The sequence orders rows by file (numbers in names
    by value), block and position in the block, so splitting a large file over tasks keeps its order.
    """
    scan = _scan(spark, path, schema)
    if multi_line:
        root = stage_root(spark)
        rows = quoted.read_rows(spark, path, schema, {**FORMAT, "multiLine": "true"}, lambda df, name: stage(df, root, name))
        return _with_sequence(rows, scan, schema.names, F.col("file"), F.col("block"), F.col("row"))
    meta = F.col("_metadata")
    return _with_sequence(scan, scan, schema.names, meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id())


def read_raw_layer(
    spark: SparkSession, raw_dir: str, schemas: dict[str, T.StructType] = RAW_SCHEMAS, multi_line: bool = False
) -> dict[str, DataFrame]:
    return {name: read_raw(spark, f"{raw_dir}/{RAW_FILES[name]}", schema, multi_line) for name, schema in schemas.items()}


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Policy table from CSV; figures that do not read as numbers become 0."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in POLICY_SCHEMA.fields])
    return coerce_numeric(_scan(spark, path, text))


def export_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path, compression=compression)
