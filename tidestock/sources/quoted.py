"""Records of quoted text files whose line breaks may stand inside quotes, split over tasks.

A file is read as lines, in blocks that different tasks may have. Whether a line begins inside quotes
follows from the number of quotes before it, and only whether that is odd matters. So quotes are
counted per block first; the running count over the blocks of a file says how each block begins; then
each task joins its lines to records, block by block. Records that cross blocks leave their task as fragments and are joined
by the order of the blocks. No file is bound to one task, and no line is moved but the fragments.

A quote opens and closes wherever it stands, and a doubled one does both; a file in which one is left open is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records that leave a task at once.
BATCH = 10_000

RECORD = "file string, block long, row long, part int, text string"
_FIELDS = (("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("text", pa.string()))

#: Parts of records: whole ones, and fragments before (END), over (OVER) or after (BEGIN) the breaks between blocks.
WHOLE, END, OVER, BEGIN = range(4)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside, open): whether a block begins inside quotes, and whether its file ends so."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    every = Window.partitionBy("file")
    earlier = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda n: F.coalesce(n, F.lit(0)) % 2 == 1
    return counts.select(
        "file", "block", odd(F.sum("quotes").over(earlier)).alias("inside"), odd(F.sum("quotes").over(every)).alias("open")
    )


class Joiner:
    """Joins the lines of one block after the other to records."""

    def __init__(self):
        self.place, self.held, self.rows = None, [], []

    def block(self, place: tuple[str, int], inside: bool) -> None:
        self.end()
        self.place, self.inside, self.entered, self.row, self.begun = place, inside, inside, 0, 0

    def line(self, text: str, quotes: int) -> None:
        if not (self.held or self.row or self.place[1]) and text in ("", "\r"):
            return  # blank lines before the header
        if not self.held:
            self.begun = self.row
        self.row += 1
        self.held.append(text)
        self.inside ^= bool(quotes & 1)
        if not self.inside:
            self._leave(END if self.entered else WHOLE)
            self.entered = False

    def _leave(self, part: int) -> None:
        self.rows.append((*self.place, self.begun, part, "\n".join(self.held)))
        self.held = []

    def end(self) -> None:
        if self.held:
            self._leave(OVER if self.entered else BEGIN)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


def _joined(lines: DataFrame) -> DataFrame:
    """RECORD of lines (value, file, block, inside) that are in order within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner()
        for batch in batches:
            quotes = pc.count_substring(batch.column(0), '"').to_pylist()
            for text, file, block, inside, n in zip(*(c.to_pylist() for c in batch.columns), quotes):
                if (file, block) != joiner.place:
                    joiner.block((file, block), inside)
                joiner.line(text, n)
            if len(joiner.rows) >= BATCH:
                yield joiner.taken()
        joiner.end()
        if joiner.rows:
            yield joiner.taken()

    return lines.mapInArrow(run, RECORD)


def _mended(parts: DataFrame) -> DataFrame:
    """(file, block, row, text) of records in fragments: a beginning, what lies over whole blocks, and an end."""
    order = Window.partitionBy("file").orderBy("block", "part")
    number = F.sum(F.when(F.col("part") == BEGIN, 1).otherwise(0)).over(order)
    pieces = parts.select("file", number.alias("record"), F.struct("block", "row", "part", "text").alias("piece"))
    whole = pieces.groupBy("file", "record").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # one record
    first = F.get("pieces", F.lit(0))
    return whole.select("file", first["block"].alias("block"), first["row"].alias("row"), F.array_join("pieces.text", "\n").alias("text"))


def read_rows(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str], stored) -> DataFrame:
    """file, block, row and the fields, as text, of every record but headers and blank lines.

    Each record is parsed once, whole, while it is stored, so a broken one stops the read whatever a
    query selects. stored: stores an intermediate table under a name and gives it back.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])

    def parsed(records: DataFrame, *more: str) -> DataFrame:
        records = records.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
        whole = F.lit(True) if "part" not in records.columns else F.col("part") == WHOLE
        fields = F.when(whole, F.from_csv("text", F.lit(text.simpleString()), {**options, "columnPruning": "false"}))
        return records.select("file", "block", "row", fields.alias("fields"), *more)

    lines = _lines(spark, path).withColumn("line", F.monotonically_increasing_id())
    starts = stored(block_starts(lines), "blocks")
    left_open = starts.where("open").select("file").first()
    if left_open:
        raise ValueError(f"a quote is left open in {left_open['file']}")
    # In order again, should the join have moved the lines; sorting what is sorted is cheap.
    ordered = lines.join(starts.select("file", "block", "inside"), ["file", "block"]).sortWithinPartitions("file", "block", "line")
    joined = _joined(ordered.select("value", "file", "block", "inside"))
    records = stored(parsed(joined, "part", F.when(F.col("part") != WHOLE, F.col("text")).alias("text")), "records")
    mended = stored(parsed(_mended(records.where(F.col("part") != WHOLE))), "mended")
    every = records.where(F.col("part") == WHOLE).select("file", "block", "row", "fields").unionByName(mended)

    is_head = (F.col("block") == 0) & (F.col("row") == 0)
    names = [f.name.lower() for f in text.fields]
    said = F.transform(F.array(*[F.col("fields")[f.name] for f in text.fields]), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    wrong = every.where(is_head & (said != F.array(*map(F.lit, names)))).select("file").first()
    if wrong:
        raise ValueError(f"the header of {wrong['file']} does not match the schema")
    return every.where(~is_head).select("file", "block", "row", *[F.col("fields")[f.name].alias(f.name) for f in text.fields])
