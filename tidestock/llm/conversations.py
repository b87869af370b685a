"""Repair of conversations: faulty rows are found, and the role structure is repaired at least cost.

Rows of a conversation are taken by turn (nulls first; of equal turns by role, then by a hash of the
text). The first fault of a row counts: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space does not end a sentence). Blank and
duplicate rows are deleted; `glr_repair` chooses keeps, deletions, new roles and insertions for the rest.

Rows are sorted in ranges over all conversations, so each task has a stretch of them in order, and a
conversation with very many rows, or very many equal ones, is several tasks' work. A conversation that
lies whole inside one stretch, in at most PIECE_ROWS rows and PIECE_CHARS characters, is finished there.
Others leave their task as pieces: what was seen earlier is decided by grouping hashes over the pieces,
each piece becomes a table of its least repairs from any parser stack to any other, the tables are folded
per conversation, and the pieces are repaired by the way found. Texts move once, in the sorting; only
the digest of a conversation in pieces, which is one stream by its nature, takes its repaired texts
through one task, piece by piece.

Defined cases: a null role or text is one space; null conversation ids are one conversation; rows marked
absent count for nothing, but their conversation is reported; a conversation without rows has zeros, an
empty audit and no rows left. Roles other than those of the grammar are never kept. Gaps beyond a long
are the largest long. An empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import glr_repair
from .common import Scratch

#: A piece of a conversation ends after so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 512, 1 << 22
#: Rows that leave a task at once, and characters in them.
BATCH, BATCH_CHARS = 1000, 1 << 24

# What is no content, what ends a sentence, and which roles may follow each other.
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = {"su", "ua", "au"}

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LONGEST = (1 << 63) - 1


def kind_of(text: str) -> str:
    """b blank, t truncated, k neither."""
    said = text.rstrip(SPACE)
    return "b" if not said else "k" if said[-1] in STOPS else "t"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def turn_figures(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """Smallest and largest turn, and how many different ones; nulls do not count."""
    known = {t for t in turns if t is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


def gaps_of(low: int | None, high: int | None, different: int) -> int:
    return 0 if low is None else min(high - low + 1 - different, LONGEST)


def judge(roles: list[str], kinds: str, first: list[bool]) -> tuple[tuple[str, ...], str, int, int, int]:
    """Initials, x (must go), t or k per row, and the numbers of blank, duplicate and truncated rows."""
    must = "".join("x" if k == "b" or not f else k for k, f in zip(kinds, first))
    blank = kinds.count("b")
    return tuple(r[:1] for r in roles), must, blank, must.count("x") - blank, must.count("t")


def finished(turns: list, roles: list[str], texts: list[str]) -> dict:
    """The report and the repaired rows of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    first = [not (row in seen or seen.add(row)) for row in zip(roles, texts)]
    initials, must, blank, duplicate, truncated = judge(roles, "".join(map(kind_of, texts)), first)
    cost, audit = glr_repair.solved(initials, must)
    left = glr_repair.applied(zip(roles, texts), audit)
    return {
        "gaps": gaps_of(*turn_figures(turns)), "blank": blank, "duplicate": duplicate, "truncated": truncated,
        "illegal": illegal_pairs(list(initials)), "cost": cost, "audit": audit,
        "roles": [r for r, _ in left], "texts": [t for _, t in left],
    }


PIECE = (
    "piece long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "turns array<long>, kinds string, roles array<string>, texts array<string>"
)
_LISTS = {"turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "audit": pa.string(), "kinds": pa.string(), "whole": pa.bool_()}


class Cutter:
    """Takes the rows of one task in order and gives finished conversations and pieces of others."""

    def __init__(self, task: int, most: int = PIECE_ROWS):
        self.next, self.most = task << 32, most
        self.ready: list[dict] = []
        self.key, self.begun = None, False
        self.open = True  # the first conversation of a task may have begun in the one before
        self._clear()

    def _clear(self) -> None:
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def row(self, key, turn, role, text, absent) -> None:
        if not self.begun or key != self.key:
            if self.begun:
                self._leave()
                self.open = False
            self.key, self.begun = key, True
        if absent:
            return
        if len(self.roles) >= self.most or self.roles and self.chars + len(text) > PIECE_CHARS:
            self.open = True
            self._leave()
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def _leave(self) -> None:
        done = {"key": self.key, "piece": self.next, "whole": not self.open}
        if self.open:
            done |= {"turns": self.turns, "roles": self.roles, "texts": self.texts, "kinds": "".join(map(kind_of, self.texts))}
        else:
            done |= finished(self.turns, self.roles, self.texts)
        self.ready.append(done)
        self.next += 1
        self._clear()

    def end(self) -> None:
        """The last conversation may go on in the next task."""
        if self.begun:
            self.open = True
            self._leave()


def _batch(rows: list[dict], key: pa.DataType, schema: str) -> pa.RecordBatch:
    names = ["key"] + [c.split()[0] for c in schema.split(", ")]
    types = {"key": key} | _LISTS
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types.get(c, pa.int64())) for c in names], names=names)


def cut(ordered: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(key, PIECE) of rows (key, turn, role, text, absent) that are sorted in ranges."""
    kind = ordered.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter = Cutter(TaskContext.get().partitionId(), piece_rows)
        for batch in batches:
            chars = 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                cutter.row(*row)
                chars += len(row[3])
                if len(cutter.ready) >= BATCH or chars >= BATCH_CHARS and cutter.ready:
                    yield _batch(cutter.ready, arrow, PIECE)
                    cutter.ready, chars = [], 0
        cutter.end()
        if cutter.ready:
            yield _batch(cutter.ready, arrow, PIECE)

    return ordered.mapInArrow(run, f"key {kind.simpleString()}, {PIECE}")


def _firsts(pieces: DataFrame) -> DataFrame:
    """(piece, firsts): the places in each piece whose role and text come first in their conversation."""
    rows = pieces.select("key", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    rows = rows.select("key", "piece", "at", F.col("row.roles").alias("role"), F.sha2(F.col("row.texts").cast("binary"), 256).alias("digest"))
    first = rows.groupBy("key", "role", "digest").agg(F.min(F.struct("piece", "at")).alias("first"))
    return first.groupBy(F.col("first.piece").alias("piece")).agg(F.collect_list("first.at").alias("firsts"))  # PIECE_ROWS at most


TABLE = (
    "piece long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, different long, "
    "ways array<struct<before:int,after:int,cost:bigint,audit:string>>"
)
_WAYS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def tables(pieces: DataFrame) -> DataFrame:
    """(key, TABLE): the figures of each piece, and its least repairs between any two stacks."""
    kind = pieces.schema["key"].dataType
    names = ["key"] + [c.split()[0] for c in TABLE.split(", ")]
    types = {"key": to_arrow_type(kind), "head": pa.string(), "tail": pa.string(), "ways": _WAYS}

    def figures(key, piece, turns, roles, kinds, firsts) -> dict:
        first = [False] * len(roles)
        for at in firsts or ():
            first[at] = True
        initials, must, blank, duplicate, truncated = judge(roles, kinds, first)
        low, high, different = turn_figures(turns)
        ways = [
            {"before": before, "after": after, "cost": cost, "audit": audit}
            for before, row in glr_repair.parser().table_of(list(zip(initials, must))).items() for after, (cost, audit) in row.items()
        ]
        ends = (initials[0], initials[-1]) if initials else (None, None)
        values = (key, piece, blank, duplicate, truncated, illegal_pairs(list(initials)), *ends, low, high, different, ways)
        return dict(zip(names, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                made = figures(*row)
                yield pa.RecordBatch.from_arrays([pa.array([made[c]], types.get(c, pa.int64())) for c in names], names=names)

    rows = pieces.select("key", "piece", "turns", "roles", "kinds").join(_firsts(pieces), "piece", "left")
    rows = rows.select("key", "piece", "turns", "roles", "kinds", "firsts")
    return rows.mapInArrow(run, f"key {kind.simpleString()}, {TABLE}")


class Folder:
    """Folds the tables of one conversation's pieces, in order."""

    def __init__(self, key):
        self.key = key
        self.counts = [0, 0, 0, 0]
        self.tail = self.low = self.high = None
        self.different = 0
        self.frontier, self.settled = glr_repair.parser().start(), []
        self.pieces: list[int] = []
        self.came: list[dict[int, int]] = []

    def add(self, row: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += row[name]
        if row["head"] is not None:
            if self.tail is not None:
                self.counts[3] += self.tail + row["head"] not in LEGAL
            self.tail = row["tail"]
        if row["low"] is not None:
            self.different += row["different"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        table: dict[int, glr_repair.Frontier] = {}
        for way in row["ways"]:
            table.setdefault(way["before"], {})[way["after"]] = way["cost"], way["audit"]
        self.frontier, came = glr_repair.fold(self.frontier, table)
        self.pieces.append(row["piece"])
        self.came.append(came)
        # What all audits begin with is settled.
        low, high = (f(audit for _, audit in self.frontier.values()) for f in (min, max))
        same = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        if same:
            self.settled.append(low[:same])
            self.frontier = {at: (cost, audit[same:]) for at, (cost, audit) in self.frontier.items()}

    def done(self) -> dict:
        (cost, audit), at = glr_repair.parser().best(self.frontier)
        befores, afters = [], []
        for came in reversed(self.came):
            afters.append(at)
            at = came[at]
            befores.append(at)
        blank, duplicate, truncated, illegal = self.counts
        return {
            "key": self.key, "gaps": gaps_of(self.low, self.high, self.different), "blank": blank, "duplicate": duplicate,
            "truncated": truncated, "illegal": illegal, "cost": cost, "audit": "".join([*self.settled, audit]),
            "pieces": self.pieces, "befores": befores[::-1], "afters": afters[::-1],
        }


FOLDED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<long>, befores array<int>, afters array<int>"
_LISTS |= {"pieces": pa.list_(pa.int64()), "befores": pa.list_(pa.int32()), "afters": pa.list_(pa.int32())}


def folded(made: DataFrame) -> DataFrame:
    """(key, FOLDED): a row per conversation in pieces, and the way of its repair through them."""
    kind = made.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.key != row["key"]:
                    if now is not None:
                        yield _batch([now.done()], arrow, FOLDED)
                    now = Folder(row["key"])
                now.add(row)
        if now is not None:
            yield _batch([now.done()], arrow, FOLDED)

    return made.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, f"key {kind.simpleString()}, {FOLDED}")


def _repaired(pieces: DataFrame, made: DataFrame, folds: DataFrame) -> DataFrame:
    """(key, piece, roles, texts): what is left of each piece."""
    kind = pieces.schema["key"].dataType
    arrow = to_arrow_type(kind)
    ways = folds.select(F.explode(F.arrays_zip("pieces", "befores", "afters")).alias("way"))
    ways = ways.select(F.col("way.pieces").alias("piece"), F.col("way.befores").alias("before"), F.col("way.afters").alias("after"))
    chosen = F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after")))
    audits = made.select("piece", "ways").join(ways, "piece").select("piece", "before", F.get(chosen, F.lit(0))["audit"].alias("audit"))
    first = F.array_min(F.col("pieces"))
    starts = folds.select(first.alias("piece"), F.lit(True).alias("first"))
    rows = pieces.select("key", "piece", "roles", "texts").join(audits, "piece").join(starts, "piece", "left")
    rows = rows.select("key", "piece", "roles", "texts", "audit", "before", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, piece, roles, texts, audit, before, first in zip(*(c.to_pylist() for c in batch.columns)):
                # The first piece also has the insertions before it.
                opening = glr_repair.opening(before) if first else []
                left = opening + glr_repair.applied(zip(roles, texts), audit, before)
                yield _batch([{"key": key, "piece": piece, "roles": [r for r, _ in left], "texts": [t for _, t in left]}], arrow, "piece long, roles array, texts array")

    return rows.mapInArrow(run, f"key {kind.simpleString()}, piece long, roles array<string>, texts array<string>")


@dataclass
class Repaired:
    """whole: conversations finished in one task, report and rows in one. reports, pieces: of the others."""

    whole: DataFrame
    reports: DataFrame
    pieces: DataFrame

    def report(self) -> DataFrame:
        """(key, FIGURES, audit) of every conversation."""
        columns = ["key", *FIGURES, "audit"]
        return self.whole.select(columns).unionByName(self.reports.select(columns))

    def rows(self) -> DataFrame:
        """(key, piece, place, role, text): the repaired conversations, in the order of piece and place."""
        columns = ["key", "piece", "roles", "texts"]
        every = self.whole.select(columns).unionByName(self.pieces.select(columns))
        lines = every.select("key", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
        return lines.select("key", "piece", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))

    def digests(self) -> DataFrame:
        """report() and repaired_sha256, of the repaired rows as `role:text`, joined by line breaks."""
        columns = ["key", *FIGURES, "audit"]
        lines = F.concat_ws("\n", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)))
        near = self.whole.select(*columns, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
        far = streamed(self.pieces.select("key", "piece", lines.alias("lines"))).withColumnRenamed("key", "of")
        far = self.reports.join(far, self.reports["key"].eqNullSafe(far["of"]), "left")
        nothing = hashlib.sha256().hexdigest()
        return near.unionByName(far.select(*columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))


def streamed(pieces: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of (key, piece, lines), where a piece without rows has no lines."""
    kind = pieces.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def row(key, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], arrow), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, digest = False, None, None
        for batch in batches:
            for key, lines in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and key == now:
                    digest.update(b"\n")
                else:
                    if begun:
                        yield row(now, digest)
                    begun, now, digest = True, key, hashlib.sha256()
                digest.update(lines.encode())
        if begun:
            yield row(now, digest)

    ordered = pieces.where("lines <> ''").repartition("key").sortWithinPartitions("key", "piece").select("key", "lines")
    return ordered.mapInArrow(run, f"key {kind.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, key: str = "conv_id", absent: Column | None = None, piece_rows: int = PIECE_ROWS) -> Repaired:
    """Repairs the conversations of (key, turn, role, text); rows where `absent` holds are not there."""
    scratch = Scratch(rows.sparkSession)
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    gone = F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False)
    plain = rows.select(
        rows[key].alias("key"), rows["turn"].cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), gone.alias("absent")
    )
    # The last key tells equal rows apart, so that any number of them can be split over tasks.
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    names = ["at0", "at1"]
    keyed = plain.withColumns(dict(zip(names, order[3:])))
    order = [*order[:3], *names]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*names)
    every = scratch.store(cut(ordered, piece_rows), "conversations")
    pieces = every.where(~F.col("whole"))
    made = scratch.store(tables(pieces), "tables")
    folds = scratch.store(folded(made), "folds")
    return Repaired(every.where("whole"), folds, scratch.store(_repaired(pieces, made, folds), "pieces"))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows (conv_id, turn, role, text) with faults by a checksum of conversation and turn, and which are dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    made = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), times)
    return made, F.col("dropped")
