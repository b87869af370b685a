"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors of unit length are rotated by a fixed random rotation and cut into low-dimensional blocks.
Cosine >= t means a squared distance <= 2 - 2t, so in at least one block the squared distance is
within that block's proportional share of the budget. Each block is joined on its own by range:
cells along the block's first coordinate, as wide as the block's radius, meet themselves and their
next neighbour; inside a task a sweep along the second coordinate narrows the candidates, and the
block's distance decides. A candidate pair is verified exactly (cosine in double precision), and
counts in the first block where it is within budget, so that it counts once.

Equal vectors of a label are one representative. Cells that hold many vectors are cut into tiles,
and pairs of tiles are tasks, so no task holds more than two tiles. Tasks give counts of links per
representative and only those links that connect something new, never all pairs. Work within a
label still grows with the square of its vectors, times the share of pairs that a block lets pass.

Defined cases: a vector that is null, zero, or holds nulls, NaN or infinities, or a null label, links
with nothing: no links, its own component, kept. Vectors of another length than the rest link only
among their own length. Null ids count as links but name no component; repeated ids are rows of
their own. Copies (equal vectors of a label) link with each other. An empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .simhash_trie import Forest

BLOCKS = 8
#: Vectors of a cell that one task compares at most, with as many of another tile.
TILE = 2048
SEED = 7
#: Room for rounding in the comparison of block distances; candidates are verified exactly.
SLACK = 1e-6


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def cuts(d: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Ranges of the rotated coordinates, as even as can be."""
    at = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; einsum sums in one order, so a vector gets equal coordinates in every task."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]))


def budget(d: int, part: tuple[int, int], cosine: float) -> float:
    """A block's share of the squared distance, by its number of coordinates, with room for rounding."""
    return (2 - 2 * cosine) * (part[1] - part[0]) / d + SLACK


def _sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the components as doubles, or null for a vector that cannot link.

    Zeros of either sign become 0.0, so that equal vectors have equal components.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", whole.alias("vector"))
    return rows.withColumn("vector", F.when(F.col("label").isNotNull() & good, F.col("vector")))


def representatives(rows: DataFrame) -> DataFrame:
    """(label, vector, copies, first_id): one row per label and vector that can link."""
    sound = rows.where("vector is not null")
    return sound.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))


def _places(reps: DataFrame, cosine: float) -> DataFrame:
    """(rep, label, d, block, x): the cell of each representative in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            sizes = np.array([len(v) for v in rows["vector"]], int)
            for d in np.unique(sizes).tolist():
                at = np.nonzero(sizes == d)[0]
                ids, labels = (pa.array([rows[c][i] for i in at], batch.schema.field(c).type) for c in ("rep", "label"))
                t = turned(scaled(np.array([rows["vector"][i] for i in at], float)))
                for block, part in enumerate(cuts(d)):
                    x = np.floor(t[:, part[0]] / (np.sqrt(budget(d, part, cosine)) + 1e-9))
                    yield pa.RecordBatch.from_arrays(
                        [ids, labels, pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), block), pa.int32()), pa.array(x, pa.int64())],
                        names=["rep", "label", "d", "block", "x"],
                    )

    kind = reps.schema["label"].dataType.simpleString()
    return reps.select("rep", "label", "vector").mapInArrow(run, f"rep long, label {kind}, d int, block int, x long")


def _dealt(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, cell, next, tile_a, tile_b, side): the tasks of each representative.

    A task compares tile_a of a cell with tile_b of the same cell (next 0) or of the next one (next 1).
    """
    cell = ["label", "d", "block"]
    counts = scratch.store(places.groupBy(*cell, "x").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "cells")
    after = counts.select(*cell, (F.col("x") - 1).alias("x"), F.col("tiles").alias("after"))
    before = counts.select(*cell, (F.col("x") + 1).alias("x"), F.col("tiles").alias("before"))
    cells = scratch.store(counts.join(after, [*cell, "x"], "left").join(before, [*cell, "x"], "left"), "neighbours")
    rows = places.join(cells, [*cell, "x"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    none = F.expr("cast(array() as array<struct<x:bigint,next:int,tile_a:int,tile_b:int,side:int>>)")
    x, tile = F.col("x"), F.col("tile")

    def task(x, next, tile_a, tile_b, side):
        values = {"x": x, "next": F.lit(next), "tile_a": tile_a, "tile_b": tile_b, "side": side}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def over(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(none)

    tasks = F.concat(
        over("tiles", lambda t: task(x, 0, F.least(t, tile), F.greatest(t, tile), (tile > t).cast("int"))),
        over("after", lambda t: task(x, 1, tile, t, F.lit(0))),
        over("before", lambda t: task(x - 1, 1, t, tile, F.lit(1))),
    )
    return rows.select("rep", *cell, F.explode(tasks).alias("task")).select("rep", *cell, "task.*")


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their largest component, so that squares neither overflow nor vanish."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _gap(t: np.ndarray, p: np.ndarray, q: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    gap = t[p, part[0] : part[1]] - t[q, part[0] : part[1]]
    return (gap * gap).sum(axis=1)


def compare(vectors: np.ndarray, split: int, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) that count in this block: across vectors[:split] and the rest, or within all if split is 0."""
    d = vectors.shape[1]
    raw, parts = scaled(vectors), cuts(d)
    t = turned(raw)
    lo, hi = parts[block]
    most = budget(d, parts[block], cosine)
    sweep = t[:, min(lo + 1, hi - 1)]
    left, right = np.arange(split or len(t)), np.arange(split, len(t))
    left, right = left[np.argsort(sweep[left], kind="stable")], right[np.argsort(sweep[right], kind="stable")]
    radius, ordered = np.sqrt(most) + 1e-9, sweep[right]
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for start in range(0, len(left), 256):
        i = left[start : start + 256]
        first, end = np.searchsorted(ordered, [sweep[i[0]] - radius, sweep[i[-1]] + radius])
        j = right[first:end]
        a, b = t[i, lo:hi], t[j, lo:hi]
        near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T <= most + 1e-9
        p, q = np.nonzero(near)
        p, q = i[p], j[q]
        if not split:
            p, q = p[p < q], q[p < q]
        keep = _gap(t, p, q, parts[block]) <= most
        p, q = p[keep], q[keep]
        for earlier in parts[:block]:  # a pair counts in its first block
            keep = _gap(t, p, q, earlier) > budget(d, earlier, cosine)
            p, q = p[keep], q[keep]
        linked = cosines(raw[p], raw[q]) >= cosine
        out.append((p[linked], q[linked]))
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _links(dealt: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): with b null, n links of a to copies of others; else a link that connects something new."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, next, tile_a, tile_b = (k.as_py() for k in key[2:])
        sides = table["side"].to_numpy()
        table = table.take(pa.array(np.argsort(sides, kind="stable")))
        reps, copies, split = table["rep"].to_numpy(), table["copies"].to_numpy(), int((sides == 0).sum())
        one = next == 0 and tile_a == tile_b
        i = j = np.zeros(0, int)
        if one or 0 < split < len(reps):
            vectors = np.array(table["vector"].to_pylist(), float)
            i, j = compare(vectors, 0 if one else split, block, cosine)
        counts = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
        new, some = Forest(len(reps)).unite(i, j), np.nonzero(counts)[0]
        return pa.table({
            "a": pa.array(np.concatenate([reps[some], reps[i[new]]]), pa.int64()),
            "b": pa.array([None] * len(some) + reps[j[new]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(new))]).astype(np.int64)),
        })

    keys = ("label", "d", "block", "next", "tile_a", "tile_b")
    return dealt.groupBy("x", *keys).applyInArrow(lambda key, table: run(key[1:], table), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(vectors.sparkSession)
    rows = _sound(vectors)
    made = representatives(rows).withColumn("rep", F.monotonically_increasing_id())  # fixed once stored
    reps = scratch.store(made, "representatives")
    places = scratch.store(_places(reps, cosine), "places")
    dealt = _dealt(places, scratch).join(reps.select("rep", "copies", "vector"), "rep")
    links = scratch.store(_links(dealt, cosine), "links")
    counts = scratch.store(links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")), "counts")
    groups = components(links.where("b is not null"), scratch)

    found = reps.select("rep", "label", "vector", "copies", "first_id").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    found = scratch.store(
        found.join(counts, "rep", "left")
        .select("label", "vector", "first_id", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "found",
    )
    smallest = scratch.store(found.groupBy("root").agg(F.min("first_id").alias("group_id")), "smallest")
    answers = scratch.store(found.join(smallest, "root").select("label", "vector", "n_links", "group_id"), "answers")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("group_id")).cast("long")
    return (
        rows.join(answers, ["label", "vector"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


# All pairs within a label, and reachability by repeated links: for small tables only.
ORACLE_SQL = """
WITH RECURSIVE given AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
),
sound AS (
  SELECT * FROM given WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
),
reached(a, b) AS (SELECT a, b FROM linked UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM given LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""
