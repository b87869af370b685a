"""Whitening of embeddings by a covariance that is weighted by multiplicity.

Entries become integers x = floor(scale * entry) + shift. Equal x vectors are one row with its number
of copies; fits use the copies as weights (or one per distinct vector, `weighted=False`), so each
distinct vector is centred, multiplied and whitened once, and the answers are joined back.

Fit: sums and counts are exact integers; the covariance is a sum of products of blocks of centred
vectors, scaled by the roots of their weights, one d x d matrix per task. Matrices are added row by row
in two steps, so a task adds few of them at a time. The eigenvectors of the sum, d x d numbers
whatever the table, are found in one task. What reaches the driver are d sums and the leading components.

Hot vectors: copies collapse before the shuffle. In the join back a vector with more than a
thousandth of all rows (there are fewer than a thousand) is broadcast and moves no row; the others are
joined by a shuffle, where no key holds more than a thousandth.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out. Vectors of
different lengths are fitted apart, each length with its own n, sums and components; a vector without
entries has no component and gives no row. Scaled entries beyond 2**52 in size are taken as 2**52.
A component without variance (an eigenvalue below the precision of the largest) has explained 0 and a
null `whitened`, and is left out of identity_error, which is null where no component has variance.
`deviation` is exact, decimal(38, 0), and null beyond its digits. Repeated rows and null ids are rows of their
own; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Largest size of a scaled entry: integers up to here are exact doubles.
MOST = 1 << 52
#: A vector is hot with more than one row in so many.
HOT_SHARE = 1000
#: Vectors multiplied at once, and matrices that one task adds in the first step.
ROWS, ADDED = 4096, 256
#: Eigenvalues below this share of the largest, for each dimension, are rounding.
NOTHING = 1e-14

EXACT = pa.decimal128(38, 0)


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole."""
    whole = F.col("embedding").cast("array<double>")
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def as_integer(c):
        held = F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))
        return F.floor(held).cast("long") + shift

    rows = vectors.select("vec_id", whole.alias("vector")).where(F.col("vector").isNotNull() & good)
    return rows.select("vec_id", F.transform("vector", as_integer).alias("x"))


def distinct_vectors(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """(x, copies, weight): one row per distinct vector."""
    counted = rows.groupBy("x").agg(F.count("*").alias("copies"))
    return counted.withColumn("weight", F.col("copies") if weighted else F.lit(1).cast("long"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, positions, vectors as a matrix) for every length in the batch."""
    lists = batch.column(batch.schema.get_field_index("x"))
    sizes = lists.value_lengths().to_numpy()
    flat, starts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.nonzero(sizes == d)[0]
        yield d, at, flat[starts[at][:, None] + np.arange(d)]


def _weights(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("weight")).to_numpy()[at]


def sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors: n and the exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, at, x in _by_length(batch):
                w = _weights(batch, at)
                if int(w.sum()) * (MOST + SHIFT) >= 1 << 62 and int(np.abs(x).max()) * int(w.sum()) >= 1 << 62:
                    x, w = x.astype(object), w.astype(object)
                n, s = total.setdefault(d, [0, np.zeros(d, object)])
                total[d] = [n + int(w.sum()), s + (x * w[:, None]).sum(axis=0).astype(object)]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[Decimal(int(v)) for v in s]], pa.list_(EXACT))], names=["d", "n", "sums"]
            )

    parts = distinct.select("x", "weight").mapInArrow(run, "d int, n long, sums array<decimal(38,0)>")
    added = parts.select("d", "n", F.posexplode("sums").alias("at", "part")).groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("d", "at").collect():  # d rows per length of vectors
        found.setdefault(r["d"], (r["n"], []))[1].append(int(r["total"]))
    return found


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s/n in double precision; whole numbers are taken off first, so no digit is lost to the shift."""
    whole = [v // n for v in s]
    return (x - np.array(whole, np.int64)).astype(float) - np.array([(v % n) / n for v in s])


def _matrices(distinct: DataFrame, fits: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """(d, part, row, line): the lines of each task's weighted product of centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = {}
        for batch in batches:
            for d, at, x in _by_length(batch):
                w = np.sqrt(_weights(batch, at).astype(float))
                for start in range(0, len(at), ROWS):
                    y = centred(x[start : start + ROWS], *fits[d]) * w[start : start + ROWS, None]
                    total[d] = total.get(d, 0) + y.T @ y
        part = TaskContext.get().partitionId()
        for d, m in total.items():
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d), pa.int32()), pa.array(np.full(d, part), pa.int32()), pa.array(np.arange(d), pa.int32()), whole],
                names=["d", "part", "row", "line"],
            )

    return distinct.select("x", "weight").mapInArrow(run, "d int, part int, row int, line array<double>")


def _added(lines: DataFrame, *more: str) -> DataFrame:
    """Lines of equal (d, row, more) added up, in the order of their parts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        d = key[0].as_py()
        line = table["line"].combine_chunks().flatten().to_numpy().reshape(-1, d).sum(axis=0)
        part = table["part"][:1]
        return pa.table({"d": table["d"][:1], "part": part, "row": table["row"][:1], "line": pa.array([line], pa.list_(pa.float64()))})

    return lines.groupBy("d", "row", *more).applyInArrow(run, "d int, part int, row int, line array<double>")


def components(distinct: DataFrame, fits: dict[int, tuple[int, list[int]]], k: int, scratch: Scratch) -> DataFrame:
    """(d, component, value, explained, vector): the leading eigenvectors of each length's covariance."""
    lines = _added(_matrices(distinct, fits), F.floor(F.col("part") / ADDED).alias("step"))
    lines = scratch.store(_added(lines.select("d", "part", "row", "line")), "covariance")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        table = table.sort_by("row")
        v = table["line"].combine_chunks().flatten().to_numpy().reshape(d, d) / fits[d][0]
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        trace, top = float(np.trace(v)), np.arange(d)[::-1][:k]
        e = np.where(values[top] > NOTHING * d * max(values[-1], 0.0), values[top], 0.0)
        return pa.table({
            "d": pa.array(np.full(len(top), d), pa.int32()),
            "component": pa.array(np.arange(1, len(top) + 1), pa.int32()),
            "value": pa.array(e),
            "explained": pa.array(e / trace if trace > 0 else e),
            "vector": pa.array(vectors[:, top].T.tolist(), pa.list_(pa.float64())),
        })

    schema = "d int, component int, value double, explained double, vector array<double>"
    return scratch.store(lines.groupBy("d").applyInArrow(run, schema), "components")


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - s) ** 2, exact."""
    most = n * int(np.abs(x).max()) + max(map(abs, s))
    if most < 1 << 62:
        gap = n * x - np.array(s, np.int64)
        widest = int(np.abs(gap).max())
        if widest * widest * x.shape[1] < 1 << 63:
            return (gap * gap).sum(axis=1).tolist()
        gap = gap.astype(object)
    else:
        gap = n * x.astype(object) - np.array(s, object)
    return (gap * gap).sum(axis=1).tolist()


def _whitened(distinct: DataFrame, fits: dict[int, tuple[int, list[int]]], models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(x, copies, weight, d, deviation, z) of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch):
                n, s = fits[d]
                vectors, values = models[d]
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = np.einsum("ij,jk->ik", centred(x, n, s), vectors) / np.sqrt(values)
                flat = pa.array(z.ravel(), mask=np.tile(values == 0, len(at)))
                exact = [Decimal(v) if v < 10**38 else None for v in deviations(x, n, s)]
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(at), d), pa.int32()), pa.array(exact, EXACT),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, len(values)), pa.int32()), flat)],
                    names=[*rows.schema.names, "d", "deviation", "z"],
                )

    return distinct.select("x", "copies", "weight").mapInArrow(
        run, "x array<long>, copies long, weight long, d int, deviation decimal(38,0), z array<double>"
    )


def identity_errors(whitened: DataFrame, k: int) -> dict[int, float | None]:
    """For each length: the largest absolute entry of the covariance of z minus the identity.

    Two passes: means first, then products of what is centred. Components without variance are left out.
    """
    z = [F.get("z", i) for i in range(k)]
    w, rows = F.col("weight").cast("double"), whitened.groupBy("d")
    means = rows.agg(F.sum(w).alias("n"), *[(F.sum(z[i] * w) / F.sum(w)).alias(f"m{i}") for i in range(k)])
    means = {r["d"]: r for r in means.collect()}  # one row per length of vectors
    if not means:
        return {}
    mean = [
        F.coalesce(*[F.when(F.col("d") == d, F.lit(m[f"m{i}"])) for d, m in means.items()]) for i in range(k)
    ]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [(F.sum((z[i] - mean[i]) * (z[j] - mean[j]) * w) / F.sum(w)).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.agg(*products).collect():
        gaps = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        out[r["d"]] = max(gaps, default=None)
    return out


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, weighted: bool = True) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component up to k."""
    scratch = Scratch(vectors.sparkSession)
    rows = integers(vectors, scale, shift)
    distinct = scratch.store(distinct_vectors(rows, weighted), "distinct")
    fits = sums(distinct)
    models, explained = {}, {}
    for r in components(distinct, fits, k, scratch).orderBy("d", "component").collect():  # k rows per length of vectors
        models.setdefault(r["d"], ([], []))[0].append(r["vector"])
        models[r["d"]][1].append(r["value"])
        explained.setdefault(r["d"], []).append(r["explained"])
    models = {d: (np.array(v).T, np.array(e)) for d, (v, e) in models.items()}
    white = scratch.store(_whitened(distinct, fits, models), "whitened")
    errors = identity_errors(white, k)

    figures = [(d, n, explained[d], errors[d]) for d, (n, _) in fits.items()]
    figures = vectors.sparkSession.createDataFrame(figures, "d int, n long, explained array<double>, identity_error double")
    total = white.agg(F.sum("copies")).first()[0] or 0
    answers = white.select("x", "copies", "d", "deviation", "z")
    often = F.col("copies") * HOT_SHARE > total
    hot, rest = F.broadcast(answers.where(often)), answers.where(~often)  # fewer than HOT_SHARE vectors
    joined = rows.join(hot, "x").unionByName(rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(rest, "x"))
    joined = joined.select("vec_id", "d", "deviation", "z").join(F.broadcast(figures), "d")  # a row per length
    return joined.select(
        "vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("z").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )
