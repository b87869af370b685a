import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestock.llm import queries, whitening

DDL = "vec_id long, embedding array<float>, label int, x string, copies int"


def plain(rows, k=8, weighted=True):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} with exact integers and one covariance over all rows."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and v]
    out = {}
    for d in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == d]
        fit = [x for _, x in own] if weighted else [list(x) for x in {tuple(x) for _, x in own}]
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        v = y.T @ y / n
        values, vectors = np.linalg.eigh(v)
        for i, x in own:
            gap = [n * a - b for a, b in zip(x, s)]
            for c in range(min(k, d)):
                e = values[-1 - c]
                z = abs(np.dot(np.array(gap) / n, vectors[:, -1 - c]) / math.sqrt(e)) if e > 1e-9 else None
                out.setdefault((i, c + 1), []).append((n, sum(g * g for g in gap), z, e / np.trace(v) if e > 1e-9 else 0.0))
    return out


def compare(got, want):
    found = {}
    for r in got.collect():
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for key, rows in found.items():
        for r, w in zip(sorted(rows, key=lambda r: r.deviation), sorted(want[key], key=lambda w: w[1])):
            assert (r.n, r.deviation) == w[:2]
            assert r.explained == pytest.approx(w[3], rel=1e-6, abs=1e-12)
            assert (r.whitened is None) == (w[2] is None) and (w[2] is None or abs(r.whitened) == pytest.approx(w[2], rel=1e-6, abs=1e-6))
            assert r.identity_error is None or r.identity_error < 1e-6


def vectors(n=300, d=12):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((n, d)) @ np.diag(np.linspace(0.2, 1.5, d)) @ rng.standard_normal((d, d))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(m)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [rows[3], rows[3], (None, rows[5][1])]  # copies, equal rows, a null id
    return rows


def test_figures(rows):
    data = vectors() + [(2000, None), (2001, [0.5] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    df = rows(DDL, *[(i, v, 1, "clash", 2) for i, v in data]).repartition(5)
    compare(whitening.whiten(df), plain(data))
    distinct = whitening.whiten(df, k=3, weighted=False)
    assert {r.n for r in distinct.select("n").distinct().collect()} == {300}
    one = {r.whitened for r in whitening.whiten(df).where("component = 1 and (vec_id >= 1000 or vec_id = 7)").collect()}
    assert len(one) == 1  # one sign and one value for all copies


def test_identity_over_all_rows(rows):
    data = vectors()
    got = whitening.whiten(rows(DDL, *[(i, v, 1, "", 2) for i, v in data]))
    z = {}
    for k, r in enumerate(got.orderBy("component", "vec_id", "deviation").collect()):
        z.setdefault(r.component, []).append(r.whitened)
    z = np.array([z[c] for c in range(1, 9)])
    assert np.abs(np.cov(z, bias=True) - np.eye(8)).max() < 1e-9


def test_lengths_ranks_and_sizes(rows):
    data = [(k, [float(k % 3), 1.0, 2.0]) for k in range(9)] + [(20 + k, [0.25 * k, float(k * k)]) for k in range(5)] + [(40, [3.0])]
    df = rows(DDL, *[(i, v, None, None, None) for i, v in data])
    compare(whitening.whiten(df), plain(data))  # lengths apart, two components without variance, a single vector
    huge = [(k, [1e30 if k % 2 else -1e30, float(k)]) for k in range(6)]
    got = whitening.whiten(rows(DDL, *[(i, v, 1, "", 1) for i, v in huge])).collect()
    assert len(got) == 12 and {r.deviation for r in got if r.vec_id == 0} == {(6 * -(2**52) + 0) ** 2 + (6 * 0 - 15 * 1024) ** 2}
    empty = whitening.whiten(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_hot_vectors_move_no_row(rows):
    data = vectors()
    plan = whitening.whiten(rows(DDL, *[(i, v, 1, "", 2) for i, v in data])).select("vec_id")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()


def test_steps_of_addition(rows, monkeypatch):
    monkeypatch.setattr(whitening, "ADDED", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    data = vectors()
    compare(whitening.whiten(rows(DDL, *[(i, v, 1, "", 2) for i, v in data]).repartition(9)), plain(data))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    got = queries.op13_whitening(spark, path)
    assert dict(got.dtypes)["deviation"] == "bigint"
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    compare(got, plain([tuple(r) for r in table]))
