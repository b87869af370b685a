import math

import numpy as np
import pytest

from tidestock.llm import block_join as bj


def plain(rows, cosine=0.93):
    """All pairs."""
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            ok[k] = a / np.abs(a).max()
    links = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(ok[j]) == len(ok[k])
                 and ok[k] @ ok[j] / (np.sqrt(ok[k] @ ok[k]) * np.sqrt(ok[j] @ ok[j])) >= cosine] for k in ok}
    out = []
    for k, (vec_id, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids) if ids else None
        out.append((vec_id, len(links.get(k, [])), root, vec_id == root))
    return sorted(out, key=str)


def data(d, seed, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.standard_normal(d)
        rows.append((len(rows), v, int(rng.integers(3))))
        for _ in range(int(rng.integers(4))):
            near = v / np.linalg.norm(v) + rng.standard_normal(d) / math.sqrt(d) * rng.choice([0.0, 0.05, 0.25, 0.38, 0.42])
            rows.append((len(rows), near * rng.choice([1.0, 1e-3, 50.0]), rows[-1][2] if rng.random() < 0.9 else 0))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    return [(i, v, label) for (_, v, label), i in zip(rows, rng.permutation(len(rows)).tolist())]


@pytest.mark.parametrize("d", [64, 5, 1])
def test_rows_against_all_pairs(rows, d, monkeypatch):
    made = data(d, d, 260 if d > 5 else 60)
    if d == 64:
        nan, inf = float("nan"), float("inf")
        made += [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [nan] + [1.0] * 63, 1), (9004, [inf] * 64, 1), (9005, [None] * 64, 1), (9006, [], 1),
                 (9007, made[0][1], None), (None, made[0][1], made[0][2]), (None, None, 1), (9010, [1.0, 2.0], 1), (9011, [2.0, 4.0], 1), (9011, [2.0, 4.0], 1),
                 (9012, [-0.0, 1.0], 2), (9013, [0.0, 1.0], 2)] + [(9100 + k, made[5][1], made[5][2]) for k in range(50)]
    df = rows("vec_id long, embedding array<float>, label int, rep long, n_links int", *[(*r, 1, 1) for r in made])
    want = plain(made)
    assert sorted(map(tuple, bj.near_duplicates(df).collect()), key=str) == want
    if d == 64:
        assert sum(n > 0 for _, n, *_ in want) > 150
        monkeypatch.setattr(bj, "TILE", 7)
        assert sorted(map(tuple, bj.near_duplicates(df).collect()), key=str) == want
        assert bj.near_duplicates(df.limit(0)).count() == 0


def test_blocks_share_the_budget():
    for d in (64, 30, 5, 1):
        parts = bj.cuts(d)
        assert parts[0][0] == 0 and parts[-1][1] == d and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert sum(bj.budget(d, p, 0.93) for p in parts) >= 0.14
        r = bj.rotation(d)
        assert np.allclose(r @ r.T, np.eye(d))


def test_query_against_sql(spark):
    import duckdb

    from tidestock.llm import queries

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op7_block_join"])
    found = queries.op7_block_join(spark, path)
    assert found.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
