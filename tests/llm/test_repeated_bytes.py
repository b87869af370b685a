import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidestock.llm import repeated_bytes as rb


def plain(docs, length=100):
    """Every window in a dictionary of first places."""
    order = sorted({(rb.NULL_ID if d is None else d, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), t or "") for d, t in docs})
    first, kept = {}, {}
    for place, (d, _, t) in enumerate(order):
        data = t.encode()
        gone = np.zeros(len(data) + 1, int)
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], (place, p)) != (place, p):
                gone[p : p + length] = 1
        spans = int((np.diff(gone, prepend=0) == 1).sum())
        rest = bytes(b for b, g in zip(data, gone) if not g)
        kept[d, t] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return sorted([(d, *kept[rb.NULL_ID if d is None else d, t or ""]) for d, t in docs], key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Tal", "é", "mon", "bri", "zz") for b in ("ka", "lo", "stein", "", "x")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(rng.randrange(10, 60)) for _ in range(8)] + ["a" * 260, "xy" * 120, "z" * 99, "y" * 100, "w" * 101]
    docs = [(None, None), (3, ""), (4, "é" * 49), (5, "é" * 50), (6, "é" * 50), (None, passages[0]), (7, "q" * 1000), (8, "pq" * 700), (9, "pq" * 700)]
    for k in range(220):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += [text(rng.randrange(30)), rng.choice(passages)]
        if parts and rng.random() < 0.3:
            parts.append(parts[rng.randrange(len(parts))])
        docs.append((rng.choice([k, 1000 - k, 77]), "".join(parts) + rng.choice(["", " end"])))
    copy = [text(60) for _ in range(3)]
    docs += [(2000 + k, copy[k % 3]) for k in range(40)] + [docs[20]] * 3
    for k in range(40):
        w = copy[0].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((3000 + k, " ".join(w)))
    return docs


@pytest.mark.parametrize("hot, batch", [(500, 8 << 20), (3, 8 << 20), (10, 4000)])
def test_rows_against_all_windows(rows, monkeypatch, hot, batch):
    monkeypatch.setattr(rb, "HOT", hot)
    monkeypatch.setattr(rb, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(rb, "BATCH_BYTES", batch)
    docs = corpus(hot)
    want = plain(docs)
    assert sum(r > 0 for _, _, r, *_ in want) > 100 and any(s > 1 for *_, s, _ in want)
    df = rows("doc_id long, text string, id int, hash int", *[(d, t, 1, 1) for d, t in docs])
    assert sorted(map(tuple, rb.digest(df).collect()), key=str) == want


def test_windows_of_one_shard():
    rng = random.Random(1)
    made = []
    for k in range(60):
        made.append((k % 5, k, 0, 10 * k, bytes(rng.choices(b"ab", k=rng.randrange(12, 30)))))
    first, want = {}, set()
    for _, id, _, at, text in sorted(made, key=lambda r: r[1]):
        for p in range(len(text) - 11):
            if first.setdefault(text[p : p + 12], (id, p)) != (id, p):
                want.add((id, at + p))
    known, texts = rb._distinct([r[1:] for r in made], 12)
    got = {(id, p) for id, _, a, b in known + rb.covered_windows(texts, 12) for p in range(a, b)}
    assert got == want and len(want) > 20
    text = bytes(range(120))
    assert rb._distinct([(1, 0, 5, text), (0, 0, 7, text), (0, 0, 7, text)], 100) == ([(1, 0, 5, 26)], [])
    assert rb._distinct([(0, 0, 7, b"ab" * 60)], 100)[1] and rb.covered_windows([((0, 0, 7), b"ab" * 60)], 100) == [(0, 0, 9, 28)]


def test_no_rows_and_kept_bytes(rows):
    df = rows("doc_id long, text string", (1, "x" * 150), (2, "start " + "x" * 120 + " end"))
    assert rb.digest(df.limit(0)).count() == 0
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in rb.deduplicate(df).collect()}
    assert got == {1: (b"x", 149, 1), 2: (b"start  end", 120, 1)}


def test_rows_without_id_do_not_share_their_anchors(rows, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passages = [text(150) for _ in range(40)]
    docs = [(rng.choice([None, 7]), text(30) + passages[k % 40] + text(30)) for k in range(160)]
    own = lambda t: set(rb.runs(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), 100)[0].tolist())
    seen, pieces = [], rb._pieces

    def watched(found, length):
        seen.extend(found.select("text", "found").collect())
        return pieces(found, length)

    monkeypatch.setattr(rb, "_pieces", watched)
    got = sorted((tuple(r) for r in rb.digest(rows("doc_id long, text string", *docs)).collect()), key=str)
    assert got == plain(docs)
    assert len(seen) > 100 and all({f["anchor"] for f in r.found} <= own(r.text) for r in seen)


def test_numbers_are_read_as_arrays():
    """Columns of whole numbers, and lists of them, give what `to_pylist` gives, in slices and with nulls too."""
    import pyarrow as pa

    from tidestock.llm.common import values

    lists = pa.array([[1, 2], [], [3], [4, 5, 6], [7]], pa.list_(pa.int64()))
    for column in (pa.array([1, -2, 3], pa.int32()), pa.array([1, None]), pa.array(["a", None]), pa.array([], pa.int64()), lists, lists.slice(1, 3), lists.slice(4),
                   lists.slice(2, 0), pa.array([[1], None]), pa.array([[1, None], [2]]), pa.array([[True], []]), pa.array([[{"a": 1}]])):
        assert values(column) == column.to_pylist()
    assert all(type(v) is int for v in values(lists.slice(3))[0] + values(pa.array([1, 2])))


def test_anchors_are_found_once(spark, monkeypatch):
    """They are stored for the two steps that read them, and dropped before the texts are."""
    stored, kept = [], rb.Scratch.store
    monkeypatch.setattr(rb.Scratch, "store", lambda self, df, name: (stored.append(name), kept(self, df, name))[1])
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in rb.deduplicate(docs).collect()}
    assert stored[0] == "anchors" and got[2] == 300
