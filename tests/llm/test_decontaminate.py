import random
import re

import pytest

from tidestock.llm import decontaminate as dc


def cut(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, n):
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain(docs, items):
    out = set()
    for d, text, *_ in docs:
        for i, item in items:
            w = cut(item)
            n = min(5, len(w))
            want = grams(w, n) if w else set()
            shared = len(want & grams(cut(text), n)) if w else 0
            if want and shared >= 0.8 * len(want) - 1e-9:
                out.add((d, i, len(want), shared))
    return out


@pytest.fixture
def tables(rows):
    rng = random.Random(8)
    vocabulary = [f"Word{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 7, 12, 40, 60]))) for i in range(60)]
    items += [(None, text(20)), (7, "another text with the same id as before"), (8, None), (9, " ... "), (10, items[10][1])]
    docs = [(None, None), (1, ""), (2, "!?"), (3, "éàü Ünï")]
    for k in range(300):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            half = len(w) // 2
            parts += [" ".join(w).upper()] if rng.random() < 0.7 else [" ".join(w[half:]), text(9), " ".join(w[:half])]
            parts.append(text(rng.randrange(20)))
        docs.append((rng.choice([k, k, 5, None]), " ".join(parts)))
    docs += docs[20:30] + [(999, text(30_000) + " " + items[20][1])]
    return docs, items, rows("doc_id long, text string, item_id int, hash int", *[(d, t, 1, 1) for d, t in docs]), rows("item_id long, text string", *items)


def test_pairs_and_clean_rows(tables, monkeypatch):
    docs, items, documents, benchmark = tables
    want = plain(docs, items)
    assert len(want) > 100 and any(s < n for _, _, n, s in want)
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in dc.contained(documents, benchmark).collect()}
    assert got == want
    monkeypatch.setattr(dc, "SMALL_ROWS", 0)
    monkeypatch.setattr(dc, "SMALL_KEYS", 0)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in dc.contained(documents, benchmark).collect()} == want
    left = sorted(((r.doc_id, r.text) for r in dc.clean(documents, benchmark).collect()), key=str)
    assert left == sorted(((d, t) for d, t in docs if not plain([(d, t)], items)), key=str)
    assert dc.clean(documents, benchmark).columns == documents.columns


def test_empty_tables(tables):
    _, _, documents, benchmark = tables
    assert dc.contained(documents.limit(0), benchmark).count() == 0
    nothing = dc.contained(documents, benchmark.limit(0))
    assert nothing.count() == 0 and nothing.columns == dc.contained(documents.limit(0), benchmark).columns
    assert dc.clean(documents, benchmark.limit(0)).count() == documents.count()
