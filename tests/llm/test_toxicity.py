import random

import numpy as np
import pytest

from tidestock.llm import toxicity as tx


def corpus(n, seed, bad=("grumbot", "vileq", "slurmo"), stem="zorg"):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in ("al", "en", "ir") for c in ("mon", "tak", "", "lu")]
    out = []
    for k in range(n):
        toxic = rng.random() < 0.15
        w = rng.choices(words, k=rng.randrange(5, 120))
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(bad) if rng.random() < 0.6 else stem + rng.choice(words)
        out.append((k, " ".join(w).capitalize(), int(toxic)))
    return out


def test_held_out_accuracy(rows):
    data = corpus(1500, 1)
    docs = rows("doc_id long, text string, toxic int, votes string", *[(d, t, 1, "x") for d, t, _ in data])
    labels = rows("doc_id long, toxic int", *[(d, y) for d, _, y in data if d % 3 != 1 and d % 5])
    got = {r.doc_id: r for r in tx.score(docs, labels).collect()}
    truth = {d: y for d, _, y in data}
    assert set(got) == set(truth) and all(0 <= r.score <= 1 for r in got.values())
    held = [d for d in truth if d % 3 == 1]
    assert sum((got[d].score >= 0.7) == truth[d] for d in held) / len(held) > 0.98
    assert sum((got[d].posterior >= 0.5) == truth[d] for d in held) / len(held) > 0.95


def test_odd_rows(rows):
    data = corpus(300, 2)
    odd = [(None, None), (None, "you grumbot"), (900, ""), (900, ""), (901, "é !!! 中文"), (902, "balmon " * 30_000)]
    docs = rows("doc_id long, text string, lang string", *[(d, t, None) for d, t in [(d, t) for d, t, _ in data] + odd])
    labels = rows("doc_id long, toxic int", *[(d, y) for d, _, y in data], (3, None), (None, 1), (900, 0), (55555, 1))
    got = tx.score(docs, labels, keep=("doc_id", "text", "lang")).collect()
    assert len(got) == 306 and len([r for r in got if r.doc_id == 900]) == 2
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1 and empty.pop() < 0.7
    assert [r.score for r in got if r.doc_id == 902][0] < 0.7
    assert tx.score(docs.limit(0), labels).count() == 0


def test_without_labels(rows):
    docs = rows("doc_id long, text string", *[(k, "you pathetic worthless idiot" if k % 7 == 0 else f"fine words {k}") for k in range(70)])
    got = {r.doc_id: r.score for r in tx.score(docs, rows("doc_id long, toxic int")).collect()}
    assert min(got[k] for k in got if k % 7 == 0) > max(got[k] for k in got if k % 7)


def test_label_model_finds_accuracies_and_the_copied_voter():
    rng = np.random.default_rng(0)
    y = rng.random(60_000) < 0.2
    right = np.array([0.9, 0.8, 0.7, 0.75])
    wrong = np.array([0.05, 0.1, 0.02, 0.2])
    votes = (rng.random((len(y), 4)) < np.where(y[:, None], right, wrong)).astype(int)
    copied = np.where(rng.random(len(y)) < 0.9, votes[:, 1], rng.random(len(y)) < 0.3)
    votes = np.column_stack([votes, copied]).astype(int)
    patterns, inverse = np.unique(votes, axis=0, return_inverse=True)
    weight = np.bincount(inverse.ravel()).astype(float)
    known = np.concatenate([np.full(len(patterns), -1), y[:400].astype(int)])
    model = tx.LabelModel(5, 0.2).fit(np.vstack([patterns, votes[:400]]), np.concatenate([weight, np.ones(400)]), known)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert np.abs(model.accuracy[:4, 1] - right).max() < 0.06 and np.abs(model.accuracy[:4, 0] - wrong).max() < 0.04
    linked = {frozenset((i, int(p))) for i, p in enumerate(model.parent) if p >= 0}
    assert frozenset((1, 4)) in linked and max(model.correlation) > 0.5


def test_sample_is_bounded_in_rows(rows):
    """One id with very many texts fills no more of the sample than others."""
    docs = rows("doc_id long, text string", *[(1, f"text {k}") for k in range(500)], *[(k, f"other {k}") for k in range(2, 40)])
    labels = rows("doc_id long, toxic int", *[(k, k % 2) for k in range(1, 40)])
    got = tx.training_sample(docs, labels, limit=10)
    assert got.count() == 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, tx.training_sample(docs.repartition(7), labels, limit=10).collect()))


def test_label_model_against_all_assignments():
    """Few voters: posteriors by summing over every assignment of classes, and tables by counting what they expect."""
    rng = np.random.default_rng(2)
    y = rng.random(400) < 0.3
    votes = (rng.random((400, 3)) < np.where(y[:, None], [0.9, 0.8, 0.7], [0.1, 0.2, 0.1])).astype(int)
    votes = np.column_stack([votes, np.where(rng.random(400) < 0.85, votes[:, 0], 1 - votes[:, 0])])
    patterns, inverse = np.unique(votes, axis=0, return_inverse=True)
    weight = np.bincount(inverse.ravel()).astype(float)
    model = tx.LabelModel(4, 0.3).fit(patterns, weight, np.full(len(patterns), -1))
    assert any(p >= 0 for p in model.parent)
    post = model.posterior(patterns)
    for p, got in zip(patterns, post):
        chance = [1 - model.prior, model.prior]
        for c in (0, 1):
            for i, parent in enumerate(model.parent):
                chance[c] *= model.tables[c][i][p[i], p[parent] if parent >= 0 else 0]
        assert got == pytest.approx(chance[1] / sum(chance), abs=1e-9)
    for c, belongs in enumerate((1 - post, post)):  # at rest, the tables are the expected shares
        for i, parent in enumerate(model.parent):
            for v in (0, 1):
                given = patterns[:, parent] == v if parent >= 0 else np.ones(len(patterns), bool)
                share = (weight * belongs * given * patterns[:, i]).sum() / (weight * belongs * given).sum()
                assert model.tables[c][i][1, v] == pytest.approx(share, abs=0.02)
    assert ((post > 0.5)[inverse.ravel()] == y).mean() > 0.85
