import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidestock.llm import suffix_array as s


def plain(t):
    rest = t.tolist()
    return sorted(range(len(rest)), key=lambda i: rest[i:])


@pytest.fixture(autouse=True, params=[0, 10_000])
def letters(request, monkeypatch):
    monkeypatch.setattr(s, "LETTERS", request.param)


def check(values):
    t = np.append(np.array(values, np.int64) + 1, 0)
    sa = s.suffix_array(t)
    assert sa.tolist() == plain(t)
    cut = sorted({len(t), *(i for i in range(7, len(t), 11))})
    ends = np.array([min(c for c in cut if c > i) for i in range(len(t))])
    lcp = s.permuted_lcp(t, sa, ends)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        k = 0
        while b + k < ends[b] and a + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert lcp[b] == k


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 3), max_size=400))
def test_few_letters(values):
    check(values)


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 3000), max_size=500))
def test_many_letters(values):
    check(values)


@pytest.mark.parametrize("values", [[1] * 700, [1, 2] * 400, [2, 1, 1] * 300, list(range(600)), list(range(600))[::-1], [0] * 300 + [1] + [0] * 300, [5, 1, 5, 1, 5, 0] * 90,
    # all LMS substrings differ, and the order of the others still depends on their order
    [22, 8, 14, 22, 8, 13, 12, 9, 11, 4, 21, 6, 20, 18, 23, 5, 16, 12, 10, 23, 5, 15, 20, 17, 19, 2, 11, 3, 19, 1, 21, 7]])
def test_repetitive(values):
    check(values)


@pytest.mark.parametrize("seed", range(8))
def test_words(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(97, 123, rng.integers(1, 9)).tolist() + [32] for _ in range(50)]
    check([x for k in rng.integers(0, 50, 400) for x in words[k]])


@pytest.mark.parametrize("seed", range(12))
def test_mostly_different_letters(seed):
    rng = np.random.default_rng(seed)
    check(rng.integers(0, 40 + 30 * seed, 900).tolist())


@pytest.mark.parametrize("seed", range(8))
def test_few_letters_with_many_names(seed, monkeypatch):
    monkeypatch.setattr(s, "LETTERS", 28)
    rng = np.random.default_rng(seed)
    words = [rng.integers(1, 27, rng.integers(2, 9)).tolist() + [0] for _ in range(60)]
    passage = [x for k in rng.integers(0, 60, 50) for x in words[k]]
    check([x for k in rng.integers(0, 60, 200) for x in words[k]] + passage + words[0] + passage + passage)


def test_names_are_not_sorted_one_by_one(monkeypatch):
    monkeypatch.setattr(s, "LETTERS", 1024)
    rng = np.random.default_rng(3)
    words = [rng.integers(98, 123, rng.integers(3, 9)).tolist() + [32] for _ in range(4000)]
    t = np.array([x for k in rng.integers(0, 4000, 20_000) for x in words[k]] + [0])
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = s.suffix_array(t)
    finally:
        sys.settrace(before)
    assert lines < len(t) // 5
    data = t.astype(np.uint8).tobytes()
    some = sa[::97].tolist()
    assert sorted(sa.tolist()) == list(range(len(t))) and all(data[a:] < data[b:] for a, b in zip(some, some[1:]))
