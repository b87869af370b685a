"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The steps are those of induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings
are sorted by inducing from their places, named, and sorted recursively by the string of names; the
whole array is then induced from the sorted LMS suffixes in one pass to the right and one to the
left. A pass handles a bucket's entries as arrays, round by round as it fills. A string of very many
names, whose buckets are too many and too small for that, is sorted by doubling.
"""

from __future__ import annotations

import numpy as np

#: Below this length suffixes are sorted one by one.
SHORT = 32
#: Letters up to which a string is sorted by inducing.
LETTERS = 1024


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last is."""
    n = len(t)
    up, apart = t[1:] > t[:-1], t[1:] != t[:-1]
    at = np.where(apart, np.arange(n - 1, dtype=np.int32), n - 1)
    decides = np.minimum.accumulate(at[::-1])[::-1]  # the next place where letters differ
    return np.append(up, True)[np.append(decides, n - 1)]


def _place(sa: np.ndarray, t: np.ndarray, entries: np.ndarray, ends: np.ndarray, up: int) -> None:
    """Append entries, in order, to their buckets: upward from ends, or downward from it."""
    if not len(entries):
        return
    chars = t[entries]
    order = chars.argsort(kind="stable")
    entries, chars = entries[order], chars[order]
    new = np.empty(len(chars) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(chars[1:], chars[:-1], out=new[1:-1])
    first = new.nonzero()[0]
    counts = first[1:] - first[:-1]
    buckets = chars[first[:-1]]
    at = ends[buckets]
    within = np.arange(len(chars), dtype=sa.dtype)
    sa[(at - up * first[:-1]).repeat(counts) + up * within] = entries
    ends[buckets] = at + up * counts


def _scan(sa: np.ndarray, t: np.ndarray, types: np.ndarray, starts: np.ndarray, ends: np.ndarray, small: bool) -> None:
    """Induce larger suffixes left to right, or smaller ones right to left.

    starts: first place of each bucket, and the length; ends: next free place for induced entries.
    """
    up = -1 if small else 1

    def give(entries: np.ndarray) -> None:
        previous = entries[entries > 0] - 1
        _place(sa, t, previous[types[previous] == small], ends, up)

    for bucket in range(len(starts) - 2, -1, -1) if small else range(len(starts) - 1):
        done = int(starts[bucket + 1]) - 1 if small else int(starts[bucket])
        while done != ends[bucket]:  # entries the bucket got so far; they may give more to itself
            till = int(ends[bucket])
            give(sa[till + 1 : done + 1][::-1] if small else sa[done:till])
            done = till
        give(sa[starts[bucket] : done + 1][::-1] if small else sa[done : starts[bucket + 1]])


def _induce(t: np.ndarray, types: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the order of the LMS suffixes."""
    sa = np.full(len(t), -1, np.int32)
    _place(sa, t, lms[::-1], starts[1:] - 1, -1)
    _scan(sa, t, types, starts, starts[:-1].copy(), small=False)
    held = np.nonzero(sa >= 0)[0]
    sa[held[types[sa[held]]]] = -1
    sa[0] = len(t) - 1
    _scan(sa, t, types, starts, starts[1:] - 1, small=True)
    return sa


def _names(t: np.ndarray, sorted_lms: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, equal for equal ones; after: where each one ends (the next LMS)."""
    a, b = sorted_lms[:-1], sorted_lms[1:]
    length = after[1:] - b
    same = np.nonzero(after[:-1] - a == length)[0]
    at = 0
    equal = np.zeros(len(a), bool)
    while len(same):
        same = same[t[a[same] + at] == t[b[same] + at]]
        ended = length[same] == at
        equal[same[ended]] = True
        same = same[~ended]
        at += 1
    return np.concatenate(([0], np.cumsum(~equal)))


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array of t: with suffixes in order by their first `known` letters, and the order of those `known`
    further on, they are in order by twice as many. Suffixes that differ from all others take no further part.
    """
    n = len(t)
    counts = np.bincount(t)
    rank = (np.cumsum(counts) - counts)[t]  # of each suffix, how many are smaller as far as is known
    live, known = (counts[t] > 1).nonzero()[0], 1
    while len(live):
        old = rank[live]
        key = old * n + rank[live + known]
        order = key.argsort()
        live, key, old = live[order], key[order], old[order]
        place = np.arange(len(live))
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        rank[live] = old + np.maximum.accumulate(np.where(new, place, 0)) - start
        live = live[~(new & np.append(new[1:], True))]
        known *= 2
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t, non-negative integers of which the last is the only smallest; under 2 ** 31 of them.

    Recursion leaves out what needs no sorting: an LMS suffix whose name is unique is in its place, and
    serves only as the end of a row of repeated names, where a comparison stops at the latest.
    """
    n = len(t)
    if n <= SHORT:
        rest = t.tolist()
        return np.array(sorted(range(n), key=lambda i: rest[i:]), np.int32)
    if int(t.max()) >= LETTERS:
        return _doubled(t)
    # Few letters fit 16 bits, which a stable sort orders by radix, and which take half the cache.
    t = t.astype(np.uint16, copy=False)
    types = suffix_types(t)
    lms = ((types[1:] & ~types[:-1]).nonzero()[0] + 1).astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(np.bincount(t))))
    sa = _induce(t, types, lms, starts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    end = np.zeros(n, np.int32)
    end[lms] = np.append(lms[1:], n - 1)
    names = _names(t, ordered, end[ordered])
    repeated = np.bincount(names)[names] > 1
    if repeated.any():
        of = np.zeros(n, np.int32)
        of[ordered] = names + 1
        again = np.zeros(n, bool)
        again[ordered] = repeated
        again = again[lms]
        kept = again | np.concatenate(([False], again[:-1]))
        _, dense = np.unique(of[lms[kept]], return_inverse=True)
        inner = suffix_array(np.append(dense + 1, 0))[1:]
        ordered[repeated] = lms[kept][inner][again[kept][inner]]
    return _induce(t, types, ordered, starts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, by position, with the one before it in the array.

    t: integers below 2 ** 16; ends: for each position the end of its string, which limits
    the prefix. Only irreducible positions are compared: elsewhere the value is one less than at the
    position before.
    """
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    position = np.arange(n, dtype=np.int32)
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (t[:-1] == t[phi[1:] - 1]) & (ends[1:] == ends[:-1])
    start = (~reducible & (phi >= 0)).nonzero()[0]
    padded = np.append(t, np.zeros(4, t.dtype)).astype(np.uint64)
    words = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    del padded
    done = np.zeros(len(start), np.int32)
    live, i, j, limit = np.arange(len(start)), start, phi[start].astype(np.int64), ends[start]
    while len(live):
        apart = words[i] ^ words[j]
        differs = apart != 0
        low = apart[differs]
        done[live[differs]] += (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 4).astype(np.int32)
        done[live[~differs]] += 4
        i, j = i + 4, j + 4
        go = ~differs & (i < limit) & (j < n)
        live, i, j, limit = live[go], i[go], j[go], limit[go]
    lcp = np.zeros(n, np.int32)
    lcp[start] = np.minimum(done, ends[start] - start)
    first = np.maximum.accumulate(np.where(reducible, 0, position))
    return np.maximum(np.where(reducible, lcp[first] - (position - first), lcp), 0)
