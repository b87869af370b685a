import base64
import hashlib
import random
import sys

import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestock.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    data = open(PATH, "rb").read()
    own = byte_bpe.coder(data, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab 'st1é中\n\t", max_size=200), st.text("a \x1c\x85　", max_size=80)))
def test_equal_to_the_public_library(pair, text):
    own, library = pair
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_very_long_pieces(pair):
    own, library = pair
    for text in ("a" * 30_000, "ab" * 9_000, "the" * 7_000, " " * 5_000, "é" * 4_000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_the_queue_gives_rank_then_position():
    queue = byte_bpe.RankQueue(50_000)
    items = [(49_999, 3), (5, 9), (5, 2), (4_096, 1), (64, 7), (5, 4)]
    for rank, position in items:
        queue.push(rank, position)
    got = []
    while queue.top:
        rank, bucket = queue.pop_rank()
        got += [(rank, position) for position in sorted(bucket)]
    assert got == sorted(items) and not any(queue.leaf) and not queue.buckets


def test_ranks_that_do_not_grow_with_merging(pair):
    """Merges may make pairs of lower or equal rank; the public library decides what is right."""
    own, _ = pair
    tokens = [bytes([b]) for b in range(256)]
    tokens += [b"bc", b"ab", b"abc", b"aa", b"cd", b"bcd", b"aab", b"abab", b"ababab", b"ca"]
    for order in (tokens, tokens[:256] + tokens[:255:-1]):
        ranks = {t: i for i, t in enumerate(order)}
        data = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
        mine = byte_bpe.ByteBpe(data, P.PATTERN)
        library = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rng = random.Random(4)
        for _ in range(400):
            text = "".join(rng.choices("abcd", k=rng.randrange(1, 40)))
            assert mine.encode(text) == library.encode_ordinary(text)


def test_rows(spark, rows, pair):
    own, library = pair
    docs = rows(
        "doc_id long, text string, ids string, n_tokens int",
        (1, "Hello world", "x", 1), (1, "Hello world", "x", 1), (2, None, None, None), (None, "", "y", 2), (3, "é" * 999, None, 1),
    )
    got = sorted(byte_bpe.round_trip(docs, PATH, P.PATTERN).collect(), key=str)
    want = []
    for d in docs.collect():
        ids = library.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {(r.doc_id, bytes(r["bytes"]).decode()) for r in back.collect()} == {(d.doc_id, d.text or "") for d in docs.collect()}
    assert byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_pieces_leave_when_their_bytes_are_spent(pair, monkeypatch):
    """Little memory, many pieces: the ids stay right, what is met again stays longer, and the bound holds."""
    own, library = pair
    monkeypatch.setattr(byte_bpe, "NEW_BYTES", 20_000)
    monkeypatch.setattr(byte_bpe, "KNOWN_BYTES", 60_000)
    small = byte_bpe.ByteBpe(open(PATH, "rb").read(), P.PATTERN)
    rng = random.Random(9)
    often = ["".join(rng.choices("abcdeé", k=9)) for _ in range(40)]
    for _ in range(60):
        words = rng.choices(often, k=30) + ["".join(rng.choices("fghij中", k=rng.randrange(8, 90))) for _ in range(60)]
        text = " ".join(words)
        assert small.encode(text) == library.encode_ordinary(text)
    cache = small.cache
    for kept, most in ((cache.new, 20_000), (cache.known, 60_000)):
        assert kept.size <= most
        assert sum(byte_bpe.PIECE_BYTES + len(p) for g in (kept.newer, kept.older) for p in g) <= 2 * most + 20_000
    assert cache.found > cache.asked // 5 and all(f" {w}" in cache.known.newer or f" {w}" in cache.known.older for w in often)


def test_pieces_merged_together_whatever_the_order_of_ranks(pair):
    rng = random.Random(12)
    longer = sorted({bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(120)})
    for turn in range(12):
        order = [bytes([b]) for b in range(256)] + longer
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        mine = byte_bpe.ByteBpe(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()), P.PATTERN)
        library = tiktoken.Encoding("mixed", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(rng.choices("abc", k=rng.choice((1, 2, 9, 60)))) for _ in range(300)] + ["a" * 500, "ab" * 300, "abc" * 200]
        got = mine.merge([p.encode() for p in pieces])
        # The library takes a piece that is a token whole, before it merges; merging alone may end elsewhere.
        assert [byte_bpe.ids_of(g) for g, p in zip(got, pieces) if p.encode() not in ranks] == [
            library.encode_ordinary(p) for p in pieces if p.encode() not in ranks
        ]
        assert not mine.queue.top and not mine.queue.buckets and (mine.table == -1).all()


def test_a_pair_is_merged_in_all_pieces_at_once(pair):
    """Lines that Python runs, and so its time, grow with the pieces by less than by their bytes."""
    own, library = pair
    pieces = [f" {a}ing{b}tion" for a in ("st", "br", "fl", "cl") for b in range(500)]
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        got = own.merge([p.encode() for p in pieces])
    finally:
        sys.settrace(before)
    assert [byte_bpe.ids_of(g) for g in got] == [library._encode_single_piece(p) for p in pieces]
    assert lines < 4 * sum(map(len, pieces))
