import collections

import public_tokenizers as P
import pytest

from tidestock.llm import byte_bpe, token_lengths as tl
from tidestock.llm.common import Scratch

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_sums_answer_every_limit(spark, rows):
    texts = [None, "", "one", "one", "two words", "a longer text of some words", "é" * 50, "x" * 201_000] + ["w " * k for k in range(1, 2600, 13)]
    docs = rows("doc_id long, text string, n_tokens int, docs int", *[(k if k % 3 else None, t, 1, 1) for k, t in enumerate(texts)])
    bpe = byte_bpe.coder(open(PATH, "rb").read(), P.PATTERN)
    lengths = [len(bpe.encode(t or "")) for t in texts]
    sums = tl.token_counts(docs, PATH, P.PATTERN)
    counts = collections.Counter(lengths)
    got = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.docs for n, r in got.items()} == dict(counts)
    for n, r in got.items():
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.share_up_to == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 7, 512, 1024, 2048, 10**9]
    cut = {r.context_limit: (r.docs_at_least, r.tokens_kept) for r in tl.truncated_totals(sums, limits).collect()}
    assert cut == {k: (sum(x >= k for x in lengths), sum(min(x, k) for x in lengths)) for k in limits}
    order = sorted(lengths)
    for r in tl.quantiles(sums, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == min(x for x in order if sum(y <= x for y in order) / len(order) >= r.share)


def test_no_rows(spark, rows):
    docs = rows("doc_id long, text string", (1, "x")).limit(0)
    sums = tl.token_counts(docs, PATH, P.PATTERN)
    assert sums.count() == 0
    assert [tuple(r) for r in tl.truncated_totals(sums, [5]).collect()] == [(5, 0, 0)]
    assert [tuple(r) for r in tl.quantiles(sums, [0.5]).collect()] == [(0.5, None)]
