import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidestock.llm import simhash_trie as sh
from tidestock.llm.common import Scratch
from tidestock.llm.graph import components


def plain(text):
    """The definition, bit by bit."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, budget):
    """Smallest member of each value's group, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints_follow_the_definition(spark):
    texts = [None, "", " \t", "One", "one two", "One two\x0bthree", "a b c d e f a b c", "Ünï\x1cx Éa b c D é", "w " * 9000]
    texts += [" ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(1, 60)]
    assert [sh.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    jvm = spark.createDataFrame([("ünï one two",)], "t string").select(F.xxhash64("t")).first()[0]
    assert jvm & (1 << 64) - 1 == sh.fingerprint("ünï one two")


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_connects_what_all_pairs_connect(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = set()
    for c in centres:
        for _ in range(rng.choice([1, 3, 80])):
            v = c
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    x = np.array(sorted(values), np.uint64)
    forest = sh.Forest(len(x))
    pairs = sh.trie_join(x, 0, 3)
    assert len(pairs) < len(x) and all((int(x[i]) ^ int(x[j])).bit_count() <= 3 for i, j in pairs)
    forest.unite(np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))
    want = groups([int(v) for v in x], 3)
    assert {int(v): int(x[forest.parent[k]]) for k, v in enumerate(x)} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (900, 5), (5, 900)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {900: 5, 5: 5}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_rows(spark, rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    data = [(None, None, "x"), (4, "", "x"), (2, " \n", "x"), (None, "only null ids", "x"), (9, "Same text", "x"), (9, "same TEXT", "x"), (8, "same text", "x")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(300)] = "changed"
            data.append((1000 + 10 * i + k, " ".join(copy), "x"))
    docs = rows("doc_id long, text string, fp string", *data)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in sh.simhash_groups(docs).collect()}
    prints = [(d, plain(t)) for d, t, _ in data]
    root = groups({p for _, p in prints}, 3)
    first = {}
    for d, p in prints:
        if d is not None:
            first[root[p]] = min(d, first.get(root[p], d))
    assert got == {(d, f"{p:016x}", first.get(root[p])) for d, p in prints}
    assert any(c != d for d, _, c in got if d and d >= 1000)
    assert sh.simhash_groups(docs.limit(0)).count() == 0


def near(rng, centre, most):
    for b in rng.sample(range(64), rng.randrange(most + 1)):
        centre ^= 1 << b
    return centre


def connected(links, values, budget=3):
    want = groups(values, budget)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links.collect():
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= budget
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == want


def frame(spark, values):
    return spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")


@pytest.mark.parametrize("block, hot", [(4096, 1 << 16), (64, 1 << 16), (4, 20)])
def test_tries_and_hot_nodes(spark, block, hot):
    """Families of any density, shallow and deep nodes, and nodes cut again: the same components."""
    rng = random.Random(block)
    values = {0, (1 << 64) - 1}
    for size in [1] * 60 + [3] * 30 + [300]:
        centre = rng.getrandbits(64)
        values |= {near(rng, centre, 4) for _ in range(size)}
    values |= {(0xABCD << 48) | near(rng, 0, 5) & (1 << 48) - 1 for _ in range(150)}  # one prefix
    values = sorted(values)
    scratch = Scratch(spark)
    connected(sh.links(frame(spark, values), scratch, 3, block, hot), values)
    nodes = sh.dealt(frame(spark, values), scratch, 3, block, hot)
    sizes = [r["count"] for r in nodes.groupBy("trie", "depth", "prefix").count().collect()]
    assert max(sizes) <= hot and (block != 4 or nodes.select("depth").distinct().count() > 1)
    connected(sh.links(frame(spark, values), scratch, 2, block, hot), values, 2)


def test_copies_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(3)
    for n in (2_000, 20_000):
        distinct = spark.createDataFrame(pd.DataFrame({"fp": np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))}))
        nodes = sh.dealt(distinct, Scratch(spark), 3, 16)
        assert nodes.count() == 4 * n
        assert max(r["count"] for r in nodes.groupBy("trie", "depth", "prefix").count().collect()) < 100
