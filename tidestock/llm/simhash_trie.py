"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Fingerprints: lower-cased A-Z, words `[^\\x20\\x09-\\x0D]+`, shingles of three words with repeats,
joined by one space; fewer words make one shingle, none the fingerprint zero. A bit is set if it is
set in more than half of the shingles' XXH64 (UTF-8, seed 42).

Join: pairs of trie nodes of equal depth go down together, bit by bit. A pair whose paths differ in
more bits than allowed is dropped with everything below; small pairs of nodes are compared leaf by
leaf. Distinct fingerprints only take part. Within a task a pair of nodes whose fingerprints are known to be connected
already is skipped, and only links that connect something new leave it: a dense group of near copies
gives as many links as fingerprints, and no reachable pair is lost.

Partitioning: with k bits allowed, the 64 bits are cut into k + 1 blocks, and there are k + 1 tries,
each with another block on top. Two fingerprints within k bits agree in one block at least, so in that block's
trie they are below one node, and no pair of different nodes needs to be followed there. So a
fingerprint is in k + 1 tasks, however large the table; the depth of the nodes that are tasks follows
from the number of fingerprints. A node that is still hot at its whole block is cut again: the
same is done with the bits below it, for its fingerprints alone, until no node is hot.

Defined cases: null text counts as empty; empty texts share the fingerprint zero and link like any
other; a null doc_id gets a fingerprint and the component of its group, but names none (a group
with only null ids has a null component); repeated rows stay; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches
from .graph import components

SEED = 42
#: Aim for the mean number of fingerprints below one node; the depth of the nodes follows from it.
BLOCK = 4096
#: A node is hot with more fingerprints than HOT, and with more than one in HOT_SHARE of those dealt out.
HOT, HOT_SHARE = 1 << 16, 10_000
#: Node pairs handled at once, and the product of node sizes from which leaves are compared.
CHUNK, LEAF = 1 << 16, 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64
    )


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits, highest first, that are set in more than half of the hashes; none of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones > len(hashes)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash."""
    return int(np.packbits(majority(shingle_hashes(text, words))).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """`keep` columns and fp, the fingerprint as a signed long."""

    def run(**columns):
        texts = columns.pop("fp_input")
        return columns | {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, docs["text"].alias("fp_input")), run, f"{kinds}fp long")


class Forest:
    """Union-find over positions, with labels that numpy can read."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Connects pairs; positions in i and j of those that connected something new."""
        new, parent = [], self.parent
        a, b = parent[i], parent[j]
        for at in np.nonzero(a != b)[0].tolist():
            x, y = int(a[at]), int(b[at])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                new.append(at)
        if new:
            while (parent != (up := parent[parent])).any():
                parent[:] = up
        return new


def _near_in_order(x: np.ndarray, budget: int, forest: Forest) -> list[tuple[int, int]]:
    """Connects neighbours in the order of the bits, and of the bits rotated, that are close enough."""
    out = []
    for turn in (0, 16, 32, 48):
        order = np.argsort(x << np.uint64(turn) | x >> np.uint64(64 - turn), kind="stable") if turn else np.arange(len(x))
        close = np.bitwise_count(x[order[:-1]] ^ x[order[1:]]) <= budget
        i, j = order[:-1][close], order[1:][close]
        out += [(int(i[k]), int(j[k])) for k in forest.unite(i, j)]
    return out


def trie_join(x: np.ndarray, depth: int, budget: int) -> list[tuple[int, int]]:
    """Connecting pairs of positions of x within `budget` bits.

    x: distinct fingerprints in ascending order that share `depth` leading bits.
    """
    n, out = len(x), []
    if n < 2:
        return out
    forest = Forest(n)
    out += _near_in_order(x, budget, forest)
    stack = [(depth, np.array([[0], [n], [0], [n], [0]], np.int64))]
    while stack:
        d, nodes = stack.pop()
        if nodes.shape[1] > CHUNK:
            stack.append((d, nodes[:, CHUNK:]))
            nodes = nodes[:, :CHUNK]
        label = forest.parent
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        alo, ahi, blo, bhi, _ = nodes
        one = (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1]) & (label[alo] == label[blo])
        nodes = nodes[:, ~one]
        alo, ahi, blo, bhi, err = nodes
        small = (ahi - alo) * (bhi - blo) <= LEAF
        if small.any():
            i, j = _leaves(*nodes[:4, small])
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            i, j = i[near], j[near]
            out += [(int(i[k]), int(j[k])) for k in forest.unite(i, j)]
            alo, ahi, blo, bhi, err = nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        bit = np.uint64(1 << (63 - d))
        low = np.uint64((1 << (64 - d)) - 1)
        amid = np.searchsorted(x, x[alo] & ~low | bit)
        bmid = np.searchsorted(x, x[blo] & ~low | bit)
        cross = np.where(alo == blo, budget + 1, err + 1)  # within one node, one of its two mixed pairs is enough
        children = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, err]), np.stack([amid, ahi, bmid, bhi, err]),
                np.stack([alo, amid, bmid, bhi, err + 1]), np.stack([amid, ahi, blo, bmid, cross]),
            ],
            axis=1,
        )
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)]
        if children.shape[1]:
            stack.append((d + 1, children))
    return out


def _leaves(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves below pairs of nodes, each pair of one node once."""
    nb = bhi - blo
    count = (ahi - alo) * nb
    which = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    i, j = alo[which] + at // nb[which], blo[which] + at % nb[which]
    keep = (alo[which] != blo[which]) | (i < j)
    return i[keep], j[keep]


def _block_first(y: Column, above: int, block: int, width: int) -> Column:
    """y with a block of the bits below the first `above` ones turned to their front."""
    if not block:
        return y
    below, turn = 64 - above, block * width
    mask = (1 << below) - 1
    rest = y.bitwiseAND(F.lit(mask if above else -1))
    moved = F.shiftleft(rest, turn).bitwiseOR(F.shiftrightunsigned(rest, below - turn))
    return moved if not above else y.bitwiseAND(F.lit(~mask)).bitwiseOR(moved.bitwiseAND(F.lit(mask)))


def dealt(distinct: DataFrame, scratch: Scratch, budget: int = 3, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(trie, depth, prefix, y, fp): the nodes each fingerprint is below, one task each.

    distinct: distinct rows of fp. y: its bits in the order of the trie; prefix: the first `depth` of them.
    """
    count, blocks = distinct.count(), budget + 1
    above, width = 0, 64 // blocks
    depth = min(width, max(0, math.ceil(math.log2(max(1, count) / block))))
    rows, parts = distinct.select(F.lit(0).alias("trie"), F.col("fp").alias("y"), "fp"), []
    while True:
        # A single node needs no other tries: it holds all pairs.
        tries = range(blocks if depth > above else 1)
        choices = F.array(*[
            F.struct((F.col("trie") * (blocks + 1) + k + 1).alias("trie"), _block_first(F.col("y"), above, k, width).alias("y")) for k in tries
        ])
        rows = rows.select("fp", F.explode(choices).alias("to")).select("to.*", "fp")
        while True:
            prefix = F.shiftrightunsigned("y", 64 - depth) if depth else F.lit(0).cast("long")
            rows = rows.select("trie", F.lit(depth).alias("depth"), prefix.alias("prefix"), "y", "fp")
            sizes = scratch.store(rows.groupBy("trie", "prefix").agg(F.count("*").alias("n")), "nodes")
            total = sizes.agg(F.sum("n")).first()[0] or 0
            over = sizes.where((F.col("n") > hot) & (F.col("n") * HOT_SHARE > total)).select("trie", "prefix")
            if over.isEmpty():
                return functools.reduce(DataFrame.unionByName, parts, rows)
            over = F.broadcast(over)  # fewer than HOT_SHARE nodes
            parts.append(rows.join(over, ["trie", "prefix"], "left_anti"))
            rows = scratch.store(rows.join(over, ["trie", "prefix"], "left_semi"), "hot")
            if depth == above + width:
                break
            depth = above + width
        above, width = depth, (64 - depth) // blocks
        depth = above + width


def links(distinct: DataFrame, scratch: Scratch, budget: int = 3, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all fingerprints within `budget` bits of each other, from distinct rows of fp."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y, fp = group["y"].to_numpy().view(np.uint64), group["fp"].to_numpy()
        order = np.argsort(y, kind="stable")
        found = np.array(trie_join(y[order], int(group["depth"].iloc[0]), budget), np.int64).reshape(-1, 2)
        pairs = fp[order][found]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    nodes = dealt(distinct, scratch, budget, block, hot)
    return nodes.groupBy("trie", "depth", "prefix").applyInPandas(run, "a long, b long")


def near_duplicates(prints: DataFrame, scratch: Scratch, budget: int = 3) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of prints (doc_id, fp).

    root: the group's smallest fingerprint; component_id: its smallest doc_id.
    """
    distinct = scratch.store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(links(distinct.select("fp"), scratch, budget), scratch)
    rooted = scratch.store(
        distinct.join(groups, distinct["fp"] == groups["node"], "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"),
        "rooted",
    )
    smallest = scratch.store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return scratch.store(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "groups")


def simhash_groups(docs: DataFrame, budget: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.store(fingerprints(docs, words=words), "prints")
    groups = near_duplicates(prints, scratch, budget)
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
