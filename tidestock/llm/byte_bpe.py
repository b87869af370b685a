"""Byte-level BPE with a hierarchical-bitmap rank queue.

The vocabulary is a rank file: one line per token, base64 of its bytes and its rank, which is also
its id. A text is split by a pattern; each match is merged on its own, always at the pair of lowest
rank, leftmost first. Merging keeps a linked list of symbols and one bucket of list positions per
rank. A bitmap of three levels says which buckets hold something; find-first-set walks it to the
next rank. Entries of pairs that have changed since stay in their buckets and are skipped when met.
Split pieces that are new are merged together in one queue, and the positions of a bucket together as
arrays, so the cost of a step is spread over all pieces that have its pair; a very long match costs time
in proportion to its bytes (and the sorting of a bucket's positions).

Defined cases: a null text is the empty text and has no ids; texts are whole, whatever their
length; repeated rows and null doc_ids are encoded like any other row; an empty table gives an
empty result; further columns of the input are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import map_batches

#: Memory of split pieces and their ids per Python worker: bytes of new pieces, and of pieces that were
#: met again. Of each there are two generations; when the newer is full, the older goes.
NEW_BYTES, KNOWN_BYTES = 12 << 20, 30 << 20
#: What a piece takes besides its bytes and ids: two objects and a place in a table.
PIECE_BYTES = 200
#: Bytes of pieces merged in one queue; a longer piece has a queue to itself.
QUEUE_BYTES = 1 << 20
#: Texts encoded at once: so many, or fewer with so many code points. The more, the more of a bucket is merged together.
TEXTS, CODE_POINTS = 512, 1 << 21


class RankQueue:
    """Positions by rank, lowest rank first.

    Two levels of bitmap words, each as wide as the square root of the number of ranks: a bit of a
    leaf word stands for a bucket that holds something, a bit of the top word for a leaf word.
    """

    def __init__(self, size: int):
        self.shift = max(1, ((size - 1).bit_length() + 1) // 2)
        self.leaf = [0] * ((size >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        self.put(rank, [position])

    def put(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        word = rank >> self.shift
        self.leaf[word] |= 1 << (rank & (1 << self.shift) - 1)
        self.top |= 1 << word

    def pop_rank(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its positions, in any order; the bucket leaves the queue."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.leaf[word]
        rank = word << self.shift | (bits & -bits).bit_length() - 1
        self.leaf[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def ids_of(packed: bytes) -> list[int]:
    return array("I", packed).tolist()


class Generations:
    """Packed ids by piece, in two generations of at most `most` bytes each."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def add(self, pieces: dict[str, bytes]) -> None:
        for piece, packed in pieces.items():
            cost = PIECE_BYTES + len(piece) * (1 if piece.isascii() else 2) + len(packed)
            if cost > self.most >> 6:
                continue  # a very long piece is not kept
            self.size += cost
            self.newer[piece] = packed
            if self.size >= self.most:
                self.older, self.newer, self.size = self.newer, {}, 0


class Pieces:
    """Pieces met before: those met once leave sooner than those met again."""

    def __init__(self):
        self.new, self.known = Generations(NEW_BYTES), Generations(KNOWN_BYTES)
        self.asked = self.found = 0

    def find(self, pieces: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the pieces that are at hand, and the other pieces."""
        first = self.known.newer
        found = {p: first[p] for p in pieces & first.keys()}
        again, missing = {}, []
        others = [t for t in (self.known.older, self.new.newer, self.new.older) if t]
        for piece in pieces.difference(found):
            for table in others:
                if piece in table:
                    again[piece] = table[piece]
                    break
            else:
                missing.append(piece)
        self.asked += len(pieces)
        self.found += len(pieces) - len(missing)
        self.known.add(again)
        found.update(again)
        return found, missing

    def add(self, pieces: dict[str, bytes]) -> None:
        self.new.add(pieces)


class ByteBpe:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = read_ranks(rank_file)
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.tokens = np.full(size, b"", object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(size)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = []  # (left id, right id, id of both together)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left, right, rank))
        left, right, both = np.array(found, np.int32).reshape(-1, 3).T
        self.letter_pairs = np.full((256, 256), -1, np.int32)
        letter = np.full(size, -1, np.int32)
        letter[self.bytes] = np.arange(256)
        short = (letter[left] >= 0) & (letter[right] >= 0)
        self.letter_pairs[letter[left[short]], letter[right[short]]] = both[short]
        # Pairs by their left id, and by their right id; `table` is for looking up those of one id.
        order, back = left.argsort(kind="stable"), right.argsort(kind="stable")
        self.rights, self.of_rights, self.right_ends = right[order], both[order], left[order].searchsorted(np.arange(size + 1)).tolist()
        self.lefts, self.of_lefts, self.left_ends = left[back], both[back], right[back].searchsorted(np.arange(size + 1)).tolist()
        self.table = np.full(size + 1, -1, np.int32)
        early = np.zeros(size, bool)  # ids with a pair that ranks no later than they do
        early[left[both <= left]] = early[right[both <= right]] = True
        self.early = early.tolist()
        self.cache = Pieces()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of split pieces (packed, see `ids_of`), all in one queue: a bucket holds positions of every piece.

        The positions of a bucket are merged together, as arrays. Pieces are chained one after the
        other without links between them; index n stands for "no neighbour" and pairs with nothing.
        """
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        n, size = len(letters), len(self.tokens)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.append(0, ends[:-1])
        ids = np.append(self.bytes[letters], np.int32(size))
        pair = np.full(n + 1, -1, np.int32)
        pair[: n - 1] = self.letter_pairs[letters[:-1], letters[1:]]
        pair[ends - 1] = -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = before[starts] = n
        queue = self.queue
        buckets, put, table = queue.buckets, queue.put, self.table
        order = pair.argsort(kind="stable")
        ranks, first = np.unique(pair[order], return_index=True)
        for rank, a, b in zip(ranks.tolist(), first.tolist(), [*first[1:].tolist(), n + 1]):
            if rank >= 0:
                put(rank, order[a:b].tolist())
        while queue.top:
            rank, bucket = queue.pop_rank()
            i = np.array(bucket, np.int32)
            i = i[pair[i] == rank]  # without pairs that have changed since
            if not len(i):
                continue
            i.sort()
            gone = after[i]
            if len(i) > 1 and (gone[:-1] == i[1:]).any():  # of pairs in a row that overlap, every other one
                at = np.arange(len(i))
                i = i[(at - np.maximum.accumulate(np.where(np.append(True, gone[:-1] != i[1:]), at, 0))) % 2 == 0]
                gone = after[i]
            (rights, of_right), (lefts, of_left) = self.beside(rank)
            if self.early[rank]:
                # A merge may make a pair of this rank or a lower one, which is then the next in its piece.
                table[rights] = of_right
                one = table[ids[after[gone]]]
                table[rights] = -1
                table[lefts] = of_left
                left = ids[before[i]]
                left[1:][before[i[1:]] == gone[:-1]] = rank
                two = table[left]
                table[lefts] = -1
                due = (one >= 0) & (one <= rank) | (two >= 0) & (two <= rank)
                if due.any():
                    of, earlier = starts.searchsorted(i, "right"), np.cumsum(due) - due
                    now = earlier == earlier[of.searchsorted(of)]  # up to the first such merge of a piece
                    put(rank, bucket)  # those merged now are skipped when met again
                    i, gone = i[now], gone[now]
            right = after[gone]
            ids[i] = rank
            ids[gone] = pair[gone] = -1
            after[i] = right
            before[right] = i
            left = before[i]
            table[rights] = of_right
            one = table[ids[right]]
            table[rights] = -1
            table[lefts] = of_left
            two = table[ids[left]]
            table[lefts] = -1
            pair[i] = one
            pair[left] = two
            two[1:][left[1:] == i[:-1]] = -1  # is in `one`
            made, also = one >= 0, two >= 0
            for position, rank in zip(
                i[made].tolist() + left[also].tolist(), one[made].tolist() + two[also].tolist()
            ):
                if rank in buckets:
                    buckets[rank].append(position)
                else:
                    put(rank, [position])
        ids = ids[:n]
        whole = ids >= 0
        cuts = [0, *(4 * np.cumsum(whole)[ends - 1]).tolist()]
        packed = ids[whole].tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def beside(self, rank: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(neighbour, id of both together) of the ids that pair with `rank` on its right, and on its left."""
        a, b = self.right_ends[rank : rank + 2]
        c, d = self.left_ends[rank : rank + 2]
        return (self.rights[a:b], self.of_rights[a:b]), (self.lefts[c:d], self.of_lefts[c:d])

    def learn(self, pieces: Iterable[str], known: dict[str, bytes]) -> None:
        """Add the packed ids of pieces to `known`, many pieces to a queue."""
        whole, rest = self.ranks.get, []
        for piece in pieces:
            data = piece.encode()
            rank = whole(data)
            if rank is None:
                rest.append((piece, data))
            else:
                known[piece] = array("I", [rank]).tobytes()
        start, size = 0, 0
        for stop, (_, data) in enumerate(rest, 1):
            size += len(data)
            if size >= QUEUE_BYTES or stop == len(rest):
                part = rest[start:stop]
                known.update(zip((p for p, _ in part), self.merge([d for _, d in part])))
                start, size = stop, 0

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        seen: dict[str, str] = {}  # one object a piece, however often it occurs
        split = [list(map(seen.setdefault, pieces, pieces)) for pieces in map(self.split, texts)]
        known, missing = self.cache.find(set(seen))
        new: dict[str, bytes] = {}
        self.learn(missing, new)
        known.update(new)
        of = known.__getitem__
        out = [b"".join(map(of, pieces)) for pieces in split]
        self.cache.add(new)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return list(map(ids_of, self.encode_packed(texts)))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(self.tokens[np.asarray(ids, np.int64)].tolist())


_coders: dict[tuple[bytes, str], ByteBpe] = {}


def coder(rank_file: bytes, pattern: str) -> ByteBpe:
    """One coder per Python worker and vocabulary; it keeps its pieces between batches."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _coders:
        _coders[key] = ByteBpe(rank_file, pattern)
    return _coders[key]


def portions(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, null as empty, a bounded number (and length, but for single long ones) at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if len(part) >= TEXTS or size >= CODE_POINTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def rank_file(df: DataFrame, path: str) -> Broadcast:
    """The rank file, read by the driver and sent out once; a vocabulary, it does not grow with the data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row; further columns are left out."""
    ranks = rank_file(docs, path)

    def run(key, text):
        bpe = coder(ranks.value, pattern)
        return {"key": key, "ids": [ids for part in portions(text) for ids in bpe.encode_all(part)]}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_batches(rows, run, f"key {kind}, ids array<int>", 2 * TEXTS).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) of (key, ids); null ids decode to no bytes."""
    ranks = rank_file(rows, path)

    def run(key, ids):
        bpe = coder(ranks.value, pattern)
        return {"key": key, "bytes": [bpe.decode(x or []) for x in ids]}

    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(rows[key].alias("key"), rows[ids].alias("ids"))
    return map_batches(plain, run, f"key {kind}, bytes binary", 2 * TEXTS).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

    One pass: each text is encoded, its ids are decoded again, and only digests leave the worker.
    """
    ranks = rank_file(docs, path)

    own = "text" if "text" in keep else "bpe_input"  # the text is sent once

    def run(**columns):
        texts = columns[own] if own in keep else columns.pop(own)
        bpe = coder(ranks.value, pattern)
        names = numbers(len(bpe.tokens))
        counts, sent, back = [], [], []
        for part in portions(texts):
            for packed in bpe.encode_packed(part):
                ids = np.frombuffer(packed, np.uint32)
                counts.append(len(ids))
                sent.append(hashlib.sha256(",".join(names[ids].tolist()).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return columns | {"n_tokens": counts, "ids_sha256": sent, "decoded_sha256": back}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep) if own in keep else docs.select(*keep, docs["text"].alias(own))
    return map_batches(rows, run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string", 2 * TEXTS)


@functools.cache
def numbers(size: int) -> np.ndarray:
    """Decimal forms of 0 .. size - 1."""
    return np.array([str(i) for i in range(size)], object)
