"""Exact substring deduplication with sharded suffix arrays.

A byte is removed if a string of `length` bytes covers it that also starts earlier: in a document
with a smaller doc_id, or earlier in the same one. Every window of `length` bytes is looked at.

1. Anchors. A window's anchor is the least hash of its ANCHOR-byte substrings, so equal windows have
   equal anchors. Consecutive windows of one anchor are a run; anchors are counted over all
   documents, and runs whose anchor occurs once cannot repeat and go no further.
2. Shards. The text of each remaining run goes to the shard of its anchor: every two equal windows
   meet in one shard. Runs of an anchor that occurs more than HOT times are cut into single windows,
   each keyed by a hash of all its bytes, so that no key gathers the surroundings of a passage that
   very many documents share. Equal texts are one before they are sent (the earliest is), within
   each batch, and again in the shard.
3. Suffix arrays. A shard's texts, in the order of their places, are one string; its suffix array is
   built by induced sorting, neighbours are compared by permuted common prefixes, and neighbours
   with `length` bytes in common are equal windows: all but the earliest are covered.
   A text that can share no window with the others of its anchor has nothing to compare and is left out.
4. Covered windows come back to their documents, merge into removed spans, and the rest is kept.

Order: doc_id, then a hash of the text, then the place; a null doc_id comes after all others.
Defined cases: null text is empty; texts shorter than `length` keep all their bytes; rows with equal
doc_id and text are one document and get equal answers; rows with equal doc_id and different texts
are two documents in the order above; texts are whole whatever their length; an empty table gives
an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, values
from .suffix_array import permuted_lcp, suffix_array

#: Bytes of an anchor; a power of two.
ANCHOR = 32
#: Occurrences beyond which an anchor's windows are keyed one by one. So many texts of a key, of which
#: the equal ones in a batch are one already, are part of one suffix array.
HOT = 10_000
#: Bytes of text in one suffix array, or a little more: a key's texts stay together.
SHARD_BYTES = 2 << 20
#: Distinct texts of a key up to which pairs that cannot share a window are told apart beforehand.
FEW = 8
#: Bytes of documents whose anchors are found at once, for arrays that stay in the processor's caches.
BATCH_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
NULL_ID = (1 << 63) - 1


def hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes in a row; size is a power of two."""
    h = text.astype(np.uint64) + np.uint64(1)
    power, span = _MIX, 1
    with np.errstate(over="ignore"):
        while span < size:
            h = h[:-span] * power + h[span:]
            power, span = power * power, span * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def runs(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, end, times) of the runs in documents laid end to end.

    A run's text ends length - 1 bytes after its end; times is 2 or more if the anchor's bytes stand in it
    so that two of its own windows can be equal.
    """
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 4
    every = hashes(text, ANCHOR)
    least, span, width = every, 1, length - ANCHOR + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    change = np.zeros(len(text) + 1, np.int64)  # windows that would cross the end of a document
    np.add.at(change, np.maximum(ends - length + 1, np.append(0, ends[:-1])), 1)
    np.add.at(change, ends, -1)
    inside = np.cumsum(change[:-1])[: len(least)] == 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    new[ends[ends < len(new)]] = True
    first = new.nonzero()[0]
    end = np.append(first[1:], len(least))
    good = inside[first]
    # Of equal windows in a run, the earlier one starts after an anchor the later one lacks, and the later
    # one ends with an anchor the earlier one lacks: count anchors that begin or end some window of the run.
    begins, finishes = least == every[: len(least)], least == every[width - 1 :]
    run = np.cumsum(new)
    both = np.zeros(len(least), bool)
    if len(least) >= width:
        both[width - 1 :] = begins[width - 1 :] & finishes[: 1 - width] & (run[width - 1 :] == run[: 1 - width])
    times = np.add.reduceat(begins.astype(np.int64) + finishes - both, first)
    return least[first[good]].view(np.int64), first[good], end[good], np.maximum(times[good], 1)


def portions(rows: list[tuple], size: int = BATCH_BYTES) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows whose last item is text (bytes), some at a time, with their texts laid end to end and the ends."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += len(row[-1])
        if total >= size:
            yield part, np.frombuffer(b"".join(r[-1] for r in part), np.uint8), np.cumsum([len(r[-1]) for r in part])
            part, total = [], 0
    if part:
        yield part, np.frombuffer(b"".join(r[-1] for r in part), np.uint8), np.cumsum([len(r[-1]) for r in part])


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, times): the distinct anchors of each document, and how often each occurs."""

    def run(doc, text):
        anchors, ids, times = [], [], []
        for part, joined, ends in portions(list(zip(doc, [(t or "").encode() for t in text]))):
            found, first, _, often = runs(joined, ends, length)
            which = np.searchsorted(ends, first, "right")
            order = np.lexsort((found, which))
            found, which, often = found[order], which[order], often[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (which[1:] != which[:-1])
            at = new.nonzero()[0]
            anchors.append(found[at])
            ids.append(np.array([r[0] for r in part], np.int64)[which[at]])
            times.append(np.add.reduceat(often, at) if len(at) else often)
        laid = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return {"anchor": laid(anchors), "doc": laid(ids), "times": laid(times)}

    return map_batches(docs.select("doc", "text"), run, "anchor long, doc long, times long", 4096)


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """The texts to compare, and the windows known to be covered, from (id, hash, text, found).

    found: (anchor, hot) of the document's repeated anchors. Result (key, id, hash, first, end, text):
    windows first .. end - 1 of a document with their bytes, or text null if they are covered because
    the same bytes start earlier in the batch.
    """

    def run(id, hash, text, anchors, hot):
        out: list[tuple] = []
        rows = sorted(zip(id, hash, range(len(id)), [(t or "").encode() for t in text]))
        seen: dict[bytes, tuple] = {}
        for part, joined, ends in portions(rows):
            anchor, first, end, _ = runs(joined, ends, length)
            which = np.searchsorted(ends, first, "right")
            starts, raw = np.append(0, ends[:-1]).tolist(), joined.tobytes()
            heads = [row[:2] for row in part]
            wanted = [dict(zip(anchors[row[2]], hot[row[2]])) for row in part]
            near = hashes(joined, 64).view(np.int64) if any(any(w.values()) for w in wanted) else None

            for key, w, a, b in zip(anchor.tolist(), which.tolist(), first.tolist(), end.tolist()):
                often = wanted[w].get(key)
                if often is None:
                    continue
                data, (i, h), at = raw[a : b + length - 1], heads[w], a - starts[w]
                place = (i, h, at)
                if seen.setdefault(data, place) != place:
                    out.append((key, i, h, at, at + b - a, None))
                elif not often:
                    out.append((key, i, h, at, at + b - a, data))
                else:
                    for p in range(b - a):
                        window, here = data[p : p + length], (i, h, at + p)
                        new = p + length == len(data) == length or seen.setdefault(window, here) == here
                        # 64 bytes from the start and 64 to the end are all of a window
                        out.append((int(near[a + p] ^ near[a + p + length - 64] >> 1), *here, here[2] + 1, window if new else None))
        return dict(zip(("key", "id", "hash", "first", "end", "text"), zip(*out) if out else [[]] * 6))

    of = docs.select("id", "hash", "text", F.col("found.anchor").alias("anchors"), F.col("found.hot").cast("array<int>").alias("hot"))
    return map_batches(of, run, "key long, id long, hash long, first long, end long, text binary", 4096)


def _self_repeating(text: bytes, length: int) -> bool:
    """False only if no two windows of the text can be equal."""
    shift = len(text) - length  # the last window's start: every window holds the 16 bytes from there
    if not shift:
        return False
    return len(text) > 2 * length - 16 or text.find(text[shift : shift + 16], shift + 1) >= 0


def _overlapping(a: bytes, b: bytes, length: int) -> bool:
    """False only if no window of a is one of b: every window of a text holds the bytes that its first and last share."""
    return a[len(a) - length : length] in b and b[len(b) - length : length] in a


def _distinct(rows: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """(windows known to be covered, texts to compare) among the rows (id, hash, first, text) of one key.

    Equal texts are one: the windows of the later ones are covered. A text that cannot share a window
    with another (among few) and cannot repeat itself is not compared. Texts to compare come as
    ((id, hash, first), text).
    """
    if len(rows) == 1:
        (*place, text), = rows
        return [], [(tuple(place), text)] if _self_repeating(text, length) else []
    covered, seen = [], {}
    for id, hash, first, text in sorted(rows):
        place = (id, hash, first)
        if seen.setdefault(text, place) != place:
            covered.append((*place, first + len(text) - length + 1))
    texts = list(seen)
    if len(texts) <= FEW:
        texts = [t for t in texts if _self_repeating(t, length) or any(_overlapping(t, u, length) for u in texts if u is not t)]
    return covered, [(seen[text], text) for text in texts]


def covered_windows(texts: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(id, hash, first, end) of windows that start earlier in another place, among distinct texts.

    texts: ((id, hash, first), text), where text holds the windows from `first` on.
    """
    out: list[tuple[int, int, int, int]] = []
    if not texts:
        return out
    texts = sorted(texts)
    sizes = np.array([len(t) + 1 for _, t in texts])
    ends = np.cumsum(sizes) - 1
    t = np.zeros(int(sizes.sum()) + 1, np.int32)  # 0 ends all, 1 ends a text, bytes from 2 on
    t[:-1] = np.frombuffer(b"".join(x + b"\0" for _, x in texts), np.uint8).astype(np.int32) + 2
    t[ends] = 1
    limits = np.append(np.repeat(ends, sizes), len(t) - 1).astype(np.int32)
    sa = suffix_array(t)
    alike = permuted_lcp(t, sa, limits)[sa] >= length
    group = (~alike).nonzero()[0]
    earliest = np.repeat(np.minimum.reduceat(sa, group), np.diff(np.append(group, len(sa))))
    covered = np.zeros(len(t) + 1, np.int8)
    covered[sa[sa != earliest]] = 1
    step = np.diff(covered, prepend=0)
    from_, to = (step == 1).nonzero()[0], (step == -1).nonzero()[0]
    for w, a, b in zip(np.searchsorted(ends, from_).tolist(), from_.tolist(), to.tolist()):
        id, hash, first = texts[w][0]
        at = first - int(ends[w] - sizes[w] + 1)
        out.append((id, hash, a + at, b + at))
    return out


def _compare(pieces: DataFrame, length: int) -> DataFrame:
    """(id, hash, first, end): covered windows found in the shards."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """The rows of one key after the other."""
        rows, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            every = list(zip(*[values(batch.column(i)) for i in range(1, 5)]))
            cuts = [0, *((key[1:] != key[:-1]).nonzero()[0] + 1).tolist(), len(every)]
            if rows and key[0] != last:
                yield rows
                rows = []
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield rows + every[a:b]
                rows = []
            rows += every[cuts[-2] :]
            last = key[-1]
        if rows:
            yield rows

    def send(found: list[tuple]) -> pa.RecordBatch:
        columns = np.array(found, np.int64).reshape(-1, 4).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["id", "hash", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, size = [], [], 0
        for rows in keys(batches):
            known, more = _distinct(rows, length)
            found += known
            texts += more
            size += sum(len(t) for _, t in more)
            if size >= SHARD_BYTES:
                found += covered_windows(texts, length)
                texts, size = [], 0
            if len(found) >= 50_000:
                yield send(found)
                found = []
        yield send(found + covered_windows(texts, length))

    sharded = pieces.where("text is not null").select("key", "id", "hash", "first", "text")
    sharded = sharded.repartition("key").sortWithinPartitions("key")
    return sharded.mapInArrow(run, "id long, hash long, first long, end long")


def _place_columns(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash")


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, hash, windows): the covered windows (first, end) of each document that has some; id and hash as in the order."""
    scratch = Scratch(docs.sparkSession)
    # A document is an id and a hash: rows without id, or with one id, must not share one set of anchors. Were
    # two documents to get the same doc, each would only know of anchors that it does not have.
    rows = docs.select(*_place_columns(docs), "text").withColumn("doc", F.xxhash64("id", "hash"))
    anchors = scratch.store(_anchors(rows, length), "anchors")  # counted, then dealt out to their documents
    counts = anchors.groupBy("anchor").agg(F.sum("times").alias("n")).where("n >= 2")
    repeated = scratch.store(counts.select("anchor", (F.col("n") > HOT).alias("hot")), "repeated")
    wanted = anchors.join(repeated, "anchor").groupBy("doc").agg(F.collect_set(F.struct("anchor", "hot")).alias("found"))
    wanted = scratch.store(wanted, "wanted")
    scratch.release(anchors)
    pieces = scratch.store(_pieces(rows.join(wanted, "doc"), length), "pieces")
    scratch.release(repeated, wanted)
    known = pieces.where("text is null").select("id", "hash", "first", "end")
    windows = known.unionByName(_compare(pieces, length)).groupBy("id", "hash")
    found = scratch.store(windows.agg(F.collect_list(F.struct("first", "end")).alias("windows")), "windows")
    scratch.release(pieces)
    return found


def keep(text: bytes, windows: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, removed spans) of a text with covered windows (first, end)."""
    spans: list[list[int]] = []
    for first, end in sorted(windows):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end + length - 1)
        else:
            spans.append([first, end + length - 1])
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at:first])
        at = end
    return b"".join([*kept, text[at:]]), sum(b - a for a, b in spans), len(spans)


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept: the remaining bytes."""
    return _kept(docs, length, digest=False)


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """The same with kept_sha256 for the remaining bytes."""
    return _kept(docs, length, digest=True)


def _kept(docs: DataFrame, length: int, digest: bool) -> DataFrame:
    if not ANCHOR <= 64 <= length <= 128:
        raise ValueError("windows have 64 to 128 bytes")
    found = removed_spans(docs, length)
    rows = docs.select("doc_id", *_place_columns(docs), "text").join(found, ["id", "hash"], "left").select("doc_id", "text", "windows")

    def run(doc_id, text, windows):
        data = [(t or "").encode() for t in text]
        made = [keep(d, [(w["first"], w["end"]) for w in ws or []], length) for d, ws in zip(data, windows)]
        kept = [hashlib.sha256(k).hexdigest() if digest else k for k, _, _ in made]
        return {"doc_id": doc_id, "n_bytes": list(map(len, data)), "n_removed": [n for _, n, _ in made], "n_spans": [n for _, _, n in made], last: kept}

    last = "kept_sha256" if digest else "kept"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}", 500)
