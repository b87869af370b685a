"""Secret scans with built-in expressions only: fixed patterns, and sliding-window entropy.

Base spans come from three fixed patterns, leftmost and non-overlapping per kind; matches that are
too short are dropped after matching. Entropy spans come from candidate strings per character
class: a window slides over the candidate, and the counts of its characters are carried along,
changed by the one character that enters and the one that leaves; so is the sum of c * log2(c) over the counts, in
whole numbers of 2**-40, which no order of steps can change. The window's Shannon entropy is log2(width) - sum / width.
A candidate with a window that reaches the class's threshold is reported, unless a base span overlaps it; a span of an
earlier class hides an overlapping one of a later class. Windows that touch a piece on the allow-list (leftmost pieces,
in the order of the list) do not count; candidates that are allowed as a whole are not looked at.

Every step costs the same, however long a text, a candidate or the list of matches is: positions are running sums,
overlaps are running maxima over sorted spans from both ends, no list is carried from step to step,
and text is cut at byte offsets. Characters of a candidate are split once.

Positions count code points, ends are exclusive. Regex splits give the text between matches, so
positions are sums of lengths and nothing leaves the JVM.

Defined cases: null text has no spans (and stays null when redacted); empty texts have none;
repeated rows and null ids are scanned like others; texts are scanned whole; an empty table gives
an empty result; other columns pass through, but a column named spans gives way to the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of the kinds, and the shortest length that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more is one match; shorter runs fail either way
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))

HEX_DIGITS = "0123456789ABCDEFabcdef"
TOKEN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="

#: Character classes of candidates: kind, pattern, window, entropy in bits from which a window counts, characters.
#: A candidate stands alone: no letter or digit touches it.
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", 20, 3.0, HEX_DIGITS),
    ("entropy_token", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", 24, 3.9, TOKEN),
)

# Candidates that are no secrets as a whole (words and paths without digits, figures without
# letters, UUIDs), and pieces that no secret holds (runs of the alphabet or the digits, placeholders; in either case).
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
ALLOW_PIECES = ("abcdefgh", "01234567", "12345678", "placeholder", "changeme", "example", "sample", "dummy", "xxxx", "0000")

#: Stands for a character of an allowed piece; in no class.
MASK = "!"
#: Parts of a bit that sums of c * log2(c) count in.
FINE = 1 << 40
#: Running sums go over blocks of 2 ** BLOCK_BITS items.
BLOCK_BITS = 6

MARK = "[SECRET]"

SPAN = "struct<start:int,kind:int,end:int,from:int,to:int>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For every item of an array that is not empty, the values of all items before it, combined from `zero` on.

    Totals of blocks, and of blocks of blocks, are combined first, so an item looks at its own block only. An
    aggregate copies its state at every step; the states here are single values, never lists.
    """

    def prefixes(values: Column, levels: int) -> Column:
        def combined(first: Column, end: Column, start: Column) -> Column:
            known = lambda so_far, j: F.when(j < end, combine(so_far, F.get(values, j))).otherwise(so_far)
            return F.aggregate(F.sequence(first, end), start, known)

        last = F.size(values) - 1
        places = F.sequence(F.lit(0), last)
        if not levels:
            return F.transform(places, lambda i: combined(F.lit(0), i, zero))
        block = lambda i: F.shiftright(i, BLOCK_BITS)
        first = lambda b: F.shiftleft(b, BLOCK_BITS)
        totals = F.transform(F.sequence(F.lit(0), block(last)), lambda b: combined(first(b), F.least(first(b + 1), last + 1), zero))
        within = lambda offsets: F.transform(places, lambda i: combined(first(block(i)), i, F.get(offsets, block(i))))
        return bound(bound(totals, lambda t: prefixes(t, levels - 1)), within)

    return bound(F.transform(items, value), lambda values: prefixes(values, 2))


def _array_of(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches with what was hit, from the pieces between matches; from and to count bytes."""
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("hit")))
    place = lambda chars, size: F.struct(chars.alias("chars"), size.alias("bytes"))
    both = lambda pair: place(F.length(pair["piece"]) + F.length(pair["hit"]), F.octet_length(pair["piece"]) + F.octet_length(pair["hit"]))

    def span(pair: Column, at: Column) -> Column:
        start, low = at["chars"] + F.length(pair["piece"]), at["bytes"] + F.octet_length(pair["piece"])
        values = (start, F.lit(kind), start + F.length(pair["hit"]), low, low + F.octet_length(pair["hit"]), pair["hit"])
        return F.struct(*[v.alias(n) for n, v in zip(("start", "kind", "end", "from", "to", "hit"), values)])

    def placed(pairs: Column) -> Column:
        add = lambda a, b: place(a["chars"] + b["chars"], a["bytes"] + b["bytes"])
        return F.zip_with(pairs, before(pairs, both, add, place(F.lit(0), F.lit(0))), span)

    return F.when(F.size(matches) > 0, bound(pairs, placed)).otherwise(_array_of(SPAN[:-1] + ",hit:string>"))


def _plain(spans: Column) -> Column:
    """Spans without what was hit."""
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "kind", "end", "from", "to")]))


def least_sum(candidate: Column, width: int, alphabet: str) -> Column:
    """Least sum of c * log2(c), in 1 / FINE, over the counts c of any window; null if no window counts.

    Windows with a character that is not in the alphabet do not count.
    """
    numbers = F.array(*[F.lit(alphabet.find(chr(c))) for c in range(128)])
    parts = F.array(*[F.lit(round(c * math.log2(c) * FINE) if c else 0).cast("long") for c in range(width + 1)])
    none = F.array_repeat(F.lit(0), len(alphabet))

    def over(codes: Column) -> Column:
        def moved(state: Column, i: Column) -> Column:
            moves = F.struct(F.get(codes, i).alias("enters"), F.when(state["run"] == width, F.get(codes, i - width)).otherwise(-1).alias("leaves"))

            def changed(move: Column) -> Column:
                enters, leaves = move["enters"], move["leaves"]
                gone, before = F.get(state["counts"], leaves), F.get(state["counts"], enters) - (enters == leaves).cast("int")
                less = F.when(leaves >= 0, F.get(parts, gone) - F.get(parts, gone - 1)).otherwise(0)
                counts = F.transform(state["counts"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
                total = state["sum"] - less + F.get(parts, before + 1) - F.get(parts, before)
                run = F.least(state["run"] + 1, F.lit(width))
                new = F.struct(counts.alias("counts"), total.alias("sum"), run.alias("run"))
                return F.when(enters >= 0, new).otherwise(F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("run")))

            return bound(bound(moves, changed), lambda new: F.struct(
                new["counts"].alias("counts"), new["sum"].alias("sum"), new["run"].alias("run"),
                F.when(new["run"] == width, F.least(state["least"], new["sum"])).otherwise(state["least"]).alias("least"),
            ))

        start = F.struct(
            none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("run"), F.lit(None).cast("long").alias("least")
        )
        last = F.size(codes) - 1
        return F.when(last >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, moved, lambda state: state["least"]))

    return bound(F.transform(F.split(candidate, ""), lambda c: F.get(numbers, F.ascii(c))), over)


def window_entropy(candidate: Column, width: int, alphabet: str = TOKEN) -> Column:
    """Highest Shannon entropy, in bits, of any window of `width` characters; null if there is none."""
    return F.lit(math.log2(width)) - least_sum(candidate, width, alphabet) / (width * FINE)


def _masked(candidate: Column) -> Column:
    """The candidate with every allowed piece blanked out."""
    for piece in ALLOW_PIECES:
        candidate = F.regexp_replace(candidate, f"(?i){piece}", MASK * len(piece))
    return candidate


def _random_enough(width: int, bits: float, alphabet: str) -> Callable[[Column], Column]:
    most = math.floor((math.log2(width) - bits) * width * FINE)

    def good(span: Column) -> Column:
        known = F.lit(False)
        for pattern in ALLOW:
            known = known | span["hit"].rlike(pattern)
        return ~known & F.coalesce(least_sum(_masked(span["hit"]), width, alphabet) <= most, F.lit(False))

    return good


def _clear_of(taken: Column, spans: Column) -> Column:
    """The spans that no taken span overlaps."""
    def tagged(spans: Column, tag: int) -> Column:
        hit = lambda s: s["hit"] if tag else F.lit(None).cast("string")
        columns = lambda s: (s["start"], F.lit(tag).alias("tag"), s["end"], s["kind"], s["from"], s["to"], hit(s).alias("hit"))
        return F.transform(spans, lambda s: F.struct(*columns(s)))

    def clear(both: Column) -> Column:
        far = F.lit((1 << 31) - 1)
        # How far the taken spans before reach, and where the next taken span starts.
        reach = before(both, lambda s: F.when(s["tag"] == 0, s["end"]).otherwise(-1), lambda a, b: F.greatest(a, b), F.lit(-1))
        starts = before(F.reverse(both), lambda s: F.when(s["tag"] == 0, s["start"]).otherwise(far), lambda a, b: F.least(a, b), far)
        around = F.zip_with(reach, F.reverse(starts), lambda r, n: F.struct(r.alias("reach"), n.alias("next")))
        found = F.zip_with(both, around, lambda s, a: F.when((s["tag"] == 1) & (a["reach"] <= s["start"]) & (a["next"] >= s["end"]), s))
        return F.filter(found, lambda s: s.isNotNull())

    both = F.array_sort(F.concat(tagged(taken, 0), tagged(spans, 1)))
    nothing = _array_of("struct<start:int,tag:int,end:int,kind:int,from:int,to:int,hit:string>")
    return F.when(F.size(spans) > 0, bound(both, clear)).otherwise(nothing)


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda span: F.length(F.regexp_extract(span["hit"], pattern, group)) >= least


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _scanned(docs: DataFrame, own: str) -> DataFrame:
    """docs and the column `own`: all spans, sorted, with their places in characters and in bytes."""
    kinds, text = len(BASE), F.col("text")
    patterns = [p for _, p, *_ in BASE] + [p for _, p, *_ in CLASSES]
    hits, spans, taken = ([f"{own}_{n}{k}" for k in range(len(patterns))] for n in ("hits", "spans", "taken"))
    rows = docs.withColumns({c: F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array()) for c, p in zip(hits, patterns)})
    rows = rows.withColumns({c: _spans(text, F.col(h), p, k) for k, (c, h, p) in enumerate(zip(spans, hits, patterns))}).drop(*hits)
    base = [_plain(F.filter(spans[k], _long_enough(*BASE[k][1:]))) for k in range(kinds)]
    last = taken[kinds - 1]
    rows = rows.withColumn(last, F.concat(*base))
    for k in range(kinds, len(patterns)):
        fresh = F.filter(_clear_of(F.col(last), F.col(spans[k])), _random_enough(*CLASSES[k - kinds][2:]))
        rows = rows.withColumn(taken[k], F.concat(last, _plain(fresh)))
        last = taken[k]
    return rows.withColumn(own, F.array_sort(last)).drop(*spans, *taken)


def _own_name(columns: list[str]) -> str:
    own = "__scan"
    while any(c.startswith(own) for c in columns):
        own += "_"
    return own


def scan(docs: DataFrame) -> DataFrame:
    """docs with `spans`, an array of (start, kind, end) in that order; kind numbers KINDS."""
    own = _own_name(docs.columns)
    plain = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return _scanned(docs.drop("spans"), own).withColumn("spans", plain).drop(own)


KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in CLASSES)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [
        F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)
    ]
    return scan(docs).select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every span in text replaced by the mark; overlapping spans share one. n_chars follows the text."""
    own = _own_name(docs.columns)
    text, spans = F.col("text"), F.col(own)

    # The bytes between the spans so far and each one; none if they overlap.
    ends = before(spans, lambda s: s["to"], lambda a, b: F.greatest(a, b), F.lit(0))
    gaps = F.zip_with(spans, ends, lambda s, end: F.when(s["from"] >= end, F.struct(end.alias("from"), s["from"].alias("to"))))
    tail = F.struct(F.array_max(F.transform(spans, lambda s: s["to"])).alias("from"), F.octet_length(text).alias("to"))
    places = F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(tail))

    def cut(data: Column) -> Column:
        return F.transform(places, lambda g: F.substring(data, g["from"] + 1, g["to"] - g["from"]).cast("string"))

    some = F.size(own) > 0
    clean = F.array_join(bound(text.cast("binary"), cut), mark)
    rows = _scanned(docs, own).withColumn("text", F.when(some, clean).otherwise(text))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(some, length).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
