import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidestock.llm import conversations, glr_repair, queries

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least (cost, audit) and what is left, by a search over (row, place in the grammar), least first."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, phase, left = heapq.heappop(heap)
        if i == len(rows) and phase in (0, 3):
            return cost, audit, list(left)
        if (i, phase) in seen:
            continue
        seen.add((i, phase))
        for r in "ua":
            if (phase, r) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[phase, r], (*left, (NAMES[r], ""))))
        if i < len(rows):
            role, text, kind = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, phase, left))
            if kind != "x":
                more = int(kind == "t")
                if (phase, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[phase, role[:1]], (*left, (role, text))))
                for r in "ua":
                    if (phase, r) in NEXT:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[phase, r], (*left, (NAMES[r], text))))


def plain(rows, absent=frozenset()):
    """Reports of (conv, turn, role, text) rows, one conversation after the other."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], signed(xxhash.xxh64_intdigest(r[3], 42)))
    convs = {}
    for k, (c, turn, role, text) in enumerate(rows):
        own = convs.setdefault(c, [])
        if k not in absent:
            own.append((c, turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, own in convs.items():
        own.sort(key=order)
        seen, marked, counts = set(), [], dict.fromkeys("bdt", 0)
        for _, _, role, text in own:
            said = re.sub(r"[\x20\x09-\x0D]", "", text)
            kind = "b" if not said else "d" if (role, text) in seen else "k" if said[-1] in ".!?" else "t"
            counts[kind] = counts.get(kind, 0) + 1
            seen.add((role, text))
            marked.append((role, text, {"b": "x", "d": "x"}.get(kind, kind)))
        cost, audit, left = cheapest(marked)
        turns = {t for _, t, _, _ in own if t is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out.append((
            c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["b"], counts["d"], counts["t"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def marks(initials):
    return [(r, f"{k}.", kind) for k, (r, kind) in enumerate(initials)]


def test_all_short_sequences():
    """Against every way of editing at most two rows."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    legal = re.compile("(s?(ua)+)?")
    for n in range(3):
        for rows in itertools.product(itertools.product("suaxP", "ktx"), repeat=n):
            best = None
            for edits in itertools.product("KuaD", repeat=n):
                for fill in itertools.product(gaps, repeat=n + 1):
                    cost, audit, said = 2 * len(fill[0]), "I" * len(fill[0]), fill[0]
                    for (r, kind), e, f in zip(rows, edits, fill[1:]):
                        if kind == "x" and e != "D":
                            break
                        cost += {"K": 0, "D": 3}.get(e, 2) + (kind == "t" and e != "D") + 2 * len(f)
                        audit += (e if e in "KD" else "R") + "I" * len(f)
                        said += {"K": r, "D": ""}.get(e, e) + f
                    else:
                        if legal.fullmatch(said):
                            best = min(best or (cost, audit), (cost, audit))
            assert glr_repair.solved(tuple(r for r, _ in rows), "".join(k for _, k in rows)) == best


def test_long_sequences_whole_and_in_pieces():
    rng = random.Random(5)
    p = glr_repair.parser()
    assert len(p.nodes()) < 20
    for _ in range(60):
        rows = [(rng.choice("suaua P"), rng.choice("kkktx")) for _ in range(rng.randrange(60))]
        cost, audit, left = cheapest(marks(rows))
        assert p.solve(rows) == (cost, audit)
        assert [(r[:1], t) for r, t in glr_repair.applied([m[:2] for m in marks(rows)], audit)] == [(r[:1], t) for r, t in left]
        frontier, at = p.start(), 0
        while at < len(rows):
            size = rng.randrange(1, 9)
            frontier, _ = glr_repair.fold(frontier, p.table_of(rows[at : at + size]))
            at += size
        assert p.best(frontier)[0] == (cost, audit)


def test_other_grammars():
    """Answers with any number of tool rows, which an empty production allows; and brackets, which nest."""
    p = glr_repair.Parser((("C", "Cq"), ("C", ""), ("q", "uXa"), ("X", "Xt"), ("X", "")), roles="ua")
    assert p.solve([(c, "k") for c in "uttaua"]) == (0, "KKKKKK")
    assert p.solve([(c, "k") for c in "uttt"]) == (2, "KKKKI")
    assert p.solve([(c, "k") for c in "tta"]) == (2, "IKKK")
    assert p.solve([(c, "x") for c in "ut"]) == (6, "DD")
    with pytest.raises(ValueError, match="without end"):
        glr_repair.Parser((("B", "B(B)"), ("B", "")), roles="()")


def talk():
    rng = random.Random(8)
    said = ["Yes.", "No?", "so", "", " \t", "é!", "More of it. ", "x" * 30 + ".", None, " ", "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "urgent", None, "Peter"]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles[: rng.choice([2, 5, 11])]), rng.choice(said)))
    rows += [(None, k, roles[k % 2], f"Line {k}.") for k in range(5)]
    rows += [(200, k // 2, roles[k % 4 if k % 7 else 4], rng.choice(said) if k % 5 else f"Line {k}.") for k in range(900)]  # hot
    rows += [(201, 3, "user", "Again.")] * 400 + [(202, 2**62, "user", "far"), (202, -(2**62), "assistant", "Off.")]
    rng.shuffle(rows)
    return rows


DDL = "conv_id long, turn long, role string, text string, key string, piece int"


def got(df):
    assert df.columns[1:] == [*conversations.FIGURES, "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("piece", [3, 64, 512])
def test_reports(spark, rows, piece):
    """Rows in small pieces and in large ones give the same; the hot conversation is in many tasks."""
    data = talk()
    df = rows(DDL, *[(*r, "clash", 1) for r in data]).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        made = conversations.repair(df, piece_rows=piece)
        assert got(made.digests()) == plain(data)
        assert made.pieces.where("key = 200").count() >= 900 // piece + 1
        tasks = made.pieces.where("key = 201").select(F.shiftright("piece", 32)).distinct().count()
        assert tasks > 1  # equal rows are split, too
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    left = {}
    for r in made.rows().orderBy("key", "piece", "place").collect():
        left.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    want = {r[0]: r[8] for r in plain(data)}
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in left.items()} == {c: h for c, h in want.items() if c in left}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in v)) for v in left.values())


def test_absent_rows_and_long_texts(rows):
    data = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "gone"), (3, 0, "user", "w " * 3_000_000), (3, 1, "assistant", "Ok.")]
    absent = {k for k, r in enumerate(data) if r[3] in ("Hi.", "gone")}
    df = rows(DDL, *[(*r, "", 1) for r in data])
    made = conversations.repair(df, absent=F.col("text").isin("Hi.", "gone"))
    assert got(made.digests()) == plain(data, absent)
    nothing = (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert nothing in got(made.digests())
    empty = conversations.repair(df.limit(0))
    assert empty.digests().count() == empty.rows().count() == 0


def hurt(rows):
    """Faults by checksum, in plain Python: rows, and which are dropped."""
    out, gone = [], set()
    for c, t, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        if fault == 0:
            gone.add(len(out))
        out += [(c, t, role, text)] * (1 + (fault == 3))
    return out, gone


def test_damage(rows):
    data = talk()
    df, dropped = conversations.damaged(rows(DDL, *[(*r, "", 1) for r in data]))
    assert got(conversations.repair(df, absent=dropped).digests()) == plain(*hurt(data))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_glr_repair(spark, path)
    assert found.columns[0] == "conv_id" and got(found) == plain(*hurt(data))
