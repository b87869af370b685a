import base64
import gzip
import hashlib
import io
import random
import zlib

import duckdb
import pytest

from tidestock.llm import queries, warc

DDL = "page_id long, html string, url string, digest string, page int, bytes int"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows, least=0):
    body = lambda h: (h or "").encode()
    latest = {}
    for i, h, _ in rows:
        if len(body(h)) >= least:
            latest[body(h)] = max((i, latest.get(body(h))), key=lambda k: (k is not None, k or 0))
    out = []
    for i, h, _ in rows:
        b = body(h)
        revisit = len(b) >= least and latest[b] != i
        out.append((i, len(b), b32(b), "revisit" if revisit else "response", latest[b] if revisit else None, True))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    word = lambda: rng.choice(["<p>", "é", "中", "a" * 9, "\r\n\r\n", "WARC/1.1\r\n", "😀", " "])
    made = [(k, "".join(word() for _ in range(rng.randrange(60))), f"http://h/{k}") for k in range(300)]
    made += [(400 + k // 3, made[k][1], None) for k in range(0, 300, 3)] + [(600 + k, "x" * 50, "http://same/") for k in range(200)]
    made += [(None, None, None), (None, "x" * 50, "u"), (None, "only null ids", "u"), (None, "only null ids", "u"), (9, "", "u\r\nWARC-Type: fake \x00é")]
    made += [made[-1], made[4], (1000, "long " * 700_000, "l"), (1001, "".join(rng.choices("abcdefgh0123é", k=600_000)), "m")]
    return made


def frame(rows, data):
    return rows(DDL, *[(i, h, u, "clash", 1, 2) for i, h, u in data]).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 51])
def test_round_trip(rows, least):
    data = pages()
    assert got(warc.round_trip(frame(rows, data), least=least)) == plain(data, least)


def test_empty(rows):
    out = warc.round_trip(frame(rows, pages()).limit(0))
    assert out.count() == 0 and out.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_files(rows, tmp_path):
    """Archives read by hand: members, headers, payloads; many small archives, each in the list once."""
    data = pages()[:150]
    listed = warc.write(frame(rows, data), str(tmp_path / "a"), archive_bytes=4000).collect()
    assert len(listed) > 5 and len({r.path for r in listed}) == len(listed)
    bodies, records = {}, 0
    for r in listed:
        raw, n = open(r.path, "rb").read(), -1
        assert len(raw) == r.bytes
        while raw:
            unpack = zlib.decompressobj(31)
            head, _, rest = unpack.decompress(raw).partition(b"\r\n\r\n")
            raw, n = unpack.unused_data, n + 1
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            block = rest[: int(fields[b"Content-Length"])]
            assert rest[len(block) :] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
            if fields[b"WARC-Type"] == b"response":
                bodies[int(fields[b"Page"])] = block.partition(b"\r\n\r\n")[2]
                assert fields[b"WARC-Payload-Digest"] == b"sha1:" + b32(bodies[int(fields[b"Page"])]).encode()
        assert n == r.records
        records += n
        assert gzip.open(r.path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert records == len(data) and all(bodies[i] == h.encode() for i, h, _ in data if i in bodies)


def test_payloads_and_references(rows, tmp_path):
    data = pages()
    listed = warc.write(frame(rows, data), f"file://{tmp_path}/b")
    records = [r for r in warc.read(listed, payload=True).collect() if r.record_type != "warcinfo"]
    text = {i: (h or "") for i, h, _ in data}
    named = {r.record_id for r in records if r.record_type == "response"}
    for r in records:
        if r.page is not None and r.record_type == "response":
            assert r.payload.decode() == text[int(r.page)]
        assert (r.payload is None) == (r.record_type == "revisit")
    assert len(named) >= 200 and any(r.target_uri == "u%0D%0AWARC-Type:%20fake%20%00é" for r in records)


def members(data):
    return list(warc.Members(io.BytesIO(data), "here"))


def records(data, payload=True):
    return [warc.read_record(m, payload) for m in warc.Members(io.BytesIO(data), "here")]


def test_damage():
    body = "né".encode() * 400_000
    one = warc.page_record(1, "http://x", body, b32(body), True)
    two = warc.page_record(2, None, b"", b32(b""), True)
    assert [(r["page"], r["payload"], r["intact"]) for r in records(one + two)] == [("1", body, True), ("2", b"", True)]
    assert records(b"") == []
    whole = gzip.decompress(two)
    changed = warc.member(whole.replace(b"200 OK", b"404 NO"))
    assert [r["intact"] for r in records(changed + one)] == [False, True]
    wrong = warc.page_record(3, None, b"abc", b32(b"xyz"), True)
    assert [r["intact"] for r in records(wrong)] == [False]
    long = warc.member(whole + b"more")
    short = warc.member(whole[:-3])
    headless, nameless = warc.member(b"GET / HTTP/1.1\r\n\r\n"), warc.member(b"WARC/1.1\r\nA: b\r\n\r\n\r\n\r\n")
    for bad in (one[:-20], one[:30], one + b"junk", long, short, headless, nameless, warc.member(b"x" * 3_000_000), two[:-8] + b"\0" * 8):
        with pytest.raises(warc.Framing, match="here"):
            records(bad)


@pytest.mark.parametrize("feed", [1, 7, 1 << 13])
def test_pieces_of_any_size(monkeypatch, feed):
    monkeypatch.setattr(warc, "FEED", feed)
    monkeypatch.setattr(warc, "CHUNK", 2 * feed + 1)
    bodies = [b"\r\n" * k + bytes(range(200)) * k for k in range(5)]
    data = b"".join(warc.page_record(k, "u", b, b32(b), True) for k, b in enumerate(bodies))
    assert [r["payload"] for r in records(data)] == bodies and all(r["intact"] for r in records(data))


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op12_warc"])
    names = [c[0] for c in want.description]
    found = queries.op12_warc(spark, path)
    assert found.columns == names
    assert got(found) == sorted(want.fetchall(), key=str)
