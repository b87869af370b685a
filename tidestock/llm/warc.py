"""WARC archives: pages written as records, one gzip member each, and read back in order.

Writing: payloads are told apart by SHA-1 and length. Of records with equal payloads of at least
`least` bytes the one with the largest id is the response; the others are revisits, which carry the HTTP
headers but not the payload again. Only digests are grouped; a payload with more than a thousandth of all
records (there are fewer than a thousand) moves no row, the rest is joined by a shuffle. Each task
writes archives of about ARCHIVE_BYTES into a shared folder and lists them in its output. That list, stored by
Spark's own commit, is the table of contents: archives of failed or repeated attempts are in no list.

Reading: one task per archive goes through it once. Bytes are decompressed as they arrive, member by
member; headers end at an empty line, blocks at their Content-Length; the digests of block and payload
are computed on the way and compared with the headers. Memory holds one chunk, not a record, unless
payloads are asked for. A member that ends early, a header that is none, or a record that does not
fill its member raises with the archive and the place.

Folders are opened by pyarrow (local, hdfs, s3, gs, abfs paths), so the tasks' machines must reach them.

Defined cases: a null payload is the empty payload, which is a payload like others; a null url gives a
record without target; line breaks and other control characters in a url are percent-encoded. A null id gives a record
without page, and is below every other id. Rows that repeat with the largest id of their payload are
responses each, as are payloads with null ids only. Payloads are whole, whatever their length. An empty table gives
no archive and no record; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: An archive is closed when it holds so many compressed bytes.
ARCHIVE_BYTES = 128 << 20
#: Bytes read, and decompressed at most, at once; compressed bytes are fed in small pieces, as what
#: follows a member is handed back.
CHUNK, FEED = 1 << 20, 1 << 13
LEVEL = 6
#: A payload is hot with more than one record in so many.
HOT_SHARE = 1000
#: Headers longer than this are none.
MOST_HEADER = 1 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
END = b"\r\n\r\n"

DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as path or URI."""
    at = urlsplit(folder)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path
    return fs.FileSystem.from_uri(folder)


def record_id(page: object, digest: str) -> str:
    """The record of a page and payload: the same name wherever it is referred to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def safe_uri(url: str) -> str:
    """The url without characters that would end its header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{name}: {value}".encode() for name, value in headers], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + END + block + END


def page_record(page: object, url: str | None, payload: bytes, digest: str, response: bool, refers_to: object = None, date: str = DATE) -> bytes:
    """A response, or a revisit of the response of page `refers_to`, as one gzip member."""
    http = HTTP.format(len(payload)).encode()
    block = http + payload if response else http
    headers = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page is not None:
        headers.append(("Page", str(page)))
    if url is not None:
        headers.append(("WARC-Target-URI", safe_uri(url)))
    if not response:
        headers.append(("WARC-Profile", REVISIT_PROFILE))
        headers.append(("WARC-Refers-To", record_id(refers_to, digest)))
        if refers_to is not None:
            headers.append(("Refers-To-Page", str(refers_to)))
    return member(record(headers, block))


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def first_record(name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ]
    return member(record(headers, block))


class Archives:
    """The archives one task writes, one after the other; names are new in every attempt."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.system, self.path = opened(folder)
        self.out = None

    def add(self, data: bytes) -> tuple[str, int, int] | None:
        """Writes a record; (path, records, bytes) of the archive that this one filled."""
        if self.out is None:
            self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
            head = first_record(self.name)
            self.out.write(head)
            self.records, self.size = 0, len(head)
        self.out.write(data)
        self.records += 1
        self.size += len(data)
        return self.close() if self.size >= self.most else None

    def close(self) -> tuple[str, int, int] | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.name}", self.records, self.size


def judged(pages: DataFrame, scratch: Scratch, least: int = 0, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(page, url, payload, digest, response, refers_to) of every page."""
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].alias("page"), pages["url"].cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    light = rows.select("page", "digest", F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least)
    groups = scratch.store(light.groupBy("digest", "bytes").agg(F.max("page").alias("latest"), F.count("*").alias("copies")), "payloads")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    again = groups.where("copies > 1").select("digest", "bytes", "latest", "copies")
    often = F.col("copies") * HOT_SHARE > total
    hot, rest = F.broadcast(again.where(often)), again.where(~often)  # fewer than HOT_SHARE payloads
    rows = rows.withColumn("bytes", F.octet_length("payload"))
    on = ["digest", "bytes"]
    found = rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, "left"), allowMissingColumns=True)
    revisit = F.col("copies").isNotNull() & ~F.col("page").eqNullSafe(F.col("latest"))
    return found.select("page", "url", "payload", "digest", (~revisit).alias("response"), F.when(revisit, F.col("latest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages into archives in `folder`; the stored table of contents (path, records, bytes)."""
    scratch = Scratch(pages.sparkSession)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder, archive_bytes)

        def listed(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([done[0]]), pa.array([done[1]], pa.int64()), pa.array([done[2]], pa.int64())], names=["path", "records", "bytes"]
            )

        for batch in batches:
            for row in zip(*batch.columns):
                page, url, data, digest, response, refers_to = (v.as_py() for v in row)
                done = archives.add(page_record(page, url, data, base32(digest), response, refers_to))
                if done:
                    yield listed(done)
        if done := archives.close():
            yield listed(done)

    rows = judged(pages, scratch, least, key, payload)
    return scratch.store(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


class Framing(ValueError):
    """An archive is not what its framing says."""


class Member:
    """The decompressed bytes of one gzip member, asked for piece by piece."""

    def __init__(self, source: "Members"):
        self.source, self.unpack = source, zlib.decompressobj(31)
        self.held = bytearray()

    def more(self) -> bool:
        """One more piece of decompressed bytes; False at the end of the member."""
        if self.unpack.eof:
            return False
        data = self.unpack.unconsumed_tail or self.source.raw()
        try:
            piece = self.unpack.decompress(data, CHUNK)
        except zlib.error as fault:
            raise Framing(f"{self.source.name}: {fault}, before byte {self.source.place}") from None
        if not (data or piece or self.unpack.eof):
            raise Framing(f"{self.source.name}: a member ends early, at byte {self.source.place}")
        self.held += piece
        if self.unpack.eof:
            self.source.give_back(self.unpack.unused_data)
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to and including `mark`."""
        searched = 0
        while (at := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > most or not self.more():
                raise Framing(f"{self.source.name}: no header, before byte {self.source.place}")
        return self._taken(at + len(mark))

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes, in pieces."""
        while size:
            if not self.held and not self.more():
                raise Framing(f"{self.source.name}: a block ends early, before byte {self.source.place}")
            piece = self._taken(min(size, len(self.held)))
            size -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """The end of the member: nothing may be left."""
        while not self.held and self.more():
            pass
        if self.held:
            raise Framing(f"{self.source.name}: a record does not fill its member, before byte {self.source.place}")

    def _taken(self, size: int) -> bytes:
        piece = bytes(self.held[:size])
        del self.held[:size]
        return piece


class Members:
    """The gzip members of one archive, in order, from one pass over its bytes."""

    def __init__(self, stream, name: str):
        self.stream, self.name = stream, name
        self.chunk, self.at, self.before = b"", 0, 0

    @property
    def place(self) -> int:
        return self.before + self.at

    def _filled(self) -> bool:
        if self.at == len(self.chunk):
            self.before += self.at
            self.chunk, self.at = self.stream.read(CHUNK), 0
        return bool(self.chunk)

    def raw(self) -> bytes:
        """The next few bytes; none at the end."""
        if not self._filled():
            return b""
        data = self.chunk[self.at : self.at + FEED]
        self.at += len(data)
        return data

    def give_back(self, data: bytes) -> None:
        """The end of the last `raw` piece, to come again."""
        self.at -= len(data)

    def __iter__(self) -> Iterator[Member]:
        while self._filled():
            yield Member(self)


def headers_of(data: bytes) -> dict[str, str]:
    """Names in lower case and values, of header lines."""
    return {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")) if n.strip()}


def bare(digest: str | None) -> str | None:
    """The digest behind its algorithm, in upper case."""
    return digest.partition(":")[2].upper() or None if digest else None


def read_record(part: Member, payload: bool = False) -> dict:
    """One record: its headers, sizes and digests, and the payload itself if wanted."""
    start = part.until(b"\r\n", MOST_HEADER)
    if not start.startswith(b"WARC/1."):
        raise Framing(f"{part.source.name}: no WARC record, before byte {part.source.place}")
    head = headers_of(part.until(END, MOST_HEADER))
    length = head.get("content-length", "")
    if not length.isdecimal():
        raise Framing(f"{part.source.name}: no Content-Length, before byte {part.source.place}")
    kind = head.get("warc-type")
    block, body, kept = hashlib.sha1(), hashlib.sha1(), []
    http, opening, size = None, bytearray(), 0
    is_http = head.get("content-type", "").startswith("application/http")
    for piece in part.pieces(int(length)):
        block.update(piece)
        if is_http and http is None:
            opening += piece
            at = opening.find(END)
            if at < 0:
                continue
            http, piece = headers_of(bytes(opening[:at]).partition(b"\r\n")[2]), bytes(opening[at + len(END) :])
            opening = bytearray()
        body.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    if b"".join(part.pieces(len(END))) != END:
        raise Framing(f"{part.source.name}: a block is longer than its Content-Length, before byte {part.source.place}")
    part.finish()
    said, full = bare(head.get("warc-payload-digest")), kind == "revisit"
    intact = bare(head.get("warc-block-digest")) in (None, base32(block.digest()))
    if not full:
        intact = intact and said in (None, base32(body.digest()))
    announced = (http or {}).get("content-length", "")
    return {
        "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"),
        "page": head.get("page"), "refers_to": head.get("refers-to-page"),
        "payload_bytes": int(announced) if full and announced.isdecimal() else size,
        "payload_digest": said if full else base32(body.digest()),
        "intact": intact, "payload": b"".join(kept) if payload and not full else None,
    }


SCHEMA = "record_id string, record_type string, target_uri string, page string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the archives listed in (path): SCHEMA, and `payload` as bytes if wanted.

    Revisits have the digest and size of the payload that they refer to, and no payload. `intact` is
    false where a digest differs from its header.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")] + (["payload"] if payload else [])
    types = {"payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in columns], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column(0)):
            folder, _, name = path.rpartition("/")
            system, at = opened(folder)
            rows, held = [], 0
            with system.open_input_stream(f"{at}/{name}", compression=None) as stream:
                for part in Members(stream, path):
                    rows.append(read_record(part, payload))
                    held += len(rows[-1]["payload"] or b"")
                    if len(rows) == 2000 or held > 32 * CHUNK:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    paths = archives.select("path")
    spread = paths.repartition(max(1, paths.count()))  # one archive, one task
    return spread.mapInArrow(run, SCHEMA + (", payload binary" if payload else ""))


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives below the session's shared folder."""
    return f"{Scratch(spark).root}/warc"


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of the pages' records, written and read back."""
    kind = pages.schema["page_id"].dataType
    records = read(write(pages, folder or new_folder(pages.sparkSession), least)).where("record_type <> 'warcinfo'")
    return records.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "intact",
    )


# Base32 of the SHA-1: its 160 bits, five at a time. `latest` is the page that is the response.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
         max(page_id) OVER (PARTITION BY sha1(body), octet_length(encode(body))) AS latest
  FROM p
),
bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
           right(bin(16 + (strpos('0123456789abcdef', substr(hex, i, 1)) - 1)), 4)), 'string_agg', '') AS bits
  FROM digests
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
         + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to, true AS intact
FROM bits
"""
