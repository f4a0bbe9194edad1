"""WARC records in ZIP packages.

A package holds ``archive/data.warc.gz`` (each record its own gzip member) and
``indexes/index.cdxj`` (a line for each record: its offset and length in the archive), both
stored without compression, so that a record is a byte range of the package.  The reader
finds the end record and, where its fields are full, the ZIP64 end record; walks the
central directory with its ZIP64 fields; locates the members' data behind their local
headers; reads the index; and then reads records by range.  Nothing is extracted.

Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id
is the response and the others are revisits of it.  Equality is that of SHA-1 and length;
only payloads that occur twice take part in the join that tells revisits.

Cases: a null payload is empty; rows that share the smallest page_id and the payload are
all responses; rows with a null page_id are revisits where a page with an id has the same
payload, else responses; a null URL leaves its field out; control characters in a URL are
percent-encoded; other columns aren't read; an empty table makes empty packages.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm import store

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# fixed values: formats of ZIP and WARC
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
WINDOW = 4 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed.  A revisit keeps the HTTP header, whose length field
    is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """The fields of a record, its payload's bytes and digest: for a response both are
    taken from the payload itself (and must agree with the field), for a revisit they are
    what its fields say of the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response":
        size, found = len(payload), digest(payload)
        if found != said:
            raise ValueError(f"{warc['warc-record-id']}: the payload's digest is {found}, not {said}")
    else:
        size, found = int(_fields(http)["content-length"]), said
    return {"page_id": _page(warc["warc-record-id"]), "payload_bytes": size, "payload_digest": found, "record_type": warc["warc-type"],
            "refers_to": _page(warc["warc-refers-to"]) if "warc-refers-to" in warc else None, "url": warc.get("warc-target-uri"), "payload": payload}


class Package:
    """Writes a package to a stream: records first, then the index."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        member = gzip.compress(record(page_id, url, payload, refers_to), 6, mtime=0)
        self.archive.write(member)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(member)}))
        self.at += len(member)

    def close(self) -> None:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
            f.write("".join(line + "\n" for line in self.lines).encode())
        self.zip.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class Reader:
    """Members and byte ranges of a ZIP file that ``read_at(size, offset)`` reads."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        self.members = {m.name: m for m in self._directory(size)}

    def _directory(self, size: int) -> Iterator[Member]:
        back = min(size, 22 + FULL16)
        tail = self.read_at(back, size - back)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # in a comment
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        entries, length, start = struct.unpack_from("<10xHII", tail, at)
        place = size - back + at
        if entries == FULL16 or length == FULL32 or start == FULL32:
            locator = self.read_at(20, place - 20) if place >= 20 else b""
            if locator[:4] == LOCATOR:
                far = struct.unpack_from("<8xQ", locator)[0]
                end = self.read_at(56, far)
                if end[:4] != END64:
                    raise ValueError("no ZIP64 end record where its locator says")
                entries, length, start = struct.unpack_from("<32xQQQ", end)
        table = self.read_at(length, start)
        at = 0
        for _ in range(entries):
            if table[at : at + 4] != ENTRY:
                raise ValueError("broken central directory")
            flags, method, packed, full, n, m, k, header = struct.unpack_from("<8xHH8xIIHHH8xI", table, at)
            name = table[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = table[at + 46 + n : at + 46 + n + m]
            full, packed, header = self._wide(extra, full, packed, header)
            yield Member(name, method, full, packed, header)
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
        """Values with those that are full taken from the ZIP64 field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                return tuple(next(wide) if v == FULL32 else v for v in values)
            at += 4 + size
        return values

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed; records can be read by range from stored members only")
        local = self.read_at(30, m.header)
        if local[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        n, k = struct.unpack_from("<26xHH", local)
        return m.header + 30 + n + k, m.size

    def records(self, archive: str = ARCHIVE, index: str = INDEX) -> Iterator[dict]:
        """All records that the index lists, in its order; neighbours are fetched together."""
        origin, _ = self.stored(archive)
        at, size = self.stored(index)
        window, begin = b"", 0
        for line in self._lines(at, size):
            entry = json.loads(line)
            offset, length = entry["offset"], entry["length"]
            if not begin <= offset <= offset + length <= begin + len(window):
                window, begin = self.read_at(max(length, min(WINDOW, self.members[archive].size - offset)), origin + offset), offset
            yield parse(gzip.decompress(window[offset - begin : offset - begin + length]))

    def _lines(self, at: int, size: int) -> Iterator[bytes]:
        left = b""
        for start in range(at, at + size, WINDOW):
            *whole, left = (left + self.read_at(min(WINDOW, at + size - start), start)).split(b"\n")
            yield from whole
        if left:
            yield left


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write all rows to packages, one for each task; the written list ``file, records``."""
    spark = store.ready(df.sparkSession)
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.select("*", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")).alias("same"))
    twice = pages.where(F.octet_length("payload") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = store.written(twice.where("n > 1 and first is not null").select("same", "first"), "warc-payloads")
    told = pages.join(twice, "same", "left").select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.zip", [0]

        def fill(out) -> None:
            package = Package(out)
            for part in store.slices(batches, "payload"):
                for page_id, url, payload, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    package.add(page_id, url, payload, refers)
                    n[0] += 1
            package.close()

        store.put_file(f"{folder}/{name}", fill)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(n, pa.int64())], ["file", "records"])

    del spark
    return store.written(told.mapInArrow(pack, "file string, records long"), "warc-packages")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(packages: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the listed packages, read by range."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    n = packages.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = store.filesystem(f"{folder}/{file}")
                with system.open_input_file(path) as f:
                    rows, size = [], 0
                    for r in Reader(f.read_at, f.size()).records():
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > WINDOW:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(names, types, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in zip(names, types, strict=True)], names)

    return packages.select("file").repartition(max(1, n), "file").mapInArrow(run, SCHEMA)
